"""Path and key functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Up to the last slash; `/` for a file at the top, empty for a bare name."""
    cut = F.regexp_replace(path, "/+[^/]*$", "")
    return F.when(~path.contains("/"), "").when(cut == "", "/").otherwise(cut)


def stem(path: Column) -> Column:
    """Base name without its extension; leading dots don't begin an extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none. A leading dot is no separator."""
    base = basename(path)
    return F.when(F.substring(base, 2, 1 << 30).contains("."), F.lower(F.element_at(F.split(base, r"\."), -1))).otherwise("")


def normalise(path: Column) -> Column:
    """Resolves `.`, `..` and repeated slashes; an absolute path stays absolute, an empty one is `.`."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        up = F.when((n > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(n - 1, F.lit(0)))).when(absolute, acc).otherwise(F.array_append(acc, F.lit("..")))
        return F.when(x == "..", F.when(n == 0, F.when(absolute, acc).otherwise(F.array(F.lit("..")))).otherwise(up)).otherwise(F.array_append(acc, x))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def under(path: Column, root: str) -> Column:
    """Whether a path is `root` or below it, by whole components."""
    top = root.rstrip("/")
    return (path == (top or "/")) | path.startswith(top + "/")


def ascii_fold(text: Column) -> Column:
    """A-Z lower-cased and nothing else, as pattern matching in the store's language folds case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_parts(a: Column, b: Column) -> Column:
    """Number of leading path components that two paths share."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pairs, F.lit(False))
    return F.when(first == 0, F.size(pairs)).otherwise(first - 1).cast("int")


def digest(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
