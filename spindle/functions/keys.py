"""Keys that don't depend on where a corpus lies: the root is written `~`, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import digest

#: Prefixes whose rest holds no path, so that they read the same anywhere.
PLAIN = ("author:", "ref:", "wikilink:", "tag:", "category:", "app:", "format:", "rollup:", "collection:", "date:", "resolution:", "series:")


def _parts(key: Column) -> tuple[Column, Column]:
    """What stands before the path of a key (`model::`, `archive:`), and the rest."""
    head = F.regexp_extract(key, r"^(?:archive:|(?:[a-z0-9]+::))+", 0)
    return head, F.substring(key, F.length(head) + 1, F.lit(1 << 30))


def is_plain(key: Column) -> Column:
    _, rest = _parts(key)
    found = F.lit(False)
    for p in PLAIN:
        found = found | rest.startswith(p)
    return found | ~F.substring(rest, 1, 1).isin("/", "~")


def _refused(key: Column, why: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"outside of the root ({why}): "), key)).cast("string")


def to_portable(key: Column, root: str) -> Column:
    """The key with the root as `~`; a path outside of the root fails the query."""
    head, rest = _parts(key)
    top = root.rstrip("/")
    inside = F.concat(head, F.lit("~"), F.substring(rest, len(top) + 1, 1 << 30))
    return F.when(is_plain(key), key).when((rest == (top or "/")) | rest.startswith(top + "/"), inside).otherwise(_refused(key, root))


def to_local(key: Column, root: str) -> Column:
    """The inverse under another root; a key that climbs out of it fails the query."""
    head, rest = _parts(key)
    climbs = F.concat(F.lit("/"), rest, F.lit("/")).contains("/../")
    local = F.concat(head, F.lit(root.rstrip("/")), F.substring(rest, 2, 1 << 30))
    return F.when(is_plain(key), key).when(climbs | ~rest.startswith("~"), _refused(key, root)).otherwise(local)


def shape(key: Column) -> Column:
    """The key's prefix with a digest for the rest: structure without names."""
    head, rest = _parts(key)
    prefix = F.regexp_extract(rest, r"^[a-z]+:", 0)
    return F.concat(head, prefix, digest(F.substring(rest, F.length(prefix) + 1, F.lit(1 << 30))))
