"""The path classifier as one CASE expression over rules that are data.

Layers decide in order: secrets, allowed exceptions, caches, dependencies, application state, foreign
repositories, symlinks, images outside of the image roots; what none of them takes is
categorised by extension. A decision needs no look at any file.
"""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, extension, normalise

RULES = Path(__file__).with_name("rules.toml")


def load_rules(path: str | os.PathLike = RULES) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


@dataclass
class Classifier:
    root: str
    image_roots: tuple[str, ...] = ()
    own_owners: tuple[str, ...] = ()
    vendored: tuple[str, ...] = ()
    rules: dict = field(default_factory=load_rules)

    def _paths(self, names: list[str]) -> list[str]:
        return [n.replace("{root}", self.root.rstrip("/")) for n in names]

    def classify(self, files: DataFrame) -> DataFrame:
        """files: (path[, is_symlink]), absolute paths, with label, subtype, layer and detail.

        A first pass numbers the rule that decides; what the decision says is looked up by the number, so that no
        condition is planned or evaluated more than once.
        """
        r = self.rules

        def globbed(c: Column, names: list[str]) -> Column:
            whole = "|".join(re.sub(r"\\Z$|\\z$", "", fnmatch.translate(n)) for n in names)
            return c.rlike(f"^(?:{whole})$") if names else F.lit(False)

        def first_prefix(roots: list[str]) -> Column:
            hit = F.filter(F.array(*[F.lit(x) for x in roots]), lambda x: F.startswith(F.col("__p"), x)) if roots else F.array().cast("array<string>")
            return F.get(hit, F.lit(0))

        def first_dir(names: list[str]) -> Column:
            return F.get(F.array_intersect("__dirs", F.array(*[F.lit(n) for n in names])), F.lit(0))

        link = F.col("is_symlink") if "is_symlink" in files.columns and r["symlinks"]["exclude"] else F.lit(False)
        foreign = sorted((v.rstrip("/") + "/" for v in self.vendored), key=len, reverse=True) if r["vendored"]["enabled"] else []
        p, base, parent, ext = F.col("__p"), F.col("__base"), F.col("__parent"), F.col("__ext")
        cut = files.withColumn("__p", normalise(F.col("path")))
        parts = F.split("__p", "/")
        cut = cut.withColumns({"__base": basename(p), "__parent": dirname(p), "__ext": extension(p), "__dirs": F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))})
        cut = cut.withColumns({
            "__cache": first_dir(r["cache"]["dirs"]), "__dep": first_dir(r["dependencies"]["dirs"]), "__state": first_prefix(self._paths(r["app_state"]["prefixes"])),
            "__foreign": first_prefix(foreign), "__image": first_prefix([i.rstrip("/") + "/" for i in self.image_roots]),
        })
        kept = globbed(base, r["vendored"]["keep_toplevel"]) & (F.concat(parent, F.lit("/")) == F.col("__foreign"))
        rule = (
            F.when(base.isin(*r["secrets"]["names"]) | globbed(base, r["secrets"]["globs"]), 1)
            .when(globbed(p, self._paths(r["allow"]["globs"])), 2)
            .when(F.col("__cache").isNotNull(), 3)
            .when(globbed(base, r["cache"]["globs"]), 4)
            .when(F.col("__dep").isNotNull(), 5)
            .when(F.col("__state").isNotNull(), 6)
            .when((parent == self.root.rstrip("/")) & base.isin(*r["app_state"]["home_files"]), 7)
            .when(F.col("__foreign").isNotNull() & ~kept, 8)
            .when(link, 9)
            .when(ext.isin(*r["extensions"]["image"]) & F.col("__image").isNull(), 10)
            .otherwise(11)
        )
        e = r["extensions"]
        doctype = F.try_element_at(F.create_map(*[F.lit(x) for kv in e["document"].items() for x in kv]), ext)
        kind = F.when(ext.isin(*e["image"]), 1).when(ext.isin(*e["markdown"]), 2).when(ext.isin(*e["document"]), 3).when(ext.isin(*e["code"]), 4).otherwise(5)
        cut = cut.withColumns({"__rule": rule, "__kind": kind, "__doctype": doctype})
        at = lambda i, *names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(i))
        free = F.col("__rule").isin(2, 11)
        subtype = F.when(F.col("__kind") == 3, F.col("__doctype")).otherwise(at("__kind", "-", "note", "-", "-", "unknown"))
        reason = at("__rule", "redacted", "-", "cache", "cache", "dependency", "app-state", "app-state", "vendored-repo", "symlink", "image-outside-root", "-")
        layer = at("__rule", "secrets", "allow", "L3_cache", "L3_cache", "L1_dependencies", "L2_app_state", "L2_app_state", "L4_vendored_repo", "symlinks", "image_boundary", "category")
        why = F.when(F.col("__kind") == 1, "image ext").when(F.col("__kind") == 5, F.concat(F.lit("complement of "), ext)).otherwise(F.concat(F.lit("."), ext))
        what = F.coalesce(
            F.when(F.col("__rule") == 3, F.concat(F.lit("dir "), "__cache")), F.when(F.col("__rule") == 5, F.concat(F.lit("dir "), "__dep")), F.when(F.col("__rule") == 4, F.concat(F.lit("file "), base)),
            F.when(F.col("__rule") == 6, F.col("__state")), F.when(F.col("__rule") == 8, F.col("__foreign")), F.when(F.col("__rule") == 9, p), F.when(F.col("__rule") == 10, ext), base,
        )
        return cut.select(
            *files.columns, F.when(free, at("__kind", "image", "markdown", "document", "code", "misc")).otherwise("EXCLUDED").alias("label"),
            F.when(free, subtype).otherwise(reason).alias("subtype"), layer.alias("layer"), F.when(free, why).otherwise(what).alias("detail"),
        )

    def known_extensions(self) -> frozenset[str]:
        r = self.rules["extensions"]
        return frozenset("." + e for e in [*r["image"], *r["markdown"], *r["document"], *r["code"]])


def origin_owner(config_text: str) -> str | None:
    """The owner in a repository's origin address; None if it has no origin."""
    section = None
    for line in map(str.strip, config_text.splitlines()):
        if line.startswith("["):
            section = line.replace(" ", "")
        elif section == '[remote"origin"]' and (m := re.match(r"url\s*=\s*(?:git@[^:]+:|(?:https?|ssh)://[^/]+/|)([^/]+)", line)):
            return m[1]
    return None


def vendored_repositories(root: str, own_owners: tuple[str, ...], rules: dict | None = None) -> list[str]:
    """Repositories below `root` whose origin is another's; dependency and cache folders are not entered."""
    rules = rules or load_rules()
    skip = {*rules["cache"]["dirs"], *rules["dependencies"]["dirs"]}
    own, found = {o.lower() for o in own_owners}, []
    for at, dirs, _ in os.walk(root):
        if ".git" in dirs:
            config = Path(at, ".git", "config")
            owner = origin_owner(config.read_text(errors="replace")) if config.is_file() else None
            if owner is not None and owner.lower() not in own:
                found.append(at)
        dirs[:] = [d for d in dirs if d not in skip]
    return sorted(found, key=len, reverse=True)
