"""Store state: merges, differences between a store and the disk, staleness, updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import edge_confidence

MTIME_TOLERANCE = 1e-6
#: From best to worst.
SEVERITY = ("current", "absent", "stale", "missing")


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by node_key: the new row counts, but a known key keeps its first_seen."""
    first = old.select("node_key", F.col("first_seen").alias("__f"))
    fresh = new.join(first, "node_key", "left").withColumn("first_seen", F.coalesce("__f", "first_seen")).drop("__f").select(*old.columns)
    return old.join(new.select("node_key"), "node_key", "left_anti").select(*old.columns).unionByName(fresh)


def merged_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (src, dst, rel). `new` has src, dst, rel, method, seen, in any number of rows a key, and `seq` as their order.

    The latest assertion sets method and confidence, even a weaker one; last_seen moves to it, first_seen never moves.
    """
    key = ["src", "dst", "rel"]
    cols = [*key, "first_seen", "last_seen", "method"]
    latest = new.groupBy(*key).agg(F.max_by("method", F.struct("seen", "seq")).alias("method"), F.max("seen").alias("last_seen"), F.min("seen").alias("first_seen")).select(*cols)
    before = old.select(*key, F.col("first_seen").alias("__f"))
    fresh = latest.join(before, key, "left").withColumn("first_seen", F.coalesce("__f", "first_seen")).select(*cols)
    kept = old.join(latest.select(*key), key, "left_anti").select(*cols)
    return kept.unionByName(fresh).withColumn("confidence", edge_confidence(F.col("method")))


def differences(stored: DataFrame, current: DataFrame, use_hash: bool = True) -> DataFrame:
    """(path, change): added, removed, changed, touched or unchanged.

    Both sides have path, size, mtime and, if hashes are used, content_hash. Size and time equal: unchanged, unless
    `current` has a column `unreadable` that is true; equal hashes: touched.
    """
    a = stored.select("path", *[F.col(c).alias(f"a_{c}") for c in ("size", "mtime", "content_hash")])
    more = [c for c in ("content_hash", "unreadable") if c in current.columns]
    b = current.select("path", *[F.col(c).alias(f"b_{c}") for c in ("size", "mtime", *more)], F.lit(True).alias("there"))
    same = (F.col("a_size") == F.col("b_size")) & (F.abs(F.col("a_mtime") - F.col("b_mtime")) <= MTIME_TOLERANCE)
    bad = F.coalesce(F.col("b_unreadable"), F.lit(False)) if "unreadable" in more else F.lit(False)
    known = F.coalesce(F.col("a_content_hash") == F.col("b_content_hash"), F.lit(False)) if use_hash and "content_hash" in more else F.lit(False)
    met = a.withColumn("was", F.lit(True)).join(b, "path", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("there").isNull(), "removed").when(bad, "changed")
        .when(F.coalesce(same, F.lit(False)), "unchanged").when(known, "touched").otherwise("changed")
    )
    return met.select("path", change.alias("change"))


def severity(state: Column) -> Column:
    return reduce(lambda c, i: c.when(state == SEVERITY[i], i), range(1, len(SEVERITY)), F.when(state == SEVERITY[0], 0))


def node_states(nodes: DataFrame, disk: DataFrame) -> DataFrame:
    """(id, node_key, state) of nodes with a path: current, stale, missing or absent (it has no recorded stat to compare).

    A section takes the worst state of the nodes of its path that have one.
    """
    d = disk.select("path", F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"), F.lit(True).alias("there"))
    files = nodes.where("path is not null").join(d, "path", "left")
    same = (F.col("size") == F.col("d_size")) & (F.abs(F.col("mtime") - F.col("d_mtime")) <= MTIME_TOLERANCE)
    own = F.when(F.col("size").isNull() | F.col("mtime").isNull(), "absent").when(F.col("there").isNull(), "missing").when(same, "current").otherwise("stale")
    judged = files.withColumn("own", own)
    worst = F.max(F.when(F.col("own") != "absent", severity(F.col("own")))).over(W.partitionBy("path"))
    state = F.when(F.col("own") != "absent", F.col("own")).when(worst.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), worst + 1)).otherwise("absent")
    return judged.withColumn("state", state).select("id", "node_key", "state")


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))


def embedding_status(nodes: DataFrame, states: DataFrame, embeddings: DataFrame | None) -> DataFrame:
    """(id, embedding_status): off (no embeddings), none (no vector), unknown (the file can't be judged), stale or current."""
    if embeddings is None:
        return nodes.select("id", F.lit("off").alias("embedding_status"))
    have = embeddings.select(F.col("node_id").alias("id"), F.lit(True).alias("has")).distinct()
    met = nodes.select("id").join(have, "id", "left").join(states.select("id", "state"), "id", "left")
    status = F.when(F.col("has").isNull(), "none").when(F.col("state").isNull() | F.col("state").isin("absent", "missing"), "unknown").otherwise(F.col("state"))
    return met.select("id", status.alias("embedding_status"))


def forgotten(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, paths: DataFrame, keep_self: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store tables without what comes from `paths`; `keep_self` keeps the file nodes and only drops their edges out and vectors."""
    gone = nodes.join(paths.select("path").distinct(), "path", "left_semi")
    if keep_self:
        parts = gone.where("node_key <> path").select("id")
        nodes = nodes.join(parts, "id", "left_anti")
        edges = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(parts.select(F.col("id").alias("dst")), "dst", "left_anti")
        return nodes, edges, embeddings.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    ids = gone.select("id")
    nodes = nodes.join(ids, "id", "left_anti")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes, edges, embeddings.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_anti")


def advanced(edges: DataFrame, unbuilt: DataFrame, as_of: str) -> DataFrame:
    """Edges of sources that were not rebuilt: those still held (last_seen is the latest of their source) move to `as_of`; expired ones stay."""
    keep = unbuilt.select(F.col("id").alias("src"), F.lit(True).alias("__u")).distinct()
    latest = F.max("last_seen").over(W.partitionBy("src"))
    moved = F.when(F.col("__u") & (F.col("last_seen") == F.col("__l")), F.lit(as_of)).otherwise(F.col("last_seen"))
    return edges.join(keep, "src", "left").withColumn("__l", latest).withColumn("last_seen", F.coalesce(moved, "last_seen")).select(*edges.columns)


def updated_edges(old: DataFrame, derived: DataFrame, rebuilt: DataFrame, as_of: str) -> DataFrame:
    """Edges after an update. `derived`: src, dst, rel, method of all edges as they hold now; `rebuilt`: ids of sources that were read anew.

    Of a rebuilt source all old edges go and the derived ones start at `as_of`; of the others every edge
    stays, held ones move on, expired ones stay expired, and edges that are derived anew begin.
    """
    anew = rebuilt.select(F.col("id").alias("src")).distinct()
    fresh = derived.join(anew, "src", "left_semi").select("src", "dst", "rel", F.lit(as_of).alias("first_seen"), F.lit(as_of).alias("last_seen"), "method")
    kept = old.join(anew, "src", "left_anti").select("src", "dst", "rel", "first_seen", "last_seen", "method")
    held = derived.join(anew, "src", "left_anti").select("src", "dst", "rel", F.col("method").alias("__m"))
    met = kept.join(held, ["src", "dst", "rel"], "full_outer")
    others = met.select(
        "src", "dst", "rel", F.coalesce("first_seen", F.lit(as_of)).alias("first_seen"),
        F.when(F.col("__m").isNotNull(), F.lit(as_of)).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("__m", "method").alias("method"),
    )
    return fresh.unionByName(others).withColumn("confidence", edge_confidence(F.col("method")))
