"""Graph operators over nodes (id, node_key, ...) and edges (src, dst, rel, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import AmbiguousKey
from ..schema import LINKING_RELS
from ..shared import kept, small

#: Edges that may be broadcast in a walk's step, by count.
BROADCAST_ROWS = 200_000


def alive_on(edges: DataFrame, day: str | Column) -> DataFrame:
    """Edges that hold on a day: first_seen <= day <= last_seen. The one definition of time travel."""
    d = F.lit(day) if isinstance(day, str) else day
    return edges.where((F.col("first_seen") <= d) & (F.col("last_seen") >= d))


def alive_between(edges: DataFrame, first: str, last: str) -> DataFrame:
    """Edges that hold on some day from `first` to `last`."""
    return edges.where((F.col("first_seen") <= last) & (F.col("last_seen") >= first))


def provenance(rows: DataFrame) -> DataFrame:
    """(method, confidence, n) of the rows that are not certain."""
    return rows.where("confidence < 1.0").groupBy("method", "confidence").agg(F.count("*").alias("n"))


def provenance_note(rows: DataFrame) -> str | None:
    """One sentence that names the counts by method; None if every row is certain."""
    counts = sorted(tuple(r) for r in provenance(rows).collect())  # at most one row for each method
    if not counts:
        return None
    return "partial: " + ", ".join(f"{n} by {m} ({c:.1f})" for m, c, n in counts)


def hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with its two nodes as structs s, d; the edge's columns under e."""
    s = nodes.select(F.col("id").alias("src"), F.struct(*nodes.columns).alias("s"))
    d = nodes.select(F.col("id").alias("dst"), F.struct(*nodes.columns).alias("d"))
    e = edges.select("src", "dst", F.struct(*edges.columns).alias("e"))
    return e.join(s, "src").join(d, "dst").select("s", "e", "d")


def backlinks(nodes: DataFrame, edges: DataFrame, key: str, rel: str | None = None, as_of: str | None = None) -> DataFrame:
    """(node_key, rel, method, confidence): sources of edges into `key`."""
    e = alive_on(edges, as_of) if as_of else edges
    e = e.where(F.col("rel") == rel) if rel else e
    into = e.join(F.broadcast(nodes.where(F.col("node_key") == key).select(F.col("id").alias("dst"))), "dst")  # one node
    return into.join(nodes.select(F.col("id").alias("src"), "node_key"), "src").select("node_key", "rel", "method", "confidence")


def broken_links(nodes: DataFrame) -> DataFrame:
    """Titles of link targets that no file answers."""
    return nodes.where("kind = 'wikilink' and subtype = 'broken'").select("title")


def broken_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(title, subtype, n): links to each broken target by the linking node's subtype."""
    targets = nodes.where("kind = 'wikilink' and subtype = 'broken'").select(F.col("id").alias("dst"), "title")
    return edges.join(targets, "dst").join(nodes.select(F.col("id").alias("src"), "subtype"), "src").groupBy("title", "subtype").agg(F.count("*").alias("n"))


def isolated(nodes: DataFrame, edges: DataFrame, kind: str = "file", rels: tuple[str, ...] = LINKING_RELS) -> DataFrame:
    """Nodes of a kind without a link of `rels`, either way, with another node of it; links to oneself don't count."""
    own = nodes.where(F.col("kind") == kind)
    ids = own.select("id")
    linked = edges.where(F.col("rel").isin(*rels) & (F.col("src") != F.col("dst")))
    linked = linked.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    touched = linked.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return own.join(touched, "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges out plus edges in; combined before the shuffle."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def min_degree(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least that degree, and the edges between them."""
    kept = nodes.join(degrees(edges).where(F.col("degree") >= least).select("id"), "id", "left_semi")
    return kept, within(edges, kept)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among `nodes`."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived nodes (no path) with no edge on either side."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.where("path is null").join(used, "id", "left_anti")


def pruned(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without orphans and edges between what stays. An orphan has no edge, so removing all at once is the fixpoint."""
    kept = nodes.join(orphans(nodes, edges).select("id"), "id", "left_anti")
    return kept, edges


def resolve_key(nodes: DataFrame, key: str) -> str | None:
    """A node's full key: itself, or the one prefix under which it is found; several are refused."""
    hit = nodes.where((F.col("node_key") == key) | F.col("node_key").endswith("::" + key)).select("node_key").distinct()
    found = [r["node_key"] for r in hit.limit(1000).collect()]
    if key in found:
        return key
    found = sorted(k for k in found if k.split("::", 1)[-1] == key)
    if len(found) > 1:
        raise AmbiguousKey(key, found)
    return found[0] if found else None


def _both_ways(edges: DataFrame) -> DataFrame:
    """(at, to, way, ...): every edge from either end, in one pass over the edges."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(*[F.struct(F.col(x).alias("at"), F.col(y).alias("to"), F.lit(way).alias("way")) for x, y, way in (("src", "dst", "out"), ("dst", "src", "in"))])
    return edges.select(F.explode(ends).alias("x"), *cols).select("x.*", *cols)


def neighbours(nodes: DataFrame, edges: DataFrame, key: str, depth: int = 1, directed: bool = False) -> DataFrame:
    """(depth, node_key, neighbour_key, rel, way, confidence) of a walk from `key` that takes edges either way, or only forward.

    Each node is expanded once; an edge shows once for each end that is expanded. The walk is on ids; each level is written, so
    that the next reads the edges once more and nothing else again. Keys are looked up at the end.
    """
    steps = _both_ways(edges.select("src", "dst", "rel", "confidence"))
    steps = steps.where("way = 'out'") if directed else steps
    frontier = kept(nodes.where(F.col("node_key") == key).select(F.col("id").alias("at")), "frontier")
    seen, out = frontier, None
    for level in range(1, depth + 1):
        rows = kept(steps.join(frontier, "at").withColumn("depth", F.lit(level)), "level")
        out = rows if out is None else out.unionByName(rows)
        if level < depth:
            frontier = kept(rows.select(F.col("to").alias("at")).distinct().join(seen, "at", "left_anti"), "frontier")
            seen = seen.union(frontier)
    names = nodes.select("id", "node_key")
    met = names.join(small(out.select(F.explode(F.array("at", "to")).alias("id")).distinct()), "id", "left_semi")
    names = small(kept(met, "names"))
    return (
        out.join(names.select(F.col("id").alias("at"), "node_key"), "at")
        .join(names.select(F.col("id").alias("to"), F.col("node_key").alias("neighbour_key")), "to")
        .select("depth", "node_key", "neighbour_key", "rel", "way", "confidence")
    )


def shortest_paths(nodes: DataFrame, edges: DataFrame, src: str, dsts: list[str] | None = None, max_depth: int = 4) -> DataFrame:
    """(dst_key, length, path): for every node, or every one of `dsts`, within `max_depth` edges either way its shortest path.

    Of several shortest paths the smallest by node keys is given, so every node carries one path only and a
    level is one join and one minimum, never a list of all paths. A path from a node to itself is the
    shortest cycle through it. The walk is on ids; the ends of the edges and each level are written once, and a level's
    keys are looked up for its nodes only. It ends where nothing new, or nothing more of `dsts`, is found.
    """
    keys = nodes.select("id", "node_key")
    steps = kept(_both_ways(edges.select("src", "dst")).select("at", "to"), "steps")
    start = keys.where(F.col("node_key") == src)
    level = start.select(F.col("id").alias("at"), F.array("node_key").alias("path"))
    asked = None if dsts is None else keys.where(F.col("node_key").isin(*dsts)).count()
    found = None
    for length in range(1, max_depth + 1):
        grown = level.join(steps, "at").groupBy(F.col("to").alias("id")).agg(F.min("path").alias("path"))
        if found is not None:
            grown = grown.join(found.select("id"), "id", "left_anti")
        grown = grown.join(keys, "id").select("id", "node_key", F.lit(length).alias("length"), F.array_append("path", F.col("node_key")).alias("path"))
        grown = kept(grown, "level")
        found = grown if found is None else found.unionByName(grown)
        if grown.isEmpty() or (asked is not None and found.where(F.col("node_key").isin(*dsts)).count() == asked):
            break
        level = grown.where(F.col("node_key") != src).select(F.col("id").alias("at"), "path")
    out = found.select(F.col("node_key").alias("dst_key"), "length", "path")
    return out.where(F.col("dst_key").isin(*dsts)) if dsts is not None else out


def path(nodes: DataFrame, edges: DataFrame, src: str, dst: str, max_depth: int = 4) -> list[str] | None:
    """The shortest path between two nodes, or None."""
    found = shortest_paths(nodes, edges, src, [dst], max_depth).select("path").first()
    return list(found["path"]) if found else None


def bridges(nodes: DataFrame, edges: DataFrame, src: str, dsts: list[str], max_depth: int = 4, cap: int = 20) -> dict:
    """Paths from one node to many, those out of reach, and whether the list of targets was cut."""
    asked = list(dict.fromkeys(dsts))[:cap]
    found = {r["dst_key"]: list(r["path"]) for r in shortest_paths(nodes, edges, src, asked, max_depth).collect()}
    return {"paths": [found[d] for d in asked if d in found], "unreachable": [d for d in asked if d not in found], "truncated": len(set(dsts)) > cap}


def neighbourhood(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(way, rel, node_key, derived) of one node's edges; derived: not certain."""
    around = neighbours(nodes, edges, key, 1)
    return around.select("way", "rel", F.col("neighbour_key").alias("node_key"), (F.col("confidence") < 1.0).alias("derived"))


def isolated_share(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(nodes, isolated, share): of nodes of `kinds`, those without an edge among them; share in percent, one decimal."""
    own = nodes.where(F.col("kind").isin(*kinds))
    inner = within(edges, own).where("src <> dst")
    touched = inner.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("touched", F.lit(1))
    return own.join(touched, "id", "left").agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("touched").isNull(), 1).otherwise(0)).alias("isolated")).withColumn(
        "share", F.round(F.when(F.col("nodes") > 0, 100.0 * F.col("isolated") / F.col("nodes")).otherwise(0.0), 1)
    )


def parallel_edges(edges: DataFrame) -> DataFrame:
    """(links, pairs, parallel): edges beyond the first between the same two nodes."""
    return edges.agg(F.count("*").alias("links"), F.count_distinct(F.struct("src", "dst")).alias("pairs")).withColumn("parallel", F.col("links") - F.col("pairs"))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges, once each, by sorted ends."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "rel").distinct()


def page(nodes: DataFrame, edges: DataFrame, limit: int, by: str = "model", least: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first `limit` nodes of each model by key, of at least degree `least`, and the edges between them."""
    if least:
        nodes, edges = min_degree(nodes, edges, least)
    first = nodes.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy("node_key"))).where(F.col("__n") <= limit).drop("__n")
    return first, within(edges, first)
