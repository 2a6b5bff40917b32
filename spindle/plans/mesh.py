"""Federation: stores of several models as one graph, with relations between them and one search over all."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelUnavailable
from ..functions.paths import basename, normalise
from ..operators import derive, search
from ..operators.graph import degrees
from ..operators.state import embedding_status, node_states
from ..store import Store, as_edges, as_nodes

TEXT_MODELS = ("m1", "m3")


def mirrored(models: dict[str, Store]) -> DataFrame:
    """Nodes of all models that have a path, keyed `model::key`."""
    out = None
    for name, s in sorted(models.items()):
        own = s.nodes.where("path is not null").withColumn("model", F.lit(name)).withColumn("node_key", F.concat(F.lit(f"{name}::"), "node_key"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ModelUnavailable("no model is there")
    return out


def build_mesh(spark: SparkSession, models: dict[str, Store], as_of: str, root: str, code: DataFrame | None = None, commits: DataFrame | None = None, prune_from: Store | None = None, expected: tuple[str, ...] = ()) -> tuple[Store, list[str]]:
    """The mesh store and what was left out. code: (path) of code files, None if nobody asked; commits: (sha, path) of a history.

    Pruning drops what no model mirrors any longer; with a model or the code list missing it is refused before anything is written.
    """
    missing = sorted(set(expected) - set(models))
    if prune_from is not None and (missing or (code is None and not prune_from.nodes.where("kind = 'code'").limit(1).isEmpty())):
        raise ModelUnavailable("can't prune: " + (f"{', '.join(missing)} not there" if missing else "the code files were not listed"))
    notes = [f"{m} not there" for m in missing]
    every = mirrored(models)
    if code is not None:
        stubs = code.select(F.concat(F.lit("code::"), "path").alias("node_key"), F.lit("code").alias("kind"), "path", basename(F.col("path")).alias("title"))
        every = every.unionByName(stubs.withColumn("model", F.lit("code")), allowMissingColumns=True)
    texts = every.where(F.col("model").isin(*TEXT_MODELS) & F.col("kind").isin("file", "document") & F.col("body").isNotNull())
    rows = [derive.mentions_file(every), derive.cohorts(every.select("node_key", "model", "datelist_int", F.col("datelist_anchor").alias("anchor")))]
    if "m2" in models:
        rows.append(derive.figures_for(texts, every.where("model = 'm2' and kind = 'image'")))
    if code is not None:
        rows.append(derive.cites_code(texts, every.where("model = 'code'"), root))
    else:
        notes.append("code files were not listed")
    if commits is not None:
        pairs = derive.co_changes(commits)
        rows.append(derive.co_changed(pairs, every.where("kind in ('file', 'document', 'image')").select("node_key", normalise(F.col("path")).alias("path"))))
    derived = rows[0]
    for r in rows[1:]:
        derived = derived.unionByName(r)
    within = None
    for name, s in sorted(models.items()):
        keys = s.nodes.where("path is not null").select("id", F.concat(F.lit(f"{name}::"), "node_key").alias("k"))
        own = s.edges.join(keys.select(F.col("id").alias("src"), F.col("k").alias("src_key")), "src").join(keys.select(F.col("id").alias("dst"), F.col("k").alias("dst_key")), "dst").select("src_key", "dst_key", "rel", "method")
        within = own if within is None else within.unionByName(own)
    nodes = as_nodes(every.drop("id", "first_seen", "last_seen", "body"), as_of)
    return Store.empty(spark, "m5").having(nodes=nodes, edges=as_edges(derived.unionByName(within), nodes, as_of)), notes


def fusion_key() -> Column:
    """What makes two hits one: the content, except for sections; else the path; else the model and key."""
    return F.when(F.col("content_hash").isNotNull() & (F.col("kind") != "section"), F.concat(F.lit("hash:"), "content_hash")).when(
        F.col("path").isNotNull() & (F.col("kind") != "section"), F.concat(F.lit("path:"), normalise(F.col("path")))
    ).otherwise(F.concat(F.lit("key:"), "model", F.lit("::"), "node_key"))


def fused(rankings: DataFrame, degree: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """rankings: (model, rank, fusion, node_key[, ...]). (fusion, score, degree, node_key, sources), by score, then degree, then key.

    Scores add up in order of models, so equal scores are equal exactly. degree: (fusion, degree) of candidates, the largest counting; null without a mesh.
    """
    seen = F.array_sort(F.collect_list(F.struct("model", "rank", "node_key")))
    rows = rankings.groupBy("fusion").agg(seen.alias("seen"))
    rows = rows.select(
        "fusion", F.aggregate("seen", F.lit(0.0), lambda a, x: a + F.lit(1.0) / (search.RRF_K + x["rank"])).alias("score"),
        F.element_at("seen", 1)["node_key"].alias("node_key"), F.transform("seen", lambda x: F.concat(x["model"], F.lit("#"), x["rank"])).alias("sources"),
    )
    if degree is None:
        rows = rows.withColumn("degree", F.lit(None).cast("long"))
    else:
        most = degree.groupBy("fusion").agg(F.max("degree").alias("degree"))
        rows = rows.join(most, "fusion", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ordered = rows.orderBy(F.desc("score"), F.coalesce(-F.col("degree"), F.lit(0)), "fusion")
    return ordered.limit(limit) if limit else ordered


def moved(with_degree: list[str], without: list[str]) -> int:
    """Positions at which a tie-break changed the order."""
    return sum(a != b for a, b in zip(with_degree, without, strict=True))


@dataclass
class MeshResult:
    status: str
    rows: DataFrame | None
    warnings: list[str] = field(default_factory=list)
    moved: int = 0


def mesh_search(models: dict[str, Store], text: str, limit: int = 10, mesh: Store | None = None, disk: DataFrame | None = None, expected: tuple[str, ...] = (), include_all: bool = False, as_of: str | None = None, code: bool = True) -> MeshResult:
    """The best of every model's full-text search, fused; with the state of each hit's file if `disk` (path, size, mtime) is given."""
    missing = sorted(set(expected) - set(models))
    warnings = [f"{m} is not there" for m in missing]
    ranked, info = None, None

    def put(model: str, store: Store, found: DataFrame | None, keep: Column | None = None):
        nonlocal ranked, info
        if found is None:
            return
        own = store.nodes.select(F.col("id").alias("node_id"), "kind", "path", "content_hash").join(F.broadcast(found), "node_id").withColumn("model", F.lit(model)).withColumn("fusion", fusion_key())
        own = own.select("model", "rank", "fusion", F.concat(F.lit(f"{model}::") if model != "code" else F.lit(""), "node_key").alias("node_key"), "node_id", "title", "path")
        ranked = own if ranked is None else ranked.unionByName(own)

    for name, s in sorted(models.items()):
        put(name, s, search.full_text(s.index(), s.nodes, text, limit, include_all=include_all, as_of=as_of))
    if code:
        if mesh is None:
            warnings.append("code files were not searched: there is no mesh")
        else:
            stubs = mesh.nodes.where("kind = 'code'")
            if stubs.limit(1).isEmpty():
                warnings.append("the mesh lists no code files")
            else:
                put("code", mesh.having(nodes=stubs), search.full_text(search.Index.of(stubs), stubs, text, limit))
    if ranked is None:
        return MeshResult("partial" if missing else "complete", None, warnings)
    degree = None
    if mesh is not None:
        by_key = degrees(mesh.edges).join(mesh.nodes.select("id", "node_key"), "id").select("node_key", "degree")
        degree = ranked.select("fusion", "node_key").join(by_key, "node_key").select("fusion", "degree")
    best = fused(ranked, degree, limit)
    plain = [r["fusion"] for r in fused(ranked, None, limit).select("fusion").collect()]
    order = [r["fusion"] for r in best.select("fusion").collect()]
    shown = best.join(ranked.groupBy("node_key").agg(F.first("title").alias("title"), F.first("path").alias("path")), "node_key")
    if disk is not None:
        for name, s in models.items():
            hits = shown.where(F.col("node_key").startswith(f"{name}::"))
            if hits.limit(1).isEmpty():
                continue
            own = s.nodes.join(hits.select(F.substring("node_key", len(name) + 3, 1 << 30).alias("node_key")), "node_key", "left_semi")
            states = node_states(own, disk)
            one = states.join(embedding_status(own, states, s.embeddings), "id", "left").select(F.concat(F.lit(f"{name}::"), "node_key").alias("node_key"), "state", "embedding_status")
            info = one if info is None else info.unionByName(one)
        if info is not None:
            shown = shown.join(info, "node_key", "left")
            counts = {r["state"]: r["count"] for r in shown.where("state in ('stale', 'missing')").groupBy("state").count().collect()}
            if counts:
                warnings.append(" + ".join(f"{n} {s}" for s, n in sorted(counts.items(), reverse=True)) + f" among {len(order)} hits")
    return MeshResult("partial" if missing else "complete", shown.orderBy(F.desc("score"), F.coalesce(-F.col("degree"), F.lit(0)), "fusion"), warnings, moved(order, plain) if len(order) == len(plain) else 0)


def explain(models: dict[str, Store], text: str, limit: int = 10) -> dict[str, DataFrame | None]:
    """Every model's own hits."""
    return {name: search.full_text(s.index(), s.nodes, text, limit) for name, s in models.items()}


def corpus_states(models: dict[str, Store], disk: DataFrame) -> DataFrame:
    """(model, state, n)."""
    out = None
    for name, s in sorted(models.items()):
        own = node_states(s.nodes, disk).groupBy("state").agg(F.count("*").alias("n")).select(F.lit(name).alias("model"), "state", "n")
        out = own if out is None else out.unionByName(own)
    return out
