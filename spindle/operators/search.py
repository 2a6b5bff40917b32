"""Lexical, vector and hybrid search over an inverted index kept as a table.

The index has one row for each node, field and term, with the term's positions. It is written in runs that are sorted by term,
so that a query reads the pages of its terms in each run; making it shuffles nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import EmbeddingRefused, Refused
from ..functions.text import query_phrases, terms
from ..functions.vectors import cosine
from ..schema import HIDDEN_SUBTYPES
from ..shared import small

# Ranking constants, the fusion constant and the size of a shortlist.
FIELDS = ["title", "body"]
K1, B, RRF_K, SHORTLIST_TIMES, SHORTLIST_LEAST = 1.2, 0.75, 60, 5, 50


#: Terms that are put in order at once when postings are made.
RUN_TERMS = 2_000_000


def _tokens(nodes: DataFrame) -> DataFrame:
    """(node_id, title, body): the terms of both fields."""
    return nodes.select(F.col("id").alias("node_id"), *[terms(F.col(c)).alias(c) for c in FIELDS])


def _run(ids: pa.Array, fields: list[pa.Array]) -> pa.RecordBatch:
    """The postings of some nodes in order of term, node and field; positions ascend."""
    col = np.repeat(np.arange(len(fields), dtype=np.int8), [len(f.values) for f in fields])
    counts = [np.diff(f.offsets.to_numpy()) for f in fields]
    node = np.concatenate([np.repeat(np.arange(len(c), dtype=np.int32), c) for c in counts])
    pos = np.concatenate([np.arange(len(f.values), dtype=np.int32) - np.repeat(f.offsets.to_numpy()[:-1], c).astype(np.int32) for f, c in zip(fields, counts, strict=True)])
    coded = pa.chunked_array([f.values for f in fields]).combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    key = (rank[coded.indices.to_numpy()] * len(ids) + node) * len(fields) + col
    order = np.argsort(key, kind="stable")  # positions are in order before
    key = key[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    first = order[starts]
    found = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(pos[order]))
    names = pa.array(FIELDS).take(pa.array(col[first]))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(node[first])), names, coded.dictionary.take(coded.indices.take(pa.array(first))), found], names=["node_id", "col", "term", "positions"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (node_id, title, body) of terms -> their postings, a run of some RUN_TERMS terms at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        fields = [whole.column(c).combine_chunks() for c in FIELDS]
        return _run(whole.column("node_id").combine_chunks(), [f.take(pa.array(np.arange(len(f)))) for f in fields])

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held.append(part)
            size += sum(len(part.column(c).flatten()) for c in FIELDS)
            if size >= RUN_TERMS:
                yield run()
                held, size = [], 0
    if held:
        yield run()


def postings(nodes: DataFrame) -> DataFrame:
    """(node_id, col, term, positions) of titles and bodies, one row for each node's row, field and term.

    A node's postings follow from its own row, so nothing is shuffled: each task puts those of some millions of terms in order at a time.
    """
    kind = dict(nodes.dtypes)["id"]
    return _tokens(nodes).mapInArrow(_grouped, f"node_id {kind}, col string, term string, positions array<int>")


def lengths(nodes: DataFrame) -> DataFrame:
    """(node_id, len): terms of title and body."""
    return nodes.select(F.col("id").alias("node_id"), (F.size(terms(F.col("title"))) + F.size(terms(F.col("body")))).cast("long").alias("len"))


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    summed: DataFrame | None = None

    @classmethod
    def of(cls, nodes: DataFrame) -> Index:
        return cls(postings(nodes), lengths(nodes))

    def write(self, path: str) -> Index:
        """Postings in runs sorted by term, so that a query reads the pages of its terms only, lengths by node, and the totals."""
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        spark = self.postings.sparkSession
        lengths = spark.read.parquet(f"{path}/lengths")
        lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).write.mode("overwrite").parquet(f"{path}/totals")
        return Index.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/totals"))

    @cached_property
    def totals(self) -> tuple[int, float]:
        """Number of nodes and mean length."""
        row = (self.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")) if self.summed is None else self.summed).first()
        return row["n"], row["avg"] or 0.0

    def stale(self, nodes: DataFrame) -> bool:
        """Whether the index has other nodes than the store."""
        ids = nodes.select(F.col("id").alias("node_id"))
        return not (self.lengths.join(ids, "node_id", "left_anti").limit(1).isEmpty() and ids.join(self.lengths, "node_id", "left_anti").limit(1).isEmpty())

    def counted(self) -> DataFrame:
        """One row (postings, terms): the distinct (node, field, term) and terms. Postings are distinct but for those of ids that several nodes have."""
        kinds = self.postings.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))
        shared = self.lengths.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")
        if shared.limit(1).isEmpty():
            return kinds
        held = self.postings.join(small(shared.select(F.col("node_id").alias("id"))), F.col("node_id").eqNullSafe(F.col("id")), "left_semi")
        more = held.groupBy("node_id", "col", "term").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("more"))
        return kinds.crossJoin(more).select((F.col("postings") - F.col("more")).alias("postings"), "terms")

    def orphans(self, nodes: DataFrame) -> DataFrame:
        """Index rows without a node."""
        return self.lengths.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("node_id")


def phrase_hits(index: Index, phrase: list[str]) -> DataFrame:
    """(node_id, f): occurrences of a phrase, its terms next to each other in one field."""
    own = index.postings.where(F.col("term").isin(*set(phrase)))
    if len(phrase) == 1:
        return own.groupBy("node_id").agg(F.sum(F.size("positions")).cast("long").alias("f"))
    kinds = list(dict.fromkeys(phrase))
    by_term = own.groupBy("node_id", "col").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions")))).alias(f"t{i}") for i, t in enumerate(kinds)])
    met = reduce(F.array_intersect, [_shift(f"t{kinds.index(t)}", i) for i, t in enumerate(phrase)])
    return by_term.select("node_id", F.size(met).alias("f")).groupBy("node_id").agg(F.sum("f").cast("long").alias("f")).where("f > 0")


def _shift(positions: str, i: int) -> Column:
    return F.transform(positions, lambda p: p - F.lit(i))


def _phrase_rows(index: Index, phrases: list[list[str]]) -> DataFrame:
    """(node_id, phrase, times, f) for every phrase of a query that a node has; times: how often the query repeats it."""
    counts = Counter(tuple(p) for p in phrases)
    singles = {p[0]: n for p, n in counts.items() if len(p) == 1}
    rows = None
    if singles:
        times = F.create_map(*[F.lit(x) for t, n in singles.items() for x in (t, n)])
        own = index.postings.where(F.col("term").isin(*singles))
        rows = own.groupBy("node_id", F.col("term").alias("phrase")).agg(F.sum(F.size("positions")).cast("long").alias("f")).select("node_id", "phrase", F.element_at(times, F.col("phrase")).alias("times"), "f")
    for p, n in counts.items():
        if len(p) > 1:
            more = phrase_hits(index, list(p)).select("node_id", F.lit(" ".join(p)).alias("phrase"), F.lit(n).alias("times"), "f")
            rows = more if rows is None else rows.unionByName(more)
    return rows


def bm25(index: Index, text: str, op: str = "AND") -> DataFrame | None:
    """(node_id, score): better is more negative. AND: nodes with every phrase; OR: with any. None for a query without a term."""
    if op not in ("AND", "OR"):
        raise Refused(f"no operator {op!r}; there are AND and OR")
    phrases = query_phrases(text)
    if not phrases:
        return None
    rows = _phrase_rows(index, phrases)
    n, mean = index.totals
    having = {r["phrase"]: r["n"] for r in rows.groupBy("phrase").agg(F.count("*").alias("n")).collect()}  # a row for each phrase of the query
    distinct = len({tuple(p) for p in phrases})
    if not having or (op == "AND" and len(having) < distinct):
        return rows.select("node_id", F.lit(0.0).alias("score")).limit(0)
    idf = {p: max(math.log((n - k + 0.5) / (k + 0.5)), 1e-6) for p, k in having.items()}
    weight = F.element_at(F.create_map(*[F.lit(x) for p, v in idf.items() for x in (p, v)]), F.col("phrase"))
    part = weight * F.col("times") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / mean))
    scored = rows.join(index.lengths, "node_id").withColumn("part", part)
    # The sum's order is fixed by the phrase, so that equal scores are equal to the last bit.
    ordered = F.aggregate(F.array_sort(F.collect_list(F.struct("phrase", "part"))), F.lit(0.0), lambda a, x: a + x.part)
    found = scored.groupBy("node_id").agg((-ordered).alias("score"), F.count("*").alias("n"))
    return (found.where(F.col("n") == distinct) if op == "AND" else found).select("node_id", "score")


def shown(nodes: DataFrame, include_all: bool = False, subtype: str | None = None, as_of: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes that a search shows: hidden subtypes only on request; `as_of` takes what was first seen by then."""
    if not include_all:
        nodes = nodes.where(F.col("subtype").isNull() | ~F.col("subtype").isin(*HIDDEN_SUBTYPES))
    for name, value in (("subtype", subtype), ("kind", kind)):
        nodes = nodes.where(F.col(name) == value) if value is not None else nodes
    return nodes.where(F.col("first_seen") <= as_of) if as_of else nodes


def full_text(index: Index, nodes: DataFrame, text: str, limit: int = 20, op: str = "AND", **what) -> DataFrame | None:
    """(node_id, node_key, title, score, rank): the best `limit` by (score, node_id)."""
    scores = bm25(index, text, op)
    if scores is None:
        return None
    own = shown(nodes, **what).select(F.col("id").alias("node_id"), "node_key", "title")
    best = scores.join(own, "node_id").orderBy("score", "node_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy("score", "node_id")))  # `limit` rows


def shortlist(index: Index, nodes: DataFrame, text: str, limit: int = 20, **what) -> DataFrame | None:
    """The candidates of a vector search: the best max(5 * limit, 50) that have any term."""
    return full_text(index, nodes, text, max(SHORTLIST_TIMES * limit, SHORTLIST_LEAST), "OR", **what)


def in_namespace(embeddings: DataFrame, namespace: tuple[str, str, int]) -> DataFrame:
    provider, model, dim = namespace
    return embeddings.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dim") == dim))


def vector_search(index: Index, nodes: DataFrame, embeddings: DataFrame | None, embedder, text: str, limit: int = 20, **what) -> DataFrame | None:
    """The shortlist ranked by cosine with the query, ties as in the shortlist; never a scan of all vectors.

    None: embeddings are off or nothing is embedded in the namespace. Empty: nothing overlaps. An absent embedder
    with embeddings present is refused.
    """
    if embeddings is None:
        return None
    if embedder is None:
        raise EmbeddingRefused("embeddings are configured but there is no embedder")
    own = in_namespace(embeddings, embedder.namespace)
    if own.limit(1).isEmpty():
        return None
    near = shortlist(index, nodes, text, limit, **what)
    if near is None:
        return own.limit(0).select("node_id", F.lit("").alias("node_key"), F.lit("").alias("title"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    query = F.array(*[F.lit(float(x)) for x in embedder.embed(text)])
    scored = F.broadcast(near.withColumnRenamed("rank", "at").drop("score")).join(own.select("node_id", "vec"), "node_id").withColumn("score", cosine(F.col("vec"), query))
    best = scored.orderBy(F.desc("score"), "at").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "at"))).select("node_id", "node_key", "title", "score", "rank")


def nearest(embeddings: DataFrame, query: list[float], limit: int = 20, within: DataFrame | None = None) -> DataFrame:
    """(node_id, score): the best `limit` by cosine, of all vectors or of those of `within`."""
    own = embeddings if within is None else embeddings.join(within.select("node_id"), "node_id", "left_semi")
    return own.select("node_id", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)


def rrf(rankings: list[tuple[str, DataFrame]], key: str = "node_id", limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """(key, score, sources): reciprocal rank fusion of rankings (key, rank), in the order given.

    Scores add up in that order, so ties are exact; they go to what the earlier ranking ranks higher.
    """
    rows = None
    for i, (name, df) in enumerate(rankings):
        own = df.select(F.col(key), F.lit(i).alias("i"), F.lit(name).alias("name"), F.col("rank").cast("int").alias("rank"))
        rows = own if rows is None else rows.union(own)
    seen = F.array_sort(F.collect_list(F.struct("i", "rank", "name")))
    fused = rows.groupBy(key).agg(seen.alias("seen"))
    fused = fused.select(
        key, F.aggregate("seen", F.lit(0.0), lambda a, x: a + F.lit(1.0) / (k + x.rank)).alias("score"),
        F.transform("seen", lambda x: F.concat(x["name"], F.lit("#"), x["rank"])).alias("sources"), F.element_at("seen", 1).alias("first"),
    )
    ordered = fused.orderBy(F.desc("score"), "first.i", "first.rank", key)
    return (ordered.limit(limit) if limit else ordered).select(key, "score", "sources")


@dataclass
class Found:
    """rows is None if the search did not run; an empty frame if it ran and found nothing."""

    mode: str
    rows: DataFrame | None
    warnings: list[str] = field(default_factory=list)


def hybrid(index: Index, nodes: DataFrame, text: str, limit: int = 20, mode: str = "auto", embeddings: DataFrame | None = None, embedder=None, **what) -> Found:
    """auto: lexical and, where there are vectors, both fused; fts: lexical; vector: vectors only, without falling back."""
    if mode not in ("auto", "fts", "vector"):
        raise Refused(f"no mode {mode!r}; there are auto, fts and vector")
    warnings = []
    if not what.get("include_all"):
        warnings.append("hidden subtypes are left out: " + ", ".join(HIDDEN_SUBTYPES))
    if index.stale(nodes):
        warnings.append("the index is not of this state of the store")
    vector = None
    if mode != "fts":
        vector = vector_search(index, nodes, embeddings, embedder, text, limit, **what)
        if vector is None:
            warnings.append("embeddings are off" if embeddings is None else "nothing is embedded in this namespace")
    if mode == "vector":
        return Found("vector", vector, warnings)
    lexical = full_text(index, nodes, text, limit, **what)
    if vector is None or lexical is None:
        return Found("fts", lexical, warnings)
    fused = rrf([("fts", lexical), ("vector", vector)], "node_id", limit)
    return Found("hybrid", fused.join(nodes.select(F.col("id").alias("node_id"), "node_key", "title"), "node_id"), warnings)


def coverage(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(provider, model, dim, embedded, nodes_with_text, stale): what each namespace covers."""
    texts = nodes.where("coalesce(title, '') <> '' or coalesce(body, '') <> ''").count()
    return embeddings.groupBy("provider", "model", "dim").agg(F.count("*").alias("embedded")).select("*", F.lit(texts).alias("nodes_with_text"), (F.col("embedded") != texts).alias("stale"))


def missing_embeddings(nodes: DataFrame, embeddings: DataFrame, namespace: tuple[str, str, int]) -> DataFrame:
    """Nodes with text that have no vector in the namespace."""
    done = in_namespace(embeddings, namespace).select(F.col("node_id").alias("id"))
    return nodes.where("coalesce(title, '') <> '' or coalesce(body, '') <> ''").join(done, "id", "left_anti")


def recall(ranked: DataFrame, pairs: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: recall at each k and mean reciprocal rank of `pairs` (query, expected) in `ranked` (query, rank, node_id). No pair is refused."""
    if pairs.limit(1).isEmpty():
        raise Refused("an evaluation needs pairs")
    best = ranked.groupBy("query", "node_id").agg(F.min("rank").alias("rank"))
    met = pairs.join(best, (pairs["query"] == best["query"]) & (pairs["expected"] == best["node_id"]), "left").select("rank")
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"r{k}") for k in ks]
    return met.agg(*hits, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def vocabulary(texts: DataFrame, least: int = 2, limit: int = 50_000) -> DataFrame:
    """(token, n) of a text column `body`, the most frequent first."""
    from ..functions.text import identifier_tokens

    return texts.select(F.explode(identifier_tokens(F.col("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(limit)
