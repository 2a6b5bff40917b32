"""Full-text ranking against SQLite's own, vectors and fusion against worked examples."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from spindle.errors import EmbeddingRefused, Refused
from spindle.functions.embed import StaticEmbedder, embed_store, from_config, from_locator, split_one
from spindle.operators import search
from spindle.plans.mesh import fused, moved
from spindle.store import Store, as_nodes

TEXTS = [
    ("Token Budget", "the budget of a token is scaled by the index"), ("Vector Index", "an index of vectors; the_index is built once, the index twice"),
    ("Ünïcode", "høst und über snake_case index"), ("", "snake case without a line"), (None, None), ("Index", "index index index"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(i, f"k{i}", "file", None, None, t, b, "2026-01-01") for i, (t, b) in enumerate(TEXTS, 1)]
    return spark.createDataFrame(rows, "id long, node_key string, kind string, subtype string, path string, title string, body string, first_seen string").cache()


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, body, tokenize='unicode61')")
    db.executemany("insert into f(rowid, title, body) values (?, coalesce(?, ''), coalesce(?, ''))", [(i, *x) for i, x in enumerate(TEXTS, 1)])
    return db


@pytest.mark.parametrize("op", ["AND", "OR"])
@pytest.mark.parametrize("query", ["index", "the index", "snake_case", "unicode uber", "budget budget index", "nothing here", "HØST"])
def test_ranking_equals_sqlite(nodes, fts, query, op):
    import re

    quoted = f" {op} ".join(f'"{t}"' for t in re.findall(r"\w+", query))
    want = dict(fts.execute("select rowid, bm25(f) from f where f match ?", (quoted,)).fetchall())
    got = {r["node_id"]: r["score"] for r in search.bm25(search.Index.of(nodes), query, op).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_a_query_without_a_term_does_not_run(nodes):
    assert search.bm25(search.Index.of(nodes), "!?") is None
    assert search.hybrid(search.Index.of(nodes), nodes, "...").rows is None


def test_hidden_subtypes(nodes):
    hidden = nodes.withColumn("subtype", F.when(F.col("id") == 6, "transcript"))
    index = search.Index.of(hidden)
    assert 6 not in [r["node_id"] for r in search.full_text(index, hidden, "index").collect()]
    assert 6 in [r["node_id"] for r in search.full_text(index, hidden, "index", include_all=True).collect()]


def test_stale_and_orphans(nodes):
    index = search.Index.of(nodes)
    assert not index.stale(nodes) and index.stale(nodes.where("id < 6"))
    assert [r[0] for r in index.orphans(nodes.where("id < 6")).collect()] == [6]


MATRIX = {"provider": "static", "model": "m", "dim": 3, "tokens": ["query", "index", "retrieval", "search", "ranking", "onion"], "matrix": [[1, 0, 0]] * 5 + [[0, 1, 0]]}


@pytest.fixture
def embedder(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MATRIX))
    return StaticEmbedder(str(tmp_path / "m.json"))


def test_vectors_find_the_target_before_the_decoy(spark, embedder):
    rows = [("target.md", "file", "retrieval search ranking"), ("decoy.md", "file", "query index onion"), ("zero.md", "file", "search ranking")]
    store = Store.empty(spark, "m3").having(nodes=as_nodes(spark.createDataFrame(rows, "node_key string, kind string, body string"), "2026-01-01"))
    store, done, zero = embed_store(store, embedder)
    assert (done, zero) == (3, 0)
    index, text = store.index(), "query index retrieval"
    assert search.full_text(index, store.nodes, text).count() == 0
    assert [r["node_key"] for r in search.shortlist(index, store.nodes, text).collect()] == ["decoy.md", "target.md"]
    got = search.vector_search(index, store.nodes, store.embeddings, embedder, text).collect()
    assert [(r["node_key"], round(r["score"], 3)) for r in got] == [("target.md", 1.0), ("decoy.md", 0.894)]
    assert search.vector_search(index, store.nodes, None, embedder, text) is None
    with pytest.raises(EmbeddingRefused):
        search.vector_search(index, store.nodes, store.embeddings, None, text)
    with pytest.raises(EmbeddingRefused):
        store.with_embeddings(store.embeddings.select("node_id", F.array(F.lit(1.0)).alias("vec")), embedder.namespace)
    assert search.hybrid(index, store.nodes, text, embeddings=store.embeddings, embedder=embedder).mode == "hybrid"
    assert embed_store(store, embedder)[1] == 0


def test_embedder_refusals(tmp_path):
    for wrong in ({"dim": 0}, {"tokens": []}, {"tokens": ["a"] * 6}, {"matrix": [[1, 0, 0]]}, {"matrix": [[1]] * 6}, {"weights": [1]}):
        (tmp_path / "x.json").write_text(json.dumps(MATRIX | wrong))
        with pytest.raises(EmbeddingRefused):
            StaticEmbedder(str(tmp_path / "x.json"))
    for locator in ("static:", "openai:x", "ollama:a b"):
        with pytest.raises(EmbeddingRefused):
            from_locator(locator)
    with pytest.raises(EmbeddingRefused):
        from_config({"provider": "static"})
    assert from_config(None) is None


def test_identifier_parts():
    assert split_one("camelCase HTMLParser snake_case kebab-case a.b") == ["camel", "case", "html", "parser", "snake", "case", "kebab", "case", "a", "b"]


def test_fusion(spark):
    ranks = spark.createDataFrame([("m1", 1, "P"), ("m1", 2, "Q"), ("m3", 1, "Q"), ("m3", 2, "P"), ("m3", 3, "R")], "model string, rank int, fusion string").withColumn("node_key", F.col("fusion"))
    degree = spark.createDataFrame([("P", 0), ("Q", 2), ("Q", 4), ("R", 99), ("D", 99)], "fusion string, degree long")
    plain, ranked = fused(ranks).collect(), fused(ranks, degree).collect()
    assert [(r["fusion"], round(r["score"], 6)) for r in plain] == [("P", 0.032522), ("Q", 0.032522), ("R", 0.015873)]
    assert [(r["fusion"], r["degree"]) for r in ranked] == [("Q", 4), ("P", 0), ("R", 99)]
    assert moved([r["fusion"] for r in ranked], [r["fusion"] for r in plain]) == 2
    two = search.rrf([("fts", spark.createDataFrame([(1, 1), (2, 2)], "node_id long, rank int")), ("vector", spark.createDataFrame([(2, 1), (3, 2)], "node_id long, rank int"))]).collect()
    assert [r["node_id"] for r in two] == [2, 1, 3] and two[0]["sources"] == ["fts#2", "vector#1"]


def test_recall(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("b", 3, 2), ("c", 9, 3)], "query string, rank int, node_id long")
    pairs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 7)], "query string, expected long")
    row = search.recall(ranked, pairs, (1, 5)).first()
    assert (round(row["r1"], 6), round(row["r5"], 6), round(row["mrr"], 6)) == (0.333333, 0.666667, 0.444444)
    with pytest.raises(Refused):
        search.recall(ranked, pairs.limit(0))
