"""Named queries over small tables of odd rows, against their SQL in DuckDB."""

import pytest

from spindle import workload, workload_more  # noqa: F401  the second adds queries to the first
from spindle.operators import derive, search

duckdb = pytest.importorskip("duckdb")


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables, given as (rows, schema), and compares a query over them with its SQL."""

    def check(name, **tables):
        db = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            db.execute(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        order = lambda rows: sorted(map(tuple, rows), key=repr)
        got = order(workload.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == order(db.execute(workload.SQL[name]).fetchall())
        return got

    return check


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def test_documents_without_a_text_are_not_missing(same):
    docs = [(1, "a", "en", "s", 1), (2, "", "en", "s", 0), (3, None, "en", "s", 0), (4, " ", "en", None, 1), (5, "b", "en", "s", 1), (None, "c", "en", "s", 1)], DOCUMENTS
    vec = lambda *rows: ([(i, [1.0], n) for i, n in rows], VECTORS)
    assert same("embed_missing_anti", documents=docs, embeddings=vec((5, 1), (1, 7))) == [(1,), (4,)]
    assert same("embed_missing_anti", documents=docs, embeddings=vec((5, 1), (None, 2))) == []
    assert len(same("embed_missing_anti", documents=docs, embeddings=vec((5, 7)))) == 4


@pytest.mark.parametrize("name", ["fts_and", "fts_or", "fts_phrase", "fts_hidden_subtype", "shortlist_candidates", "fts_topk", "bm25_stats"])
def test_searches_over_odd_texts(same, name):
    long = "of the " * 700 + "de que enes of " * 300
    docs = [(1, "the Enes inor, OF THE of the", "en", "eaux"), (2, "", "en", "de que"), (3, None, None, None), (4, long, "es", "of the"), (5, long, "en", "the of"), (6, "of\nthe d'Énes ... eaux", None, "s"), (7, "de_que ÉNES", "en", "de"), (8, "inor the enes", "en", None)]
    docs += [(100 + i, f"w{i} " * (i % 5) + "de que the inor enes", "en", "s") for i in range(1200)]
    same(name, documents=([(*x, 0) for x in docs], DOCUMENTS))


def test_ids_of_several_documents_count_once(same):
    docs = [(1, "a b a", "en", "s", 0), (1, "a c", "en", "s", 0), (2, "a", "en", "s", 0), (None, "a", "en", "s", 0), (None, "a d", "en", "s", 0)]
    assert same("bm25_stats", documents=(docs, DOCUMENTS))[0][2] == 9


def test_an_index_is_made_without_a_shuffle(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, "t", " ".join(f"w{(i * 7 + k) % 11}" for k in range(9))) for i in range(50)], "id long, title string, body string")
    made = search.postings(nodes)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = sorted((r["id"], c, t, [k for k, x in enumerate(words) if x == t]) for r in nodes.collect() for c in ("title", "body") for words in [r[c].split()] for t in set(words))
    assert sorted(map(tuple, made.collect())) == want
    monkeypatch.setattr(search, "RUN_TERMS", 1)
    batches = nodes.coalesce(1)
    runs = list(search._grouped(iter(search._tokens(batches).toArrow().to_batches() * 2)))
    assert all(r["term"].to_pylist() == sorted(r["term"].to_pylist()) for r in runs) and sum(r.num_rows for r in runs) == 2 * len(want)


def test_the_parts_of_co_change_follow_the_rows(spark, monkeypatch):
    """What one task holds doesn't grow with the input, whatever the number of shuffle partitions."""
    rows = [(c, p) for c in range(60) for p in range(12) if (c * p) % 5 < 3] * 2
    commits = spark.createDataFrame(rows, "sha long, path long").cache()
    whole = sorted(map(tuple, derive.co_changes(commits).collect()))
    monkeypatch.setattr(derive, "PART_ROWS", 100)
    split = derive.co_changes(commits)
    parts = -(-len(rows) // 100)
    assert whole and split.rdd.getNumPartitions() == 2 * parts > 12 and sorted(map(tuple, split.collect())) == whole
    files = {}
    for c, p in set(rows):
        files.setdefault(p, set()).add(c)
    assert whole == sorted((a, b, len(x & y), len(x | y)) for a, x in files.items() for b, y in files.items() if a < b and len(x & y) >= 3)
    assert derive.co_changes(commits.limit(0)).count() == 0
