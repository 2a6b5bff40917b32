"""Time, state, derivation."""

import pytest
from pyspark.sql import functions as F

from spindle.functions import dates, keys, paths
from spindle.operators import derive, graph, reports, state, temporal
from spindle.schema import check_method, edge_confidence, node_id

OBS = "node_id long, seen_date string, content_hash string, size long"
DAY = "2026-07-22"


def test_masks(spark):
    days = {1: ["2026-07-22"], 2: ["2026-07-21"], 3: ["2026-06-21"], 4: ["2026-07-22", "2026-07-20"], 5: ["2026-06-20", "2026-06-12"]}
    o = spark.createDataFrame([(n, d, "h", 1) for n, ds in days.items() for d in ds], OBS)
    got = {r["node_id"]: r["datelist_int"] for r in temporal.datelists(o, DAY).collect()}
    assert got == {1: 1, 2: 2, 3: 2**31, 4: 5, 5: 0}
    lists = temporal.datelists(o, DAY)
    back = {r["node_id"]: r["d"] for r in lists.select("node_id", dates.decoded(F.col("datelist_int"), F.lit(DAY)).alias("d")).collect()}
    assert back[4] == ["2026-07-20", "2026-07-22"] and back[3] == ["2026-06-21"] and back[5] == []
    pairs = spark.createDataFrame([(1, 4), (1, 2)], "a long, b long")
    assert {(r["a"], r["b"]): r["days"] for r in temporal.shared_days(pairs, lists).collect()} == {(1, 4): 1, (1, 2): 0}


def test_retention_is_additive_over_days(spark):
    rows = [(1, str(d.date()), f"h{i}", 100 + i) for i, d in enumerate(__import__("pandas").date_range("2026-03-25", periods=120))]
    o = spark.createDataFrame(rows, OBS)
    none = temporal.rolled_up(o.limit(0))
    kept, months = temporal.retained(o, none, DAY)
    assert months.agg(F.sum("change_days")).first()[0] == 120 - kept.count() == 29
    one, first = temporal.retained(o, none, "2026-07-01")
    _, second = temporal.retained(one, first, DAY)
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, months.collect()))


def test_edges_remember(spark):
    def new(rows):
        return spark.createDataFrame(rows, "src long, dst long, rel string, method string, seen string, seq int")

    none = new([]).select("src", "dst", "rel", F.lit("").alias("first_seen"), F.lit("").alias("last_seen"), "method")
    e = state.merged_edges(none, new([(1, 2, "R", "exact", "2026-07-15", 1), (1, 3, "R", "exact", "2026-07-15", 2)]))
    e = state.merged_edges(e, new([(1, 2, "R", "mention", "2026-07-22", 1)]))
    got = {r["dst"]: (r["first_seen"], r["last_seen"], r["method"], r["confidence"]) for r in e.collect()}
    assert got == {2: ("2026-07-15", "2026-07-22", "mention", 0.5), 3: ("2026-07-15", "2026-07-15", "exact", 1.0)}
    assert [r["dst"] for r in graph.alive_on(e, "2026-07-22").collect()] == [2] and graph.alive_on(e, "2026-07-15").count() == 2
    with pytest.raises(Exception, match="unknown edge method"):
        new([(1, 2, "R", "guess", "2026-07-15", 1)]).select(edge_confidence(F.col("method"))).collect()
    with pytest.raises(ValueError, match="unknown method"):
        check_method("guess")


def test_differences_and_states(spark):
    cols = "path string, size long, mtime double, content_hash string"
    old = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 1.0, "x"), ("c", 1, 1.0, "x"), ("d", 1, 1.0, "x"), ("f", 1, 1.0, "x")], cols)
    new = spark.createDataFrame([("a", 1, 1.0 + 1e-9, "x"), ("b", 1, 2.0, "x"), ("c", 2, 2.0, "y"), ("e", 1, 1.0, "x"), ("f", 1, 1.0, None)], cols).withColumn("unreadable", F.col("path") == "f")
    want = {"a": "unchanged", "b": "touched", "c": "changed", "d": "removed", "e": "added", "f": "changed"}
    assert dict(map(tuple, state.differences(old, new).collect())) == want
    assert dict(map(tuple, state.differences(old, new, use_hash=False).collect()))["b"] == "changed"
    nodes = spark.createDataFrame([(1, "a", "a", 1, 1.0), (2, "b", "b", 1, 1.0), (3, "c", "c", 1, 1.0), (4, "d", "d", None, None), (5, "b#2", "b", None, None)], "id long, node_key string, path string, size long, mtime double")
    disk = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("d", 1, 1.0)], "path string, size long, mtime double")
    states = state.node_states(nodes, disk)
    assert {r["node_key"]: r["state"] for r in states.collect()} == {"a": "current", "b": "stale", "c": "missing", "d": "absent", "b#2": "stale"}
    vectors = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    assert {r["id"]: r["embedding_status"] for r in state.embedding_status(nodes, states, vectors).collect()} == {1: "current", 2: "stale", 3: "unknown", 4: "none", 5: "none"}
    assert state.embedding_status(nodes, states, None).first()["embedding_status"] == "off"


def test_walks(spark):
    nodes = spark.createDataFrame([(k, k, "file") for k in "abcdz"], "node_key string, path string, kind string").withColumn("id", node_id(F.col("node_key")))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")], "s string, d string")
    edges = edges.select(node_id(F.col("s")).alias("src"), node_id(F.col("d")).alias("dst"), F.lit("LINKS_TO").alias("rel"), F.lit("exact").alias("method"), F.lit(1.0).alias("confidence"))
    three = edges.join(nodes.where("node_key in ('a', 'b')").select(F.col("id").alias("src")), "src", "left_semi").where(F.col("dst") != node_id(F.lit("d")))
    assert graph.neighbours(nodes, three, "a", 3).count() == 4
    assert graph.path(nodes, edges, "a", "c") == ["a", "b", "c"] and graph.path(nodes, edges, "a", "z") is None
    assert graph.path(nodes, edges, "a", "a") == ["a", "b", "a"]
    assert graph.bridges(nodes, edges, "a", ["c", "z"]) == {"paths": [["a", "b", "c"]], "unreachable": ["z"], "truncated": False}
    assert [r["node_key"] for r in graph.isolated(nodes, edges).collect()] == ["z"]
    assert graph.resolve_key(nodes.select(F.concat(F.lit("m3::"), "node_key").alias("node_key")), "a") == "m3::a"


def test_co_changes(spark):
    commits = {"c0": ["alpha", "beta", "notes"], "c1": ["alpha", "beta", "notes"], "c2": ["alpha", "beta", "notes", "gamma"], "c3": ["alpha", "gamma"], "c4": ["beta", "delta"]}
    df = spark.createDataFrame([(s, p) for s, ps in commits.items() for p in ps], "sha string, path string")
    pairs = derive.co_changes(df)
    assert {(r["a"], r["b"]): (r["shared"], r["union"]) for r in pairs.collect()} == {("alpha", "beta"): (3, 5), ("alpha", "notes"): (3, 4), ("beta", "notes"): (3, 4)}
    nodes = spark.createDataFrame([(p, p) for p in ("alpha", "beta", "gamma", "delta")], "node_key string, path string")
    assert [tuple(r) for r in derive.co_changed(pairs, nodes).collect()] == [("alpha", "beta", "CO_CHANGED_WITH", "co-change")]


def test_cited_code(spark):
    texts = spark.createDataFrame([("n1", "run /r/src/live_runner.js now"), ("n2", "see tool.py."), ("n3", "handler.js and xtool.py and tool.pyc")], "node_key string, body string")
    code = spark.createDataFrame([("c1", "/r/src/live_runner.js"), ("c2", "/r/a/tool.py"), ("c3", "/r/a/handler.js"), ("c4", "/r/b/handler.js"), ("c5", "/r/runner.js")], "node_key string, path string")
    assert sorted((r[0], r[1], r[3]) for r in derive.cites_code(texts, code, "/r").collect()) == [("n1", "c1", "mention"), ("n2", "c2", "basename")]


def test_many_names_meet_bodies_by_their_words(spark, monkeypatch):
    texts = spark.createDataFrame([("n1", "a plot.png and b.gif"), ("n2", "nothing"), ("n3", "")], "node_key string, body string")
    images = spark.createDataFrame([("i1", "/x/plot.png"), ("i2", "/x/b.gif"), ("i3", "/x/zz"), ("i4", "/y/th")], "node_key string, path string")
    few = sorted(map(tuple, derive.figures_for(texts, images).collect()))
    monkeypatch.setattr(derive, "BROADCAST_NAMES", 0)
    assert sorted(map(tuple, derive.figures_for(texts, images).collect())) == few
    assert {(r[0], r[1]) for r in few} == {("n1", "i1"), ("n1", "i2"), ("n2", "i4")}


def test_wikilinks_prefer_the_nearest(spark):
    links = spark.createDataFrame([("wiki/wiki/concepts/t.md", "s"), ("wiki/wiki/concepts/t.md", "gone")], "node_key string, target string")
    pages = spark.createDataFrame([("wiki/raw/s.md", "s"), ("wiki/wiki/summaries/s.md", "s")], "path string, name string")
    got = {r["dst_key"]: r["method"] for r in derive.wikilinks(links, pages).collect()}
    assert got == {"wiki/wiki/summaries/s.md": "path_prefix", "wikilink:gone": "exact"}


def test_paths_and_keys(spark):
    rows = [("/a/./b/../c.md",), ("../x",), ("/..",), ("a/../..",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(paths.normalise(F.col("p"))).collect()]
    import os

    assert got == [os.path.normpath(p) for (p,) in rows]
    ext = [(".bashrc", ""), ("a.TAR.gz", "gz"), ("x", ""), (".env.Local", "local")]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in ext], "p string").select(paths.extension(F.col("p"))).collect()] == [b for _, b in ext]
    ks = ["/root/a.md", "/root/a.md#2", "archive:/root/z.zip!x", "m3::/root/a.md", "code::/root/c.py", "author:Ann", "/root"]
    df = spark.createDataFrame([(k,) for k in ks], "k string")
    there = df.select(keys.to_portable(F.col("k"), "/root").alias("p"))
    assert [r[0] for r in there.collect()] == ["~/a.md", "~/a.md#2", "archive:~/z.zip!x", "m3::~/a.md", "code::~/c.py", "author:Ann", "~"]
    assert [r[0] for r in there.select(keys.to_local(F.col("p"), "/new")).collect()][:2] == ["/new/a.md", "/new/a.md#2"]
    for bad in ("/rootless/a", "/elsewhere/b"):
        with pytest.raises(Exception, match="outside of the root"):
            spark.createDataFrame([(bad,)], "k string").select(keys.to_portable(F.col("k"), "/root")).collect()
    with pytest.raises(Exception, match="outside of the root"):
        spark.createDataFrame([("~/../x",)], "k string").select(keys.to_local(F.col("k"), "/root")).collect()


def test_error_rate_and_roles(spark):
    docs = spark.createDataFrame([("pdf", "ok"), ("pdf", "corrupt")], "doctype string, status string")
    assert reports.error_rate(docs) == 0.5 and reports.error_rate(docs.limit(0)) == 0.0
    files = spark.createDataFrame([("d", "image", True)] * 4 + [("d", "code", True)] * 3 + [("t", "image", True)] * 2 + [("t", "code", True)] * 2, "dir string, category string, counted boolean")
    assert [(r["dir"], r["category"], r["n"], r["total"]) for r in reports.dominant_roles(files).collect()] == [("d", "image", 4, 7)]
