"""A small corpus from files to stores, mesh, search, exports and back."""

import json
import lzma
import os

import pytest
from pyspark.sql import functions as F

from spindle import cli, config, serve
from spindle.api import Workspace
from spindle.errors import CannotUpdate, ConfigChanged, ConfigMissing, ExportError, ImportRefused, Locked, ModelUnavailable, NotBuilt, Refused
from spindle.plans import build
from spindle.plans.classifier import load_rules
from spindle.sinks import artifact, nodelink, vault
from spindle.sources.roles import proposed
from spindle.store import Store, locked


def put(root, name, text="x", mtime=1_780_000_000):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    os.utime(p, (mtime, mtime))
    return p


def rules():
    """The rules without the folders that tests run in, which they take for caches."""
    r = load_rules()
    r["cache"]["dirs"] = [d for d in r["cache"]["dirs"] if d not in ("tmp", "temp")]
    return r


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("home"))
    put(root, "notes/index.md", "# People\n[[ann]]\n# Tools\n[[loom]] [[ann]]\n")
    put(root, "notes/ann.md", "# Ann\nuses [[loom]] and [[nobody]] #weaver\n![[plot.png]] see ./loom.md\n")
    put(root, "notes/loom.md", f"# Loom\n## Parts\nruns {root}/src/weave.py and shuttle.py; [ann](ann.md)\n")
    put(root, "notes/alone.md", "nothing links here")
    put(root, "docs/aa.tex", "\\title{Alpha}\n\\author{Ann B}\n text 10.1234/abc-1 and bb.tex\n")
    put(root, "docs/bb.tex", "\\title{Beta}\n\\author{Ann B}\n text\n")
    put(root, "pics/trip/14032021_1.png")
    put(root, "pics/trip/14032021_2.png")
    put(root, "pics/plot.png")
    put(root, "pics/plot_copy.png")
    put(root, "src/weave.py", "pass")
    put(root, "src/shuttle.py", "pass")
    put(root, "etc/x.conf", "a=1")
    put(root, "etc/old.conf", "a=1", mtime=1_600_000_000)
    return root


@pytest.fixture(scope="module")
def work(spark, corpus, tmp_path_factory):
    c = config.Config(corpus, {"image": ("pics",)}, index_file="notes/index.md")
    w = Workspace(spark, c, str(tmp_path_factory.mktemp("stores")), rules())
    for m in ("m1", "m2", "m3", "m4"):
        w.build(m, "2026-07-22")
    w.build_mesh("2026-07-22", code=True)
    return w


def edges(store):
    n = store.nodes.select("id", "node_key")
    e = store.edges.join(n.select(F.col("id").alias("src"), F.col("node_key").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("node_key").alias("b")), "dst")
    return {(r["a"], r["rel"], r["b"]): r["method"] for r in e.collect()}


def test_markdown_model(work, corpus):
    got, n = edges(work.store("m3")), f"{corpus}/notes"
    assert got[f"{n}/ann.md", "WIKILINKS_TO", f"{n}/loom.md"] == "exact" and (f"{n}/ann.md", "WIKILINKS_TO", "wikilink:nobody") in got
    assert (f"{n}/ann.md", "TAGGED", "tag:weaver") in got and (f"{n}/loom.md", "LINKS_TO", f"{n}/ann.md") in got and got[f"{n}/ann.md", "MENTIONS_PATH", f"{n}/loom.md"] == "mention"
    assert {b for a, r, b in got if r == "CATEGORIZED_UNDER" and a == f"{n}/ann.md"} == {"category:People", "category:Tools"}
    assert (f"{n}/loom.md", "CONTAINS", f"{n}/loom.md#1") in got
    answer = work.query("m3", "MATCH (a)-[:WIKILINKS_TO]->(b) WHERE b NAMED 'loom' RETURN a.path")
    assert {r[0] for r in answer.rows.collect()} == {f"{n}/ann.md", f"{n}/index.md"}


def test_other_models(work, corpus):
    m1, m2, m4 = (edges(work.store(m)) for m in ("m1", "m2", "m4"))
    a, b = f"{corpus}/docs/aa.tex", f"{corpus}/docs/bb.tex"
    assert (a, "SAME_AUTHOR", b) in m1 and (a, "CITES", "ref:doi:10.1234/abc-1") in m1 and m1[a, "REFERENCES_FILE", b] == "mention" and (a, "AUTHORED_BY", "author:Ann B") in m1
    p = f"{corpus}/pics"
    assert (f"{p}/trip/14032021_1.png", "SERIES_MEMBER", "series:trip/14032021") in m2 and m2[f"{p}/plot.png", "LIKELY_COPY", f"{p}/plot_copy.png"] == "basename"
    assert (f"{p}/trip/14032021_1.png", "NAMED_DATE", "date:2021-03-14") in m2 and (f"{p}/plot.png", "IN_COLLECTION", "collection:pics") in m2
    assert work.store("m2").nodes.where("content_hash is not null").count() == 0
    assert (f"{corpus}/etc/x.conf", "BELONGS_TO_APP", "app:etc") in m4 and ("rollup:etc:2020-09", "BELONGS_TO_APP", "app:etc") in m4


def test_images_are_not_opened(work):
    plan = work.files("m2")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("FileScan binaryFile")[-1].split("ReadSchema")[-1]


def test_mesh(work, corpus):
    got = edges(work.mesh())
    ann, loom = f"m3::{corpus}/notes/ann.md", f"m3::{corpus}/notes/loom.md"
    assert got[ann, "FIGURE_FOR", f"m2::{corpus}/pics/plot.png"] == "basename"
    assert got[loom, "CITES_CODE", f"code::{corpus}/src/weave.py"] == "mention" and got[loom, "CITES_CODE", f"code::{corpus}/src/shuttle.py"] == "basename"
    assert work.path_between(ann, f"code::{corpus}/src/weave.py") == [ann, loom, f"code::{corpus}/src/weave.py"]
    found = work.mesh_search("loom")
    assert found.status == "complete" and any(r["node_key"].endswith("loom.md") for r in found.rows.collect())
    assert work.mesh_search("weave").rows.where("node_key like 'code::%'").count() == 1
    with pytest.raises(ModelUnavailable):
        work.build_mesh("2026-07-23", prune=True)


def _sets(store):
    nodes = {(r["node_key"], r["kind"], r["subtype"], r["title"], r["content_hash"]) for r in store.nodes.collect()}
    return nodes, set(edges(store).items())


def test_update_equals_rebuild(spark, corpus, tmp_path):
    root = str(tmp_path / "h")
    for name, text in (("a.md", "[[b]] [[c]]"), ("b.md", "[[a]] #t"), ("c.md", "x"), ("d.md", "[[c]]")):
        put(root, name, text)
    c = config.Config(root)
    w = Workspace(spark, c, str(tmp_path / "s"), rules())
    w.build("m3", "2026-01-01")
    put(root, "a.md", "[[b]] [[new]]", 1_780_000_500)
    put(root, "new.md", "[[d]]")
    put(root, "c.md", "x", 1_780_000_900)
    os.remove(os.path.join(root, "d.md"))
    updated = w.update("m3", "2026-02-01")
    fresh = Workspace(spark, c, str(tmp_path / "f"), rules()).build("m3", "2026-02-01")
    assert _sets(updated) == _sets(fresh)
    first = {r["node_key"].rsplit("/", 1)[-1]: r["first_seen"] for r in updated.nodes.collect()}
    assert first["b.md"] == "2026-01-01" and first["new.md"] == "2026-02-01"
    assert updated.observations.count() == 7  # a, b and c on both days, new on the second
    with pytest.raises(CannotUpdate):
        w.update("m4")
    with pytest.raises(ConfigChanged):
        Workspace(spark, config.Config(root, {"image": ("p",)}), str(tmp_path / "s"), rules()).update("m3")
    with pytest.raises(NotBuilt):
        build.updated(Store.empty(spark, "m3"), build.Parts(updated.nodes, updated.edges), updated.nodes, "2026-01-01")


def test_edits_and_removals_are_seen(spark, tmp_path):
    from spindle.streaming.watch import watch_tree

    root = str(tmp_path / "r")
    for name in ("a.md", "b.md"):
        put(root, name, f"[[{name[0]}]]")
    w = Workspace(spark, config.Config(root), str(tmp_path / "s"), rules())
    w.build("m3", "2026-01-01")
    assert w.pending("m3").isEmpty() and not w.caught_up("m3")
    put(root, "a.md", "[[b]] and more")
    put(root, "c.md", "[[a]]")
    os.remove(os.path.join(root, "b.md"))
    assert {r["path"].rsplit("/", 1)[1]: r["change"] for r in w.pending("m3").collect()} == {"a.md": "changed", "b.md": "removed", "c.md": "added"}
    looks = []

    def look():
        looks.append(w.caught_up("m3", "2026-01-02"))

    q = watch_tree(spark, look, str(tmp_path / "checkpoint"), "1 second")
    try:
        for _ in range(60):
            q.processAllAvailable()
            if len(looks) > 1:
                break
    finally:
        q.stop()
    assert looks[:2] == [True, False] and w.pending("m3").isEmpty()
    assert {r["node_key"].rsplit("/", 1)[1] for r in w.store("m3").nodes.where("kind = 'file'").collect()} == {"a.md", "c.md"}


def test_large_files_and_databases(spark, tmp_path):
    import sqlite3

    root = str(tmp_path / "r")
    put(root, "etc/x.conf", "a=1")
    with sqlite3.connect(os.path.join(root, "etc", "y.sqlite")) as db:
        db.execute("create table loom (id int)")
        db.execute("create table warp (secret text)")
        db.execute("insert into warp values ('row')")
    with open(os.path.join(root, "etc", "big.bin"), "wb") as f:
        f.truncate((100 << 20) + 1)
    store = Workspace(spark, config.Config(root), str(tmp_path / "s"), rules()).build("m4", "2026-07-22")
    got = {r["title"]: r for r in store.nodes.where("kind = 'file'").collect()}
    assert got["y.sqlite"]["body"] == "y.sqlite | tables: loom, warp" and got["x.conf"]["body"] == "x.conf"
    assert got["big.bin"]["subtype"] == "binary" and got["big.bin"]["content_hash"] is None
    assert (f"{root}/etc/big.bin", "SAME_FORMAT", "format:large") in edges(store)


def test_a_committed_store_keeps_its_index(work):
    store = work.store("m3")
    assert store.index().lengths.count() == store.nodes.count() and os.path.isdir(os.path.join(store.at, "index"))
    assert "documents" not in store.index().postings._jdf.queryExecution().toString()
    assert store.having(nodes=store.nodes.limit(1)).index().lengths.count() == 1


def test_artifact_round_trip(spark, work, corpus, tmp_path):
    path = str(tmp_path / "x.graph")
    stores = work.stores(("m1", "m3"))
    manifest = artifact.export(stores, path, corpus, "full")
    assert artifact.verify(path)["counts"] == manifest["counts"]
    back = artifact.load(spark, path, "/new")
    for m in stores:
        old, new = edges(stores[m]), edges(back[m])
        assert {tuple(x.replace(corpus, "/new") for x in k): v for k, v in old.items()} == new
    assert corpus.encode() not in lzma.open(path).read().replace(f"{corpus}/src/weave.py".encode(), b"")
    shaped = str(tmp_path / "s.graph")
    artifact.export(stores, shaped, corpus, "shape")
    assert b"ann" not in lzma.open(shaped).read().replace(b"m3", b"").split(b"\n", 1)[1].lower().replace(b"channel", b"")
    lines = lzma.open(path).read().splitlines(keepends=True)

    def tampered(change, match):
        with lzma.open(str(tmp_path / "bad"), "wb") as f:
            f.write(b"".join(change(list(lines))))
        with pytest.raises(ImportRefused, match=match):
            artifact.load(spark, str(tmp_path / "bad"), "/new")

    tampered(lambda x: x[:-1], "no digest")
    tampered(lambda x: [*x[:2], *x[3:]], "digest doesn't fit")
    tampered(lambda x: [*x, x[1]], "rows follow")
    tampered(lambda x: [x[0].replace(b'"schema": 4', b'"schema": 9'), *x[1:]], "newer")
    tampered(lambda x: [x[0].replace(b"spindle-graph", b"other"), *x[1:]], "no artifact")
    with pytest.raises(ExportError):
        artifact.export(stores, path, corpus, "half")


def test_vault_and_node_link(work, tmp_path):
    m = work.mesh()
    assert vault.export_vault(m.nodes, m.edges, str(tmp_path / "v")) == m.nodes.count() == len(os.listdir(tmp_path / "v"))
    assert any("CITES_CODE" in open(tmp_path / "v" / f).read() for f in os.listdir(tmp_path / "v"))
    with pytest.raises(ExportError):
        vault.export_vault(m.nodes, m.edges, str(tmp_path / "v"))
    assert vault.safe_name("a/b:c" + "é" * 200, "k").startswith("a b c") and len(vault.safe_name("é" * 200, "k").encode()) <= 180
    assert (vault.scalar("yes"), vault.scalar("plain text"), vault.scalar("a: b")) == ('"yes"', "plain text", '"a: b"')
    counts = nodelink.export_graph(m.nodes, m.edges, str(tmp_path / "g.json"))
    data = json.load(open(tmp_path / "g.json"))
    assert (len(data["nodes"]), len(data["links"])) == (counts["nodes"], counts["links"]) == (m.nodes.count(), m.edges.count())
    with pytest.raises(Exception, match="no mapping for kind"):
        nodelink.export_graph(m.nodes.withColumn("kind", F.lit("odd")), m.edges, str(tmp_path / "h.json"))
    shown = nodelink.payload(m.nodes, m.edges, 5)
    assert shown["truncated"] and len(shown["nodes"]) == 5 and "<svg" in nodelink.render(shown)
    assert nodelink.layout(30, [(0, 1)]) == nodelink.layout(30, [(0, 1)])
    ring = [(i, (i + 1) % 40) for i in range(40)]
    placed = nodelink.layout(40, ring)
    spans = [[((placed[i][0] - placed[j][0]) ** 2 + (placed[i][1] - placed[j][1]) ** 2) ** 0.5 for i, j in pairs] for pairs in (ring, [(i, (i + 20) % 40) for i in range(40)])]
    assert sum(spans[0]) < sum(spans[1]) and min(spans[0]) > 0 and nodelink.layout(0, []) == []


def test_one_writer(tmp_path):
    with locked(str(tmp_path)):
        with pytest.raises(Locked), locked(str(tmp_path)):
            pass
    (tmp_path / "_LOCK").write_text(json.dumps({"pid": 999_999_999, "started": "1", "nonce": "x"}))
    with locked(str(tmp_path)):
        pass
    assert not (tmp_path / "_LOCK").exists()


def test_an_interrupted_commit_changes_nothing(spark, work, tmp_path):
    s = work.store("m1").commit(str(tmp_path / "s"))
    broken = s.having(nodes=s.nodes.withColumn("title", F.raise_error(F.lit("stop")).cast("string")))
    with pytest.raises(Exception, match="stop"):
        broken.commit()
    assert Store.open(spark, str(tmp_path / "s")).nodes.count() == s.nodes.count() and len(list((tmp_path / "s").glob("v*"))) == 1
    key = s.nodes.where("kind = 'author'").first()["node_key"]
    less = s.without(key)
    assert less.get_node(key) is None and less.edges.count() < s.edges.count()


def test_configuration(tmp_path, corpus):
    path = str(tmp_path / "c.toml")
    with pytest.raises(ConfigMissing):
        config.load(path)
    c = proposed(corpus)
    assert c.roles == {"markdown": ("notes",), "image": ("pics",)}
    config.write(c, path)
    assert config.load(path) == c
    with pytest.raises(Refused):
        config.write(c, path)
    for text in ("root = 1", "root = '/x'\n[roles]\nodd = []", "root = '/x'\n[embeddings]\nmodel = 'm'", "root ="):
        (tmp_path / "bad.toml").write_text(text)
        with pytest.raises(Refused):
            config.load(str(tmp_path / "bad.toml"))


def test_command_line(work, corpus, tmp_path, capsys):
    path = str(tmp_path / "c.toml")
    config.write(work.config, path)
    base = ["--config", path, "--stores", work.folder]
    assert cli.main([*base, "query", "m3", "MATCH (a)-[:TAGGED]->(b) RETURN b.title"]) == 0 and "weaver" in capsys.readouterr().out
    assert cli.main([*base, "query", "m3", "MATCH (a)-[e]->(b) RETURN count(a)"]) == 2
    assert cli.main([*base, "gaps"]) == 0 and "alone.md" in capsys.readouterr().out
    assert cli.main([*base, "mesh-path", f"m3::{corpus}/notes/alone.md", f"code::{corpus}/src/weave.py"]) == 1
    assert cli.main(["--config", str(tmp_path / "none"), "config"]) == 2
    assert cli.main([*base, "status", "m3"]) == 0 and '"nodes"' in capsys.readouterr().out
    assert cli.main([*base, "broken"]) == 0 and "nobody" in capsys.readouterr().out


def test_json_rpc(work):
    known = serve.tools(work)
    call = lambda **x: serve.handle(json.dumps({"jsonrpc": "2.0", "id": 1} | x), known)
    assert serve.handle("{", known)["error"]["code"] == -32700 and serve.handle("{}", known)["error"]["code"] == -32600
    assert call(method="odd")["error"]["code"] == -32601 and call(method="tools/call", params={"name": "query"})["error"]["code"] == -32602
    assert len(call(method="tools/list")["result"]["tools"]) == 5
    got = call(method="tools/call", params={"name": "query", "arguments": {"model": "m3", "text": "MATCH (a)-[:TAGGED]->(b) RETURN b.title"}})
    assert json.loads(got["result"]["content"][0]["text"])["rows"] == [{"b.title": "weaver"}]
    assert call(method="tools/call", params={"name": "query", "arguments": {"model": "m3", "text": "x"}})["result"]["isError"]
