"""The command line. Exit codes: 0 answered, 1 no path, 2 refused, 3 a federated answer is partial."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config
from .api import PARTITIONS, Workspace
from .errors import Refused
from .functions.embed import embed_store, from_config
from .operators import graph, reports, search
from .plans import mesh
from .session import session
from .sinks import artifact, nodelink, vault
from .sources import files
from .streaming import watch as streaming

HOME = os.path.expanduser("~/.spindle")


def _print(rows: DataFrame | None, limit: int = 200) -> None:
    if rows is None:
        print("did not run")
        return
    got = rows.limit(limit + 1).collect()
    for r in got[:limit]:
        print("\t".join("" if v is None else str(v) for v in r))
    if len(got) > limit:
        print(f"cut at {limit} rows")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindle")
    p.add_argument("--config", default=os.path.join(HOME, "config.toml"))
    p.add_argument("--stores", default=os.path.join(HOME, "stores"))
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, how in args:
            c.add_argument(flag, **how)

    model, text, limit = ("model", {"choices": list(PARTITIONS)}), ("text", {}), ("--limit", {"type": int, "default": 20})
    as_of, out = ("--as-of", {}), ("out", {})
    command("init", ("root", {}), ("--force", {"action": "store_true"}))
    command("config")
    command("explain", ("path", {}))
    command("census")
    command("build", model, as_of)
    command("update", model, as_of)
    command("watch", model, ("--debounce", {"default": "1.5 seconds"}))
    command("query", model, text)
    command("status", model)
    command("search", model, text, limit, ("--mode", {"default": "auto"}), ("--all", {"action": "store_true"}), ("--type", {}))
    command("embed", model)
    command("backlinks", ("key", {}), ("--rel", {}), as_of)
    command("broken")
    command("gaps")
    command("mesh-build", as_of, ("--code", {"action": "store_true"}), ("--repo", {}), ("--prune", {"action": "store_true"}))
    command("mesh-search", text, limit)
    command("mesh-explain", text, limit)
    command("mesh-neighbors", ("key", {}), ("--depth", {"type": int, "default": 1}))
    command("mesh-path", ("a", {}), ("b", {}), ("--depth", {"type": int, "default": 4}))
    command("export", out, ("--level", {"default": "structure"}))
    command("inspect", ("file", {}))
    command("import", ("file", {}))
    command("export-vault", out)
    command("export-graph", out)
    command("visualize", out)
    command("mcp")
    command("gui", ("--port", {"type": int, "default": 8765}))
    return p


def _run(a: argparse.Namespace) -> int:
    if a.command == "init":
        from .sources.roles import proposed

        config.write(proposed(a.root), a.config, a.force)
        print(a.config)
        return 0
    if a.command == "inspect":
        print(json.dumps(artifact.verify(a.file), indent=1, ensure_ascii=False))
        return 0
    c = config.load(a.config)
    if a.command == "config":
        print(config.render(c), end="")
        return 0
    spark = session()
    w = Workspace(spark, c, a.stores)
    if a.command == "explain":
        path = os.path.abspath(a.path)
        _print(w.classifier.classify(spark.createDataFrame([(path, os.path.islink(path))], "path string, is_symlink boolean")))
    elif a.command == "census":
        decided = w.decisions()
        _print(reports.census(decided).orderBy("label", "subtype"))
        top, more = reports.excluded_directories(decided)
        _print(top)
        if more:
            print("more directories are not shown")
    elif a.command in ("build", "update"):
        s = getattr(w, a.command)(a.model, a.as_of)
        print(f"{s.nodes.count()} nodes, {s.edges.count()} edges")
    elif a.command == "watch":
        w.caught_up(a.model)
        streaming.watch_tree(spark, lambda: w.caught_up(a.model), os.path.join(a.stores, "_watch", a.model), a.debounce).awaitTermination()
    elif a.command == "query":
        found = w.query(a.model, a.text)
        print("\t".join(found.columns))
        _print(found.rows) if found.rows is not None else print("\n".join(found.candidates))
        print(*found.warnings, sep="\n", file=sys.stderr)
    elif a.command == "status":
        s = w.store(a.model)
        print(json.dumps(reports.status(s.nodes, s.edges, s.observations, s.embeddings, s.index().lengths.count()), indent=1))
        _print(search.coverage(s.nodes, s.embeddings))
    elif a.command == "search":
        found = w.search(a.model, a.text, a.limit, a.mode, from_config(c.embeddings), a.all, a.type)
        _print(found.rows)
        print(found.mode, *found.warnings, sep="\n", file=sys.stderr)
    elif a.command == "embed":
        s, done, degenerate = embed_store(w.store(a.model), from_config(c.embeddings) or _no_embedder())
        s.commit()
        print(f"{done} embedded, {degenerate} without a known token")
    elif a.command == "backlinks":
        s = w.store("m3")
        _print(graph.backlinks(s.nodes, s.edges, a.key, a.rel, a.as_of).orderBy("node_key"))
    elif a.command == "broken":
        s = w.store("m3")
        _print(graph.broken_report(s.nodes, s.edges).orderBy("title"))
    elif a.command == "gaps":
        s = w.store("m3")
        _print(graph.isolated(s.nodes, s.edges).select("path").orderBy("path"))
    elif a.command == "mesh-build":
        s, notes = w.build_mesh(a.as_of, a.code, a.repo, a.prune)
        _print(s.edges.groupBy("rel").count())
        print(*notes, sep="\n", file=sys.stderr)
    elif a.command == "mesh-search":
        found = w.mesh_search(a.text, a.limit)
        _print(found.rows)
        print(*found.warnings, sep="\n", file=sys.stderr)
        return 3 if found.status == "partial" else 0
    elif a.command == "mesh-explain":
        for name, rows in mesh.explain(w.stores(), a.text, a.limit).items():
            print(name)
            _print(rows)
    elif a.command == "mesh-neighbors":
        _print(w.neighbours(a.key, a.depth))
    elif a.command == "mesh-path":
        found = w.path_between(a.a, a.b, a.depth)
        print(" > ".join(found) if found else "no path")
        return 0 if found else 1
    elif a.command == "export":
        print(json.dumps(artifact.export(w.stores(), a.out, c.root, a.level)["counts"]))
    elif a.command == "import":
        for m, s in artifact.load(spark, a.file, c.root).items():
            s.commit(w.path(m))
    elif a.command == "export-vault":
        m = w.mesh()
        print(vault.export_vault(m.nodes, m.edges, a.out))
    elif a.command == "export-graph":
        m = w.mesh()
        print(json.dumps(nodelink.export_graph(m.nodes, m.edges, a.out)))
    elif a.command == "visualize":
        m = w.mesh()
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(nodelink.render(nodelink.payload(m.nodes, m.edges)))
    elif a.command == "mcp":
        from .serve import stdio

        stdio(w)
    elif a.command == "gui":
        from .serve import http

        http(w, a.port)
    return 0


def _no_embedder():
    raise Refused("no embeddings are configured")


def main(argv: list[str] | None = None) -> int:
    try:
        return _run(_parser().parse_args(argv))
    except Refused as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
