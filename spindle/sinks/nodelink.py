"""Node-link JSON of a multigraph, and a page that shows one."""

from __future__ import annotations

import html
import json
import math
import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_METHODS

# Kinds and methods as the format has them. A kind or method without one stops the export.
FILE_TYPES = {
    "file": "document", "document": "paper", "section": "document", "image": "image", "code": "code", "archive_entry": "document", "rollup": "document",
    "author": "concept", "reference": "concept", "tag": "concept", "wikilink": "concept", "category": "concept", "collection": "concept", "datebucket": "concept",
    "resolution": "concept", "series": "concept", "app": "concept", "format": "concept",
}
CERTAINTY = {m: "EXTRACTED" if c >= 1 else "AMBIGUOUS" if m == "path_prefix" else "INFERRED" for m, c in EDGE_METHODS.items()}
# The seed of the layout, and nodes times rounds.
SEED, LAYOUT_BUDGET = 20260722, 105_000
ROUNDS_LEAST, ROUNDS_MOST, STEP, GRID_MOST, SOFT = 20, 150, 0.1, 256, 0.1


def mapped(value: Column, table: dict[str, str], what: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), F.raise_error(F.concat(F.lit(f"no mapping for {what} "), F.coalesce(value, F.lit("null")))).cast("string"))


def graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = nodes.select(F.col("node_key").alias("id"), F.coalesce("title", "node_key").alias("label"), mapped(F.col("kind"), FILE_TYPES, "kind").alias("file_type"), "kind", "path", F.col("first_seen"), F.col("last_seen"))
    keys = nodes.select("id", "node_key")
    e = edges.join(keys.select(F.col("id").alias("src"), F.col("node_key").alias("source")), "src").join(keys.select(F.col("id").alias("dst"), F.col("node_key").alias("target")), "dst")
    return n.orderBy("id"), e.select("source", "target", F.col("rel").alias("relation"), mapped(F.col("method"), CERTAINTY, "method").alias("confidence"), F.col("confidence").alias("confidence_score")).orderBy("source", "target", "relation")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> dict:
    """Writes the JSON, a row at a time, and returns counts: nodes, links, parallel links."""
    n, e = graph_rows(nodes, edges)
    part, counts, last = f"{path}.{uuid.uuid4().hex}", {"nodes": 0, "links": 0, "parallel": 0}, None
    with open(part, "w", encoding="utf-8") as f:
        f.write('{"directed": true, "multigraph": true, "graph": {}, "nodes": [')
        for r in n.toLocalIterator():
            f.write(",\n"[not counts["nodes"] :] + json.dumps(r.asDict(), ensure_ascii=False))
            counts["nodes"] += 1
        f.write('], "links": [')
        for r in e.toLocalIterator():
            f.write(",\n"[not counts["links"] :] + json.dumps(r.asDict(), ensure_ascii=False))
            counts["links"] += 1
            counts["parallel"] += last == (r["source"], r["target"])
            last = (r["source"], r["target"])
        f.write("]}\n")
    os.replace(part, path)
    return counts


def layout(n: int, links: list[tuple[int, int]], seed: int = SEED) -> list[tuple[float, float]]:
    """Positions of a force layout: the same for the same graph. All nodes move at once.

    Every node is pushed by the centres of the cells of a grid around its own, each as heavy as its cell, and
    pulled by what it is linked to. A step is at most the step size, which shrinks to nothing over the rounds.
    """
    at = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    if n < 2:
        return [tuple(p) for p in at.tolist()]
    a, b = (np.array([e[i] for e in links], np.int64) for i in (0, 1))
    ideal = 2 / math.sqrt(n)
    rounds = max(ROUNDS_LEAST, min(ROUNDS_MOST, LAYOUT_BUDGET // n))
    for step in np.linspace(STEP, 0, rounds, endpoint=False):
        low = at.min(axis=0)
        side = max(2 * ideal, float((at.max(axis=0) - low).max()) / GRID_MOST)
        cell = ((at - low) / side).astype(np.int64) + 1
        wide = int(cell.max()) + 2
        flat = cell[:, 0] * wide + cell[:, 1]
        mass = np.bincount(flat, minlength=wide * wide)
        centre = np.stack([np.bincount(flat, at[:, k], wide * wide) for k in (0, 1)], 1) / np.maximum(1, mass)[:, None]
        force = np.zeros((n, 2))
        for around in (dx * wide + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            away = at - centre[flat + around]
            force += away * (mass[flat + around] * ideal**2 / ((away**2).sum(axis=1) + SOFT * ideal**2))[:, None]
        pull = (at[b] - at[a]) * (np.linalg.norm(at[b] - at[a], axis=1) / ideal)[:, None]
        np.add.at(force, a, pull)
        np.add.at(force, b, -pull)
        at += force * (step / np.maximum(step, np.linalg.norm(force, axis=1)))[:, None]
    return [tuple(p) for p in at.tolist()]


def positions(keys: list[str], links: list[tuple[int, int]]) -> list[tuple[float, float]]:
    """The layout for linked nodes, and a band below, in order of keys, for those without a link."""
    linked = sorted({i for e in links for i in e})
    place = {i: k for k, i in enumerate(linked)}
    at = layout(len(linked), [(place[a], place[b]) for a, b in links])
    alone = sorted((i for i in range(len(keys)) if i not in place), key=lambda i: keys[i])
    band = {i: (-1 + 2 * (k % 60) / 60, 1.3 + 0.05 * (k // 60)) for k, i in enumerate(alone)}
    return [at[place[i]] if i in place else band[i] for i in range(len(keys))]


def payload(nodes: DataFrame, edges: DataFrame, limit: int = 5000) -> dict:
    """Nodes with positions and links of at most `limit` nodes by key, and whether there are more."""
    first = nodes.orderBy("node_key").limit(limit + 1).select("id", "node_key", "kind", "title").collect()
    shown, truncated = first[:limit], len(first) > limit
    place = {r["id"]: i for i, r in enumerate(shown)}
    spark = nodes.sparkSession
    ids = spark.createDataFrame([(i,) for i in place], "id long")
    inner = edges.join(F.broadcast(ids.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "dst")), "dst", "left_semi")  # `limit` ids
    links = [(place[r["src"]], place[r["dst"]], r["rel"], r["confidence"]) for r in inner.select("src", "dst", "rel", "confidence").collect()]
    at = positions([r["node_key"] for r in shown], [(a, b) for a, b, *_ in links])
    touched = {i for a, b, *_ in links for i in (a, b)}
    return {
        "nodes": [{"key": r["node_key"], "kind": r["kind"], "title": r["title"], "x": round(x, 4), "y": round(y, 4)} for r, (x, y) in zip(shown, at, strict=True)],
        "links": [{"a": a, "b": b, "rel": rel, "derived": c < 1} for a, b, rel, c in links],
        "isolated": len(shown) - len(touched), "share": round(100 * (len(shown) - len(touched)) / len(shown), 1) if shown else 0.0, "truncated": truncated,
    }


def render(data: dict, title: str = "graph") -> str:
    """A page that needs nothing else: the graph as SVG, with titles on its nodes."""
    px = lambda p: (500 + 480 * max(-1.5, min(1.5, p["x"])) / 1.5, 400 + 380 * max(-2, min(2, p["y"])) / 2)
    lines = []
    for e in data["links"]:
        (x1, y1), (x2, y2) = px(data["nodes"][e["a"]]), px(data["nodes"][e["b"]])
        lines.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" class="{"d" if e["derived"] else "e"}"/>')
    for n in data["nodes"]:
        x, y = px(n)
        lines.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" class="{html.escape(n["kind"] or "")}"><title>{html.escape(n["title"] or n["key"])}</title></circle>')
    note = " (cut)" if data["truncated"] else ""
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>line{{stroke:#999;stroke-width:.5}}.d{{stroke-dasharray:2}}</style><p>{len(data["nodes"])} nodes{note}, {len(data["links"])} links, {data["share"]} % without a link</p><svg viewBox="0 0 1000 800">{"".join(lines)}</svg>\n'
