"""Portable artifacts: an lzma file of JSON lines with a manifest first and a digest last, and reading them back.

Lines come from two sorted plans and are streamed partition by partition to the driver, since the digest covers them
in order; neither side holds more than a partition.
"""

from __future__ import annotations

import hashlib
import json
import lzma
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExportError, ImportRefused
from ..functions import keys
from ..functions.paths import digest
from ..schema import EDGES, NODES, SCHEMA_VERSION, edge_confidence, edge_id, node_id
from ..store import Store

FORMAT = "spindle-graph"
# What a level of redaction leaves out of a node.
LEVELS = {"full": (), "structure": ("body",), "shape": ("body", "mtime", "content_hash", "size", "heading_path", "activity_datelist", "datelist_int", "datelist_anchor")}
NODE_COLUMNS = [f.name for f in NODES if f.name != "id"]
EDGE_COLUMNS = ["src", "dst", "rel", "method", "confidence", "first_seen", "last_seen"]


def check_level(level: str) -> str:
    if level not in LEVELS:
        raise ExportError(f"no level {level!r}; there are {', '.join(LEVELS)}")
    return level


def node_rows(store: Store, model: str, root: str, level: str = "structure") -> DataFrame:
    """Nodes with portable keys, redacted to a level, by key."""
    df = store.nodes.select(*NODE_COLUMNS).drop(*LEVELS[check_level(level)])
    df = df.withColumn("node_key", keys.to_portable(F.col("node_key"), root)).withColumn("path", F.when(F.col("path").isNotNull(), keys.to_portable(F.col("path"), root)))
    if level == "shape":
        df = df.withColumn("node_key", keys.shape(F.col("node_key"))).withColumn("path", F.when(F.col("path").isNotNull(), digest(F.col("path")))).withColumn("title", digest(F.col("title")))
    return df.withColumn("t", F.lit("node")).withColumn("model", F.lit(model)).orderBy("node_key")


def edge_rows(store: Store, model: str, root: str, level: str = "structure") -> DataFrame:
    k = keys.to_portable(F.col("node_key"), root)
    k = keys.shape(k) if check_level(level) == "shape" else k
    named = store.nodes.select("id", k.alias("k"))
    df = store.edges.join(named.select(F.col("id").alias("src"), F.col("k").alias("s")), "src").join(named.select(F.col("id").alias("dst"), F.col("k").alias("d")), "dst")
    df = df.select(F.col("s").alias("src"), F.col("d").alias("dst"), "rel", "method", "confidence", "first_seen", "last_seen")
    return df.withColumn("t", F.lit("edge")).withColumn("model", F.lit(model)).orderBy("src", "dst", "rel")


def _line(row: dict) -> bytes:
    return json.dumps(row, sort_keys=True, ensure_ascii=False).encode() + b"\n"


def export(stores: dict[str, Store], path: str, root: str, level: str = "structure") -> dict:
    """Writes an artifact and returns its manifest. The file appears under its name only when it is whole."""
    check_level(level)
    counts = {m: {"nodes": s.nodes.count(), "edges": s.edges.count()} for m, s in sorted(stores.items())}
    manifest = {"t": "manifest", "format": FORMAT, "schema": SCHEMA_VERSION, "redaction": level, "redaction_note": "left out: " + (", ".join(LEVELS[level]) or "nothing"), "models": sorted(stores), "counts": counts, "root_note": "the root is written ~", "digest": "sha256"}
    part, sha = f"{path}.{uuid.uuid4().hex}", hashlib.sha256()

    def put(f, line: bytes) -> None:
        sha.update(line)
        f.write(line)

    try:
        with lzma.open(part, "wb", preset=6) as f:
            put(f, _line(manifest))
            for m, s in sorted(stores.items()):
                for rows in (node_rows(s, m, root, level), edge_rows(s, m, root, level)):
                    for r in rows.toLocalIterator():
                        put(f, _line(r.asDict(recursive=True)))
            f.write(_line({"t": "digest", "sha256": sha.hexdigest()}))
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return manifest


def _lines(path: str) -> Iterator[tuple[bytes, dict]]:
    try:
        with lzma.open(path, "rb") as f:
            for line in f:
                yield line, json.loads(line)
    except (lzma.LZMAError, EOFError, ValueError, UnicodeDecodeError) as e:
        raise ImportRefused(f"{path} can't be read: {e}") from e


def read_manifest(path: str) -> dict:
    """The manifest alone, checked for format and schema."""
    _, m = next(_lines(path), (b"", {}))
    if m.get("t") != "manifest" or m.get("format") != FORMAT:
        raise ImportRefused(f"{path} is no artifact of this engine")
    lacking = [k for k in ("schema", "redaction", "models", "counts") if k not in m]
    if lacking:
        raise ImportRefused(f"the manifest lacks {', '.join(lacking)}")
    if m["schema"] > SCHEMA_VERSION:
        raise ImportRefused(f"schema {m['schema']} is newer than {SCHEMA_VERSION}")
    return m


def verify(path: str) -> dict:
    """The manifest of an artifact whose digest, counts and rows hold; anything else is refused by name."""
    manifest, sha, ended = read_manifest(path), hashlib.sha256(), False
    level = LEVELS.get(manifest["redaction"])
    if level is None:
        raise ImportRefused(f"unknown redaction {manifest['redaction']!r}")
    found = {m: {"nodes": 0, "edges": 0} for m in manifest["models"]}
    need = {"node": set(NODE_COLUMNS) - set(level), "edge": set(EDGE_COLUMNS)}
    for line, row in _lines(path):
        if ended:
            raise ImportRefused("rows follow the digest")
        if row.get("t") == "digest":
            if row.get("sha256") != sha.hexdigest():
                raise ImportRefused("the digest doesn't fit the rows")
            ended = True
            continue
        sha.update(line)
        if row["t"] == "manifest":
            continue
        if row["t"] not in need:
            raise ImportRefused(f"unknown row {row['t']!r}")
        if row.get("model") not in found:
            raise ImportRefused(f"a row of the undeclared model {row.get('model')!r}")
        lacking = need[row["t"]] - set(row)
        if lacking:
            raise ImportRefused(f"a {row['t']} row lacks {', '.join(sorted(lacking))}")
        found[row["model"]][row["t"] + "s"] += 1
    if not ended:
        raise ImportRefused("there is no digest")
    if found != manifest["counts"]:
        raise ImportRefused("rows and counts differ")
    return manifest


def load(spark: SparkSession, path: str, root: str) -> dict[str, Store]:
    """The stores of an artifact under another root, with their dates as they were. Checked whole before anything is made."""
    manifest = verify(path)
    text = spark.createDataFrame([(row["t"], row["model"], line.decode()) for line, row in _lines(path) if row["t"] in ("node", "edge")], "t string, model string, value string")
    out = {}
    for m in manifest["models"]:
        own = text.where(F.col("model") == m)
        local = (lambda c: c) if manifest["redaction"] == "shape" else (lambda c: keys.to_local(c, root))
        n = own.where("t = 'node'").select(F.from_json("value", NODES).alias("x")).select("x.*")
        n = n.withColumn("node_key", local(F.col("node_key"))).withColumn("path", F.when(F.col("path").isNotNull(), local(F.col("path"))))
        n = n.withColumn("id", node_id(F.col("node_key"))).withColumn("activity_datelist", F.coalesce("activity_datelist", F.array().cast("array<string>")))
        e = own.where("t = 'edge'").select(F.from_json("value", "src string, dst string, rel string, method string, first_seen string, last_seen string").alias("x")).select("x.*")
        src, dst = node_id(local(F.col("src"))), node_id(local(F.col("dst")))
        e = e.select(edge_id(src, dst, F.col("rel")).alias("id"), src.alias("src"), dst.alias("dst"), "rel", "first_seen", "last_seen", "method", edge_confidence(F.col("method")).alias("confidence"))
        meta = {"imported_redaction": manifest["redaction"]}
        out[m] = Store.empty(spark, m).having(metadata=meta, nodes=n.select(*[f.name for f in NODES]), edges=e.select(*[f.name for f in EDGES]))
    return out
