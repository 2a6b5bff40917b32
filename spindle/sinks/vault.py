"""A vault of notes: one Markdown file for each node, with links between them, written by the executors."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ExportError

NAME_BYTES, TAIL = 180, 8


def _cut(text: str, size: int) -> str:
    return text.encode()[:size].decode(errors="ignore")


def safe_name(title: str, key: str) -> str:
    """A file name of a title: no characters that file systems or links reserve, no dots or spaces at its ends."""
    name = re.sub(r'[\\/:*?"<>|#^\[\]\x00-\x1f]+', " ", title or "")
    return _cut(" ".join(name.split()), NAME_BYTES).strip(" .") or hashlib.sha256(key.encode()).hexdigest()[:TAIL]


def named(nodes: DataFrame) -> DataFrame:
    """nodes with `note`: the safe name, with a digest of the key where several have it (case ignored)."""
    safe = F.udf(safe_name, "string", useArrow=True)
    base = nodes.withColumn("__s", safe(F.coalesce("title", "node_key"), F.col("node_key")))
    alone = F.count("*").over(W.partitionBy(F.lower("__s"))) == 1
    tail: Column = F.concat(F.lit(" ("), F.substring(F.sha2("node_key", 256), 1, TAIL), F.lit(")"))
    return base.withColumn("note", F.when(alone, F.col("__s")).otherwise(F.concat("__s", tail))).drop("__s")


def scalar(value: object) -> str:
    """A value as it stands in front matter; texts that could be read as anything else are quoted."""
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return json.dumps(value)
    plain = re.fullmatch(r"[A-Za-z][\w /.-]*", str(value)) and str(value).lower() not in ("true", "false", "null", "yes", "no", "on", "off")
    return str(value) if plain and str(value).strip() == value else json.dumps(str(value), ensure_ascii=False)


def note_text(row: dict) -> str:
    front = "".join(f"{k}: {scalar(row[k])}\n" for k in ("node_key", "kind", "subtype", "path", "first_seen", "last_seen") if row.get(k) is not None)
    groups: dict[str, list[str]] = {}
    for x in sorted(row["links"] or [], key=lambda x: (x["rel"], x["note"])):
        groups.setdefault(x["rel"], []).append(f"- [[{x['note']}]]" + ("" if x["confidence"] >= 1 else f" ({x['method']} {x['confidence']:.1f})"))
    links = "".join(f"\n## {rel}\n\n" + "\n".join(own) + "\n" for rel, own in groups.items())
    return f"---\n{front}---\n\n# {row['title'] or row['node_key']}\n{links}"


def export_vault(nodes: DataFrame, edges: DataFrame, folder: str) -> int:
    """Writes one note for each node and returns their number; a folder that isn't empty is refused. The folder must be shared by all executors."""
    if os.path.isdir(folder) and os.listdir(folder):
        raise ExportError(f"{folder} is not empty")
    os.makedirs(folder, exist_ok=True)
    notes = named(nodes.select("id", "node_key", "kind", "subtype", "path", "title", "first_seen", "last_seen"))
    to = edges.join(notes.select(F.col("id").alias("dst"), F.col("note").alias("to")), "dst")
    links = to.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("rel", F.col("to").alias("note"), "method", "confidence")).alias("links"))  # a node's own edges
    every = notes.join(links, "id", "left")

    def put(rows) -> None:
        for r in rows:
            with open(os.path.join(folder, r["note"] + ".md"), "w", encoding="utf-8") as f:
                f.write(note_text(r.asDict(recursive=True)))

    every.foreachPartition(put)
    return notes.count()
