"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import dirname

TOP_DIRECTORIES, COLD_DAYS, ROLE_LEAST, ROLE_SHARE = 20, 90, 3, 0.5


def census(decided: DataFrame) -> DataFrame:
    """(label, subtype, layer, n) of decisions."""
    return decided.groupBy("label", "subtype", "layer").agg(F.count("*").alias("n"))


def excluded_directories(decided: DataFrame, top: int = TOP_DIRECTORIES) -> tuple[DataFrame, bool]:
    """The directories with most excluded files, and whether there are more than are listed."""
    counts = decided.where("label = 'EXCLUDED'").groupBy(dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "dir")
    return ordered.limit(top), ordered.limit(top + 1).count() > top


def cold_rollup(files: DataFrame, as_of: str, days: int = COLD_DAYS) -> tuple[DataFrame, DataFrame]:
    """files: (path, app, mtime, size, detected) -> warm files, and (app, month, files, bytes, detected) of the cold ones.

    detected is the most common type; ties go to the type of the smallest path.
    """
    day = F.to_date(F.timestamp_seconds("mtime"))
    cold = day < F.date_sub(F.lit(as_of).cast("date"), days)
    per = files.where(cold).groupBy("app", F.date_format(day, "yyyy-MM").alias("month"), "detected").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("path").alias("p"))
    sums = per.groupBy("app", "month").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.min_by("detected", F.struct(-F.col("n"), "p")).alias("detected"))
    return files.where(~cold), sums


def document_status(documents: DataFrame) -> DataFrame:
    """(doctype, status, n)."""
    return documents.groupBy("doctype", "status").agg(F.count("*").alias("n"))


def error_rate(documents: DataFrame) -> float:
    """Share of documents that are corrupt or have no extractor; 0 of none."""
    row = documents.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("corrupt", "missing_extractor")).alias("bad")).first()
    return row["bad"] / row["n"] if row["n"] else 0.0


def status(nodes: DataFrame, edges: DataFrame, observations: DataFrame, embeddings: DataFrame | None, indexed: int) -> dict:
    """What a store holds."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count("path").alias("with_path"), F.min("first_seen").alias("first"), F.max("last_seen").alias("last"), F.count_distinct("subtype").alias("labels")).first()
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") < 1).alias("uncertain"), F.count_distinct("rel").alias("relations")).first()
    return {
        "nodes": n["nodes"], "nodes_with_path": n["with_path"], "derived": n["nodes"] - n["with_path"], "labels": n["labels"],
        "edges": e["edges"], "uncertain_edges": e["uncertain"], "relations": e["relations"], "first_seen": n["first"], "last_seen": n["last"],
        "observations": observations.count(), "indexed": indexed, "embedded": None if embeddings is None else embeddings.count(),
    }


def dominant_roles(files: DataFrame, least: int = ROLE_LEAST, share: float = ROLE_SHARE) -> DataFrame:
    """files: (dir, category, counted) -> (dir, category, n, total): the category with more than `share` of all files, of `least` counted ones or more; a tie has none."""
    per = files.groupBy("dir", "category").agg(F.count("*").alias("n"), F.count_if(F.col("counted")).alias("c"))
    every = per.withColumn("total", F.sum("n").over(W.partitionBy("dir")))
    return every.where((F.col("c") >= least) & (F.col("n") > share * F.col("total"))).select("dir", "category", "n", "total")
