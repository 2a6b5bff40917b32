"""Documents to training mix: rules, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import picked, scratch, settled, shared_dir, table, written
from spindle.llm.decontaminate import decontaminate
from spindle.llm.jaccard import near_groups
from spindle.llm.line_dedup import line_dedup
from spindle.llm.mixing import mix
from spindle.llm.quality_rules import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, each judged by its own text, also of null or repeated ids. Texts are not shuffled."""
    judged = quality_rules(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), carry=True)
    return judged.where("kept").select("text", "carried.*").select(*COLUMNS)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a smaller (doc_id, line) holds, whatever is around them; n_chars follows the text.

    A window is one line with a word here, of any length, so longer runs go as the sum of their lines.
    """
    return line_dedup(docs, run_chars=1).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 0.8 or more over five-word windows reach, met by SimHash in covering tables and verified: that of the smallest id, null last; of
    equal ids that of the smallest text hash, of equal rows any one. Only the numbers of the others are joined back."""
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = settled(lambda: near_groups(rows), "groups")
    places = rows.select("row", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("text"), "row").alias("place"))
    many = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    crowd = groups.join(written(many, "groups-of-many").hint("merge"), "group").join(places.hint("merge"), "row")
    firsts = written(crowd.groupBy("group").agg(F.min("place").alias("first")).select("first.row"), "firsts")
    others = crowd.select("row").join(firsts.hint("merge"), "row", "left_anti")
    return picked(rows, others, "others", others=True).select(*COLUMNS)


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    return mix(docs)


STAGES = [
    ("quality_rules", stage_rules),
    ("line_dedup", stage_lines),
    ("simhash_near_dedup", stage_near),
    ("benchmark_decontamination", stage_benchmark),
    ("mix_sources", stage_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # what a stage wrote for itself goes when its output is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Certified cutoffs and fingerprint groups have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
