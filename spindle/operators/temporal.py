"""Observations, activity masks and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import RETENTION_DAYS, mask, month, overlap


def recorded(observations: DataFrame, new: DataFrame) -> DataFrame:
    """Observations with `new` (same columns, and `seq` as order of arrival) put in: one row a node and day, the latest arrival counts."""
    old = observations.select("node_id", "seen_date", "content_hash", "size", F.lit(-1).cast("long").alias("seq"))
    every = old.unionByName(new.select("node_id", "seen_date", "content_hash", "size", F.col("seq").cast("long")))
    last = F.max_by(F.struct("content_hash", "size"), F.struct("seq", "content_hash", "size"))
    return every.groupBy("node_id", "seen_date").agg(last.alias("x")).select("node_id", "seen_date", "x.content_hash", "x.size")


def datelists(observations: DataFrame, anchor: str) -> DataFrame:
    """(node_id, dates, datelist_int, anchor): all days and the mask of the window that ends at the anchor."""
    return observations.groupBy("node_id").agg(
        F.sort_array(F.collect_set("seen_date")).alias("dates"), mask(F.col("seen_date"), F.lit(anchor)).alias("datelist_int")
    ).withColumn("anchor", F.lit(anchor))


def refreshed(nodes: DataFrame, observations: DataFrame, anchor: str, only_anchored: bool = False) -> DataFrame:
    """Nodes with their day list, mask and anchor; `only_anchored` leaves nodes that never had an anchor alone."""
    lists = datelists(observations, anchor).select(F.col("node_id").alias("id"), F.col("dates").alias("__d"), F.col("datelist_int").alias("__m"))
    skip = F.col("datelist_anchor").isNull() if only_anchored else F.lit(False)
    return nodes.join(lists, "id", "left").withColumns(
        {
            "activity_datelist": F.when(skip, F.col("activity_datelist")).otherwise(F.coalesce("__d", F.array().cast("array<string>"))),
            "datelist_int": F.when(skip, F.col("datelist_int")).otherwise(F.coalesce("__m", F.lit(0).cast("long"))),
            "datelist_anchor": F.when(skip, F.col("datelist_anchor")).otherwise(F.lit(anchor)),
        }
    ).select(*nodes.columns)


def retained(observations: DataFrame, monthly: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(observations, monthly): days before the cutoff are summed up by month and dropped.

    Months merge additively: change days add up, the size is the largest, the hash is of the latest day.
    """
    cutoff = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    old = observations.where(F.col("seen_date") < cutoff)
    sums = rolled_up(old)
    both = monthly.select("*", F.lit(0).alias("__o")).unionByName(sums.select("*", F.lit(1).alias("__o")))
    merged = both.groupBy("node_id", "month").agg(
        F.sum("change_days").cast("int").alias("change_days"), F.max_by("last_hash", "__o").alias("last_hash"), F.max("max_size").alias("max_size")
    )
    return observations.where(F.col("seen_date") >= cutoff), merged


def rolled_up(observations: DataFrame) -> DataFrame:
    """(node_id, month, change_days, last_hash, max_size)."""
    return observations.groupBy("node_id", month(F.col("seen_date")).alias("month")).agg(
        F.count("*").cast("int").alias("change_days"), F.max_by("content_hash", "seen_date").alias("last_hash"), F.max("size").alias("max_size")
    )


def shared_days(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """(a, b, days): days that the two nodes of each given pair share; pairs whose masks have different anchors don't compare."""
    x = masks.select(F.col("node_id").alias("a"), F.col("datelist_int").alias("ma"), F.col("anchor").alias("at"))
    y = masks.select(F.col("node_id").alias("b"), F.col("datelist_int").alias("mb"), F.col("anchor").alias("bt"))
    return pairs.join(x, "a").join(y, "b").where("at = bt").select("a", "b", overlap(F.col("ma"), F.col("mb")).alias("days"))
