"""The folder that the driver and all executors share, what is kept there, and which tables are small enough for every task."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, as counted, that may go to every task.
BROADCAST_BYTES = 64 << 20


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster; a local one only where none is set and the session runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: plans that go on from it don't grow, and lost executors cost nothing before it."""
    at = workspace(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its size, counted in one pass, is within BROADCAST_BYTES."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, kind in df.dtypes if kind not in ("int", "bigint", "double", "boolean", "date")]
    size = sum(wide, F.lit(24 + 16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df
