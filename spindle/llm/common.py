"""What the operators share: word splitting, the held-out fold, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters; ``bytes.split()`` splits on exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` has in no case of letters, for what is joined to it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    Where spark.checkpoint.dir is unset a folder of our own is set, if the session runs on one machine; else that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spindle-", dir=_own_root())
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_root() -> str:
    root = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(root, exist_ok=True)
    return root


#: Paths of the tables that `written` made and nobody removed yet.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, so lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that `written` makes inside, at its end; what is returned from inside must not read them later."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        gone, _WRITTEN[before:] = _WRITTEN[before:], []
        _remove(spark, gone)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written; the tables that were written for it go."""
    before = len(_WRITTEN)
    out = written(make(), name)
    gone, _WRITTEN[before:] = _WRITTEN[before:-1], _WRITTEN[-1:]
    _remove(out.sparkSession, gone)
    return out


#: Rows of a broadcast table of a few fixed-width columns: some 15 MB in memory (145 bytes a row of two longs, as measured), which the driver holds more than once.
NARROW_ROWS = 100_000

#: Bitmaps of 4 kB, each of 32768 row numbers, that may go to every task.
BITMAPS = 4096


def narrow(df: DataFrame, name: str, rows: int = NARROW_ROWS) -> DataFrame:
    """`df`, of a few fixed-width columns, written; with a broadcast hint only if its rows, counted, are within `rows`."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def picked(df: DataFrame, rows: DataFrame, name: str, others: bool = False, bitmaps: int = BITMAPS) -> DataFrame:
    """Those of `df` whose number `row` is in `rows` (one long column, `row`), or with `others` those whose number isn't.

    Numbers go to every task as bitmaps, of which tables numbered in order have few: some bits a row of `df`, whatever the rows
    are. Where the bitmaps, as counted, are more than `bitmaps`, both sides are shuffled.
    """
    bits = rows.where("row is not null").groupBy(F.bitmap_bucket_number("row").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("__bits"))
    bits = written(bits, name)
    if bits.limit(bitmaps + 1).count() > bitmaps:
        return df.join(rows, "row", "left_anti" if others else "left_semi")
    met = df.withColumn("__bucket", F.bitmap_bucket_number("row")).join(F.broadcast(bits), "__bucket", "left")
    at = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return met.where(~held if others else held).select(*df.columns)


def row_key(id_col: str, text_col: str) -> Column:
    """A string that is equal for rows of the same id and text only (up to 64 bits of the text's hash), also where either is null."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    return F.concat_ws(":", part(F.col(id_col).cast("string")), part(F.hex(F.xxhash64(F.col(text_col).cast("string")))))
