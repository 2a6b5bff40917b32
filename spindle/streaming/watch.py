"""Continuous ingestion: file streams into observations and updates.

State that must outlive a query is kept in the versioned tables, written by foreachBatch and keyed by node and day, so a
batch that runs twice changes nothing. A burst of changes is a session window: it ends once nothing follows for `gap`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import basename
from ..operators.temporal import recorded
from ..schema import OBSERVATIONS
from ..shared import workspace

DEBOUNCE = "1500 milliseconds"
#: A store's own files, which must not trigger it.
OWN_FILES = r"(?:^|/)(?:_CURRENT|_LOCK|v\d+)(?:/|$)|-(?:wal|shm)$|\.(?:lock|crc)$"


def relevant(events: DataFrame, classifier=None) -> DataFrame:
    """Events (path, ...) that are neither of the store's own files nor of excluded paths."""
    own = events.where(~F.col("path").rlike(OWN_FILES) & ~basename(F.col("path")).isin("", "."))
    return own if classifier is None else classifier.classify(own).where("label <> 'EXCLUDED'").select(*events.columns)


def bursts(events: DataFrame, gap: str = DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """events: (ts, path). One row for each burst: its begin, end and number of paths; works on streams and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    burst = marked.groupBy(F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.approx_count_distinct("path").alias("paths"))
    return burst.select(F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events", "paths")


def watch(source: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs `update` on each micro-batch of a stream; without `every` once over all there is. The checkpoint catches up after a stop."""
    writer = source.writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else update(df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_tree(spark: SparkSession, look: Callable[[], object], checkpoint: str, every: str = DEBOUNCE) -> StreamingQuery:
    """Calls `look` at every tick. A stream of files knows new ones only; a look that compares a scan with what is stored sees edits
    and removals too, catches up after any stop and joins what happened between two ticks. The store's own files are no matter,
    as they aren't of any model's partition."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _df, _n: look() and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class ObservationTable:
    """Observations in folders of versions, each of the months that a batch touched, whole.

    A version counts once its manifest stands: a small file that names the version of every month, renamed into place
    after the rows are written. A new object on the same folder, as after a restart, goes on from the last manifest; a batch
    that runs again merges rows that are already there, which changes nothing; one that broke off left no manifest.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._root = self._at("")
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _named(self, pattern: str) -> list[int]:
        """The numbers of the entries whose name is the pattern and a number."""
        found = self._fs.globStatus(self._at(f"{pattern}*")) or []
        names = [f.getPath().getName().removeprefix(pattern) for f in found]
        return sorted(int(n) for n in names if n.isdigit())

    @property
    def version(self) -> int:
        return max(self._named("manifest-"), default=-1)

    def _manifest(self, version: int) -> dict[str, int]:
        if version < 0:
            return {}
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._at(f"manifest-{version}")), "UTF-8"))

    def _months(self, manifest: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/v{v}/month={m}" for m, v in sorted(manifest.items())]
        return self.spark.read.schema(OBSERVATIONS).parquet(*paths) if paths else self.spark.createDataFrame([], OBSERVATIONS)

    def read(self) -> DataFrame:
        return self._months(self._manifest(self.version))

    def merge(self, new: DataFrame, batch: int) -> None:
        """new: observations with `seq`. Only the months of its days are read and written again."""
        new = new.persist()
        try:
            month = F.substring("seen_date", 1, 7)
            touched = [r["m"] for r in new.select(month.alias("m")).distinct().collect()]  # a row for each month
            last = self.version
            manifest = self._manifest(last)
            old = self._months({m: v for m, v in manifest.items() if m in touched})
            recorded(old, new).withColumn("month", month).repartition("month", F.pmod(F.xxhash64("node_id"), F.lit(8))).write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/v{last + 1}")
        finally:
            new.unpersist()
        written = self._at(f".manifest-{last + 1}")
        out = self._fs.create(written, True)
        out.write(bytearray(json.dumps(manifest | dict.fromkeys(touched, last + 1)).encode()))
        out.close()
        self._fs.rename(written, self._at(f"manifest-{last + 1}"))
        self._forget(last)

    def _forget(self, upto: int) -> None:
        """Removes manifests before `upto`, which readers may still hold, and versions that neither it nor a later one names."""
        kept = {v for n in self._named("manifest-") if n >= upto for v in self._manifest(n).values()}
        for n in self._named("manifest-"):
            if n < upto:
                self._fs.delete(self._at(f"manifest-{n}"), False)
        for v in self._named("v"):
            if v not in kept:
                self._fs.delete(self._at(f"v{v}"), True)


def stream_to_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files, merged into observations."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", "8").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(
        F.col("user_id").alias("node_id"), F.date_format("ts", "yyyy-MM-dd").alias("seen_date"), F.col("props").alias("content_hash"),
        F.floor(F.col("value") * 100).cast("long").alias("size"), F.col("event_id").alias("seq"),
    )
    at = workspace(spark, "observations")
    out = ObservationTable(spark, at)
    watch(rows, out.merge, f"{at}/checkpoint").awaitTermination()
    return out.read()
