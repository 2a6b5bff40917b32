"""A store: one model's tables as versioned Parquet.

A commit writes the tables into a new folder and then swaps one pointer file, so that readers see the old or the new
state and an interrupted write leaves nothing behind. One writer at a time holds a lock file; a second one is refused.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EmbeddingRefused, Locked, ModelUnavailable, Refused
from .operators.search import Index
from .schema import SCHEMA_VERSION, TABLES, edge_confidence, edge_id, node_id, title_confidence

KEEP_VERSIONS = 2


@dataclass(frozen=True)
class Store:
    """Tables of one state. Every operation returns another store; only commit() touches the disk."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    metadata: dict[str, str] = field(default_factory=dict)
    path: str | None = None
    at: str | None = None  # the folder of the version that the nodes are read from

    @classmethod
    def empty(cls, spark: SparkSession, model: str | None = None) -> Store:
        return cls(spark, {n: spark.createDataFrame([], s) for n, s in TABLES.items()}, {"schema_version": str(SCHEMA_VERSION)} | ({"model": model} if model else {}))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        pointer = Path(path, "_CURRENT")
        if not pointer.is_file():
            raise ModelUnavailable(f"no store at {path}")
        at = Path(path, pointer.read_text().strip())
        meta = json.loads((at / "metadata.json").read_text())
        if int(meta.get("schema_version", 0)) > SCHEMA_VERSION:
            raise Refused(f"{path} has schema {meta['schema_version']}, newer than {SCHEMA_VERSION}")
        return cls(spark, {n: spark.read.schema(s).parquet(str(at / n)) for n, s in TABLES.items()}, meta, path, str(at))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.tables[name]
        raise AttributeError(name)

    def having(self, metadata: dict[str, str] | None = None, **tables: DataFrame) -> Store:
        checked = {n: t.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[n]]) for n, t in tables.items()}
        return replace(self, tables=self.tables | checked, metadata=self.metadata | (metadata or {}), at=None if "nodes" in checked else self.at)

    def commit(self, path: str | None = None) -> Store:
        """Writes all tables and swaps the pointer; returns the store as read back."""
        path = path or self.path
        if path is None:
            raise Refused("a store needs a path to be committed to")
        name = f"v{uuid.uuid4().hex}"
        at = Path(path, name)
        at.mkdir(parents=True)
        try:
            for n, t in self.tables.items():
                t.write.parquet(str(at / n))
            (at / "metadata.json").write_text(json.dumps(self.metadata, sort_keys=True, ensure_ascii=False))
        except BaseException:
            shutil.rmtree(at, ignore_errors=True)
            raise
        before = Path(path, "_CURRENT")
        old = before.read_text().strip() if before.is_file() else None
        swap = Path(path, f"_CURRENT.{uuid.uuid4().hex}")
        swap.write_text(name)
        os.replace(swap, before)
        for stale in sorted(Path(path).glob("v*"), key=os.path.getmtime)[:-KEEP_VERSIONS]:
            if stale.name not in (name, old):
                shutil.rmtree(stale, ignore_errors=True)
        return Store.open(self.spark, path)

    def index(self) -> Index:
        """The index of the nodes. That of a committed version is written into its folder by the first search and read by later ones."""
        if self.at is None:
            return Index.of(self.nodes)
        written = Path(self.at, "index")
        if not written.is_dir():
            made = Path(self.at, f"index.{uuid.uuid4().hex}")
            Index.of(self.nodes).write(str(made))
            try:
                made.rename(written)
            except OSError:  # another search was first
                shutil.rmtree(made, ignore_errors=True)
        return Index.read(self.spark, str(written))

    def get_node(self, key: str) -> dict | None:
        row = self.nodes.where(F.col("node_key") == key).first()
        return row.asDict() if row else None

    def with_embeddings(self, rows: DataFrame, namespace: tuple[str, str, int]) -> Store:
        """Upserts vectors (node_id, vec) of one namespace; a vector of another length is refused."""
        provider, model, dim = namespace
        wrong = rows.where(F.size("vec") != dim).limit(1).collect()
        if wrong:
            raise EmbeddingRefused(f"a vector has {len(wrong[0]['vec'])} values, not {dim}")
        new = rows.select("node_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.col("vec").cast("array<float>").alias("vec"))
        return self.having(embeddings=self.embeddings.join(rows.select("node_id"), "node_id", "left_anti").unionByName(new))

    def without(self, key: str) -> Store:
        """The store without a node and all that hangs on it."""
        gone = F.xxhash64(F.lit(key))
        return self.having(
            nodes=self.nodes.where(F.col("node_key") != key), edges=self.edges.where((F.col("src") != gone) & (F.col("dst") != gone)),
            **{t: self.tables[t].where(F.col("node_id") != gone) for t in ("observations", "observations_monthly", "embeddings")},
        )


def as_nodes(rows: DataFrame, as_of: str) -> DataFrame:
    """Completes rows of (node_key, kind, ...) to node rows seen on a day. Of rows of one key the first by path and title counts."""
    have = rows.columns
    some = lambda name: F.col(name) if name in have else F.lit(None)
    given = {
        "id": node_id(F.col("node_key")), "first_seen": F.lit(as_of), "last_seen": F.lit(as_of), "activity_datelist": F.array().cast("array<string>"),
        "datelist_int": F.lit(0), "title_confidence": title_confidence(some("title_method").cast("string")),
    }
    full = rows.select(*[(given.get(f.name, some(f.name))).cast(f.dataType).alias(f.name) for f in TABLES["nodes"]])
    rest = [c for c in full.columns if c != "node_key"]
    return full.groupBy("node_key").agg(F.min_by(F.struct(*rest), F.struct(F.coalesce("path", F.lit("")), F.coalesce("title", F.lit("")))).alias("x")).select("node_key", "x.*").select(*full.columns)


def as_edges(rows: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """Edge rows of (src_key, dst_key, rel, method) whose ends are nodes; of several methods the surest counts."""
    keys = nodes.select("node_key")
    met = rows.join(keys.withColumnRenamed("node_key", "src_key"), "src_key", "left_semi").join(keys.withColumnRenamed("node_key", "dst_key"), "dst_key", "left_semi")
    one = met.withColumn("confidence", edge_confidence(F.col("method"))).groupBy("src_key", "dst_key", "rel").agg(F.max_by("method", "confidence").alias("method"), F.max("confidence").alias("confidence"))
    src, dst = node_id(F.col("src_key")), node_id(F.col("dst_key"))
    return one.select(edge_id(src, dst, F.col("rel")).alias("id"), src.alias("src"), dst.alias("dst"), "rel", F.lit(as_of).alias("first_seen"), F.lit(as_of).alias("last_seen"), "method", "confidence")


def _alive(pid: int, started: str) -> bool:
    return _started(pid) == started


def _started(pid: int) -> str | None:
    """When a process began, so that a reused number isn't taken for it."""
    try:
        return Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[19]
    except OSError:
        return None


@contextmanager
def locked(path: str) -> Iterator[None]:
    """Holds the writer's lock of a folder. Held by another living process it is refused, never waited for; of a dead one it is taken over."""
    Path(path).mkdir(parents=True, exist_ok=True)
    file, nonce = Path(path, "_LOCK"), uuid.uuid4().hex
    mine = json.dumps({"pid": os.getpid(), "started": _started(os.getpid()), "nonce": nonce})
    for _ in range(2):
        try:
            with open(file, "x") as f:
                f.write(mine)
            break
        except FileExistsError:
            try:
                other = json.loads(file.read_text())
                dead = not _alive(other["pid"], other["started"])
            except (ValueError, KeyError, OSError):
                raise Locked(f"{path} is locked by a file that can't be read") from None
            if not dead:
                raise Locked(f"{path} is being written by process {other['pid']}") from None
            file.unlink(missing_ok=True)
    if not file.is_file() or json.loads(file.read_text()).get("nonce") != nonce:
        raise Locked(f"{path} was locked by another process")
    try:
        yield
    finally:
        file.unlink(missing_ok=True)
