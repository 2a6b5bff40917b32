"""URL filters over sorted digest arrays.

A list of rules (host and path prefix, allow or block) becomes files, each of the 64-bit
xxhash keys in sorted order, then the strings themselves. They are written to the
shared folder and handed out by Spark; workers memory-map them, so their pages are shared by
the workers of a machine and only what is probed is read. A batch of URLs makes all its
candidate keys, every host suffix and every path length that the list has, and probes them
with one vectorised binary search a file; a hit counts only if the stored string is equal.

A list in a table is dealt by crc32 into files of some SHARD_ROWS entries, which tasks pack; the driver passes them on one
at a time, so a list is bounded by the executors' disks. Pages are not shuffled and nothing is broadcast.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, table, written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts blocked with all subdomains where no rule fits.
BLOCKED = (
    "casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com",
    "ads-track.example.com", "spam-farm.example.com", "adult-x.example.net",
)
SHARD_ROWS = 1_000_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed_list(entries: list[tuple[str, str]]) -> bytes:
    """The file of a list: a JSON header line, keys, offsets, verdict bits and strings. Of repeated entries the first counts."""
    unique = list({s: v for s, v in reversed(entries)}.items())
    raw = [s.encode() for s, _ in unique]
    keys = np.array([xxhash.xxh64_intdigest(s) for s in raw], np.uint64)
    order = np.argsort(keys, kind="stable")
    raw = [raw[i] for i in order]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in raw])]).astype(np.int64)
    block = np.array([unique[i][1] == "block" for i in order], np.uint8)
    paths = sorted({len(s) - len(s.partition("/")[0]) for s, _ in unique})
    hosts = sorted({len(s.partition("/")[0]) for s, _ in unique})
    head = json.dumps({"n": len(raw), "paths": paths, "hosts": hosts}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + keys[order].tobytes() + offsets.tobytes() + block.tobytes() + b"".join(raw)


class DigestList:
    """A packed list, memory-mapped."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            head = f.readline()
        meta = json.loads(head)
        self.paths, self.hosts, n = meta["paths"], set(meta["hosts"]), meta["n"]
        self._map = np.memmap(path, np.uint8, "r")
        at = len(head)
        self.keys = self._map[at : at + 8 * n].view(np.uint64)
        self.offsets = self._map[at + 8 * n : at + 16 * n + 8].view(np.int64)
        self.block = self._map[at + 16 * n + 8 : at + 17 * n + 8]
        self.strings = self._map[at + 17 * n + 8 :]

    def probe(self, candidates: list[bytes]) -> list[int]:
        """For each candidate its place in the list, or -1."""
        if not candidates or not len(self.keys):
            return [-1] * len(candidates)
        want = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, want)
        found = np.full(len(want), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == want[i]:  # equal keys stand together; the string decides
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found.tolist()


class DigestLists:
    """The files of one list: an entry is in that of its crc32."""

    def __init__(self, paths: list[str]) -> None:
        self.parts = [DigestList(p) for p in paths]
        self.paths = sorted({n for p in self.parts for n in p.paths})
        self.hosts = {n for p in self.parts for n in p.hosts}

    def probe(self, candidates: list[bytes]) -> list[bool | None]:
        """For each candidate whether its entry blocks, or None if there is none."""
        found: list[bool | None] = [None] * len(candidates)
        own: list[list[int]] = [[] for _ in self.parts]
        for i, c in enumerate(candidates):
            own[crc32(c) % len(self.parts)].append(i)
        for part, at in zip(self.parts, own, strict=True):
            for i, j in zip(at, part.probe([candidates[i] for i in at]), strict=True):
                if j >= 0:
                    found[i] = bool(part.block[j])
        return found


def _matches(lists: DigestLists, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
    """For each URL the longest entry that fits (of equal lengths, the one of the longer host) and whether it blocks.

    Only suffixes and prefixes of lengths that the list has are made, so a URL of any length makes few.
    """
    candidates: list[str] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        at = 0
        while True:
            if len(host) - at in lists.hosts:
                own = [host[at:] + path[:n] for n in lists.paths if len(path) >= n]
                candidates += own
                owner += [i] * len(own)
            at = host.find(".", at) + 1
            if not at:
                break
    best: list[tuple[str, bool] | None] = [None] * len(hosts)
    for i, c, blocks in zip(owner, candidates, lists.probe([c.encode() for c in candidates]), strict=True):
        if blocks is not None and (best[i] is None or len(c) > len(best[i][0])):
            best[i] = (c, blocks)
    return best


def _handed_out(spark: SparkSession, data: bytes) -> str:
    """Puts a file into the shared folder and has Spark give it to every executor; its name there."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    at = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(at)
    return name


def listed(spark: SparkSession, entries: tuple | list | DataFrame, shard_rows: int = SHARD_ROWS) -> list[str]:
    """The names of the files of a list: pairs of entry and verdict, or a table of columns entry and verdict.

    Of repeated entries the first counts, in a table that which allows. Null entries are left out.
    """
    if not isinstance(entries, DataFrame):
        return [_handed_out(spark, packed_list(list(entries)))]
    unique = written(entries.where("entry is not null").groupBy("entry").agg(F.min("verdict").alias("verdict")), "list")
    n = max(1, -(-unique.count() // shard_rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = -1, []
        for b in batches:
            for shard, entry, verdict in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != at and own:
                    yield pa.RecordBatch.from_pydict({"shard": [at], "data": [packed_list(own)]})
                    own = []
                at = shard
                own.append((entry, verdict))
        if own:
            yield pa.RecordBatch.from_pydict({"shard": [at], "data": [packed_list(own)]})

    dealt = unique.select((F.crc32(F.col("entry").cast("binary")) % n).alias("shard"), "entry", "verdict").repartition(n, "shard").sortWithinPartitions("shard")
    packed = written(dealt.mapInArrow(pack, "shard long, data binary"), "packed-list")
    files = {r["shard"]: _handed_out(spark, bytes(r["data"])) for r in packed.toLocalIterator()}
    empty = None if len(files) == n else _handed_out(spark, packed_list([]))
    return [files.get(i, empty) for i in range(n)]


def url_filter(pages: DataFrame, url_col: str = "url", rules: tuple | DataFrame = RULES, blocked: tuple | DataFrame = BLOCKED) -> DataFrame:
    """All columns of `pages` plus host, path, rule and verdict.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or
    the end. A rule fits its host and subdomains where the path starts with its own; the longest one decides.
    Where none fits, `rule` is null and the block list of hosts decides, allowing what it doesn't hold. A null
    URL or one without `://` has an empty host and path, fits only what an empty host fits, and is allowed.
    `rules` are pairs, or a table, of entry and verdict; `blocked` are hosts, or a table with a column host. Repeated rows are judged each; an empty table gives an empty one; columns of the four new names are replaced.
    """
    spark = pages.sparkSession
    rule_files = listed(spark, rules)
    block_files = listed(spark, blocked.select(F.col("host").alias("entry"), F.lit("block").alias("verdict")) if isinstance(blocked, DataFrame) else [(h, "block") for h in blocked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled, bad_hosts = (DigestLists([SparkFiles.get(f) for f in names]) for names in (rule_files, block_files))
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            best, bad = _matches(ruled, hosts, paths), _matches(bad_hosts, hosts, paths)
            verdicts = ["block" if (x[1] if x else y is not None) else "allow" for x, y in zip(best, bad, strict=True)]
            new = [pa.array([x and x[0] for x in best], pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "rule", "verdict"])

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    cut = pages.withColumn("__url", url).withColumn("__rest", F.when(F.col("__url").contains("://"), F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(""))
    cut = cut.select(
        *own,
        F.translate(F.regexp_extract("__rest", "^[^/?#]*", 0), *_LOWER).alias("host"),
        F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    schema = T.StructType([*cut.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return cut.mapInArrow(run, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


_VALUES = ", ".join(f"('{s}', '{v}')" for s, v in RULES)
_HOSTS = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in BLOCKED)
QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {
    "op6_url_filter": f"""
with r as (select rule, verdict, split_part(rule, '/', 1) as rule_host, substr(rule, length(split_part(rule, '/', 1)) + 1) as rule_path from (values {_VALUES}) t(rule, verdict)),
u as (select page_id, row_number() over () as n, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select p.n, r.rule, r.verdict, row_number() over (partition by p.n order by length(r.rule) desc, length(r.rule_host) desc) as k
      from p join r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path))
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, case when {_HOSTS} then 'block' else 'allow' end) as verdict
from p left join m on p.n = m.n and m.k = 1"""
}
