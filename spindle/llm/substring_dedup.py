"""Substring dedup by super-k-mer partitioning.

A window is `k` consecutive words. Its minimiser is the smallest hash among its m-word
sequences, so equal windows have equal minimisers; consecutive windows of one minimiser
make a super-k-mer, which is described by its first window and their number. Of these
descriptions only those whose minimiser is found in two documents or more go on: they travel
as one packed string (the words, joined) to the minimiser's bucket, where sorting the
windows finds each one's smallest document. The rest of the corpus never travels packed.

A minimiser with more than HOT super-k-mers would make a bucket of unbounded size (copies and
passages of a third of all documents). Its packed strings are first made distinct, which combines
before the shuffle: whoever is not the first to hold one loses all its windows. The distinct
ones are cut again by the longer minimisers of LONGER words, into buckets that are sorted in the same way; what is
crowded even there travels window by window, each its own bucket, and is combined before the shuffle.
Windows are compared as strings everywhere, so equality is exact in hot buckets too.

Documents are shuffled by id for cutting and again for removal (one exchange in a plan that reuses it).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

K, M, LONGEST, HOT, LONGER = 50, 8, 256, 1024, (24,)


def super_kmers(ws: list[bytes], k: int = K, m: int = M, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of a word list."""
    n = len(ws)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    c = np.fromiter(map(crc32, ws), np.uint64, n)
    g = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        g = (g ^ c[j : j + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    width, size = k - m + 1, 1
    while size * 2 <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    if width > size:
        g = np.minimum(g[: len(g) - (width - size)], g[width - size :])
    starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
    counts = np.diff(np.append(starts, len(g)))
    while (counts > longest).any():
        at = int(np.argmax(counts > longest))
        cut = np.arange(starts[at], starts[at] + counts[at], longest)
        starts = np.concatenate([starts[:at], cut, starts[at + 1 :]])
        counts = np.diff(np.append(starts, len(g)))
    return g[starts].view(np.int64), starts.astype(np.int32), counts.astype(np.int32)


def _binary(c: pa.Array) -> pa.Array:
    return c.cast(pa.binary() if pa.types.is_string(c.type) else pa.large_binary())


def _describe(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = [], []
            for i, t in enumerate(_binary(b.column(2))):
                mini, s, c = super_kmers((t.as_py() or b"").split(), k, m)
                if len(s):
                    found.append((mini, s, c))
                    at.append(np.full(len(s), i))
            if found:
                idx = pa.array(np.concatenate(at))
                cols = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([cols[0], b.column(0).take(idx), b.column(1).take(idx), cols[1], cols[2]], names=["mini", "doc_id", "row", "s", "c"])

    return run


def _pack(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for d, r, t, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _binary(b.column(2)), b.column(3), strict=True):
                if not spans.is_valid:
                    continue
                ws = t.as_py().split()
                for x in spans.as_py():
                    row = (x["mini"], d, r, x["s"], x["c"], x["hot"], b" ".join(ws[x["s"] : x["s"] + x["c"] + k - 1]))
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                if len(out[0]) > 20_000:
                    yield _packed(out)
                    out = [[], [], [], [], [], [], []]
            if out[0]:
                yield _packed(out)

    return run


def _packed(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["mini", "doc_id", "row", "s", "c", "hot", "packed"])


def window_slices(packed: bytes, k: int = K) -> list[bytes]:
    """The windows of a packed string, in order."""
    ws = packed.split(b" ")
    lens = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lens + 1) - 1
    return [packed[i:j] for i, j in zip((ends - lens)[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def _ranges(at: np.ndarray, first: int, k: int) -> list[int]:
    """Flat [from, to, ...] of the words that the windows first + at cover."""
    cuts = np.flatnonzero(np.diff(at) > 1)
    lo, hi = np.append(at[0], at[cuts + 1]), np.append(at[cuts], at[-1])
    return np.stack([lo + first, hi + first + k], axis=1).ravel().tolist()


def _count(part: pd.DataFrame, k: int) -> tuple[list, list, list]:
    """One minimiser's super-k-mers, sorted by packed string and document: the ranges to remove."""
    docs, rows, firsts, packs = part["doc_id"].tolist(), part["row"].tolist(), part["s"].tolist(), part["packed"].tolist()
    if len(set(docs)) < 2:
        return [], [], []
    heads = [i for i in range(len(packs)) if not i or packs[i] != packs[i - 1]]  # the smallest document of each distinct string
    slices = {packs[i]: window_slices(packs[i], k) for i in heads}
    if len(heads) == 1:
        least = {packs[0]: np.full(len(slices[packs[0]]), docs[0])}
    else:
        first: dict[bytes, int] = {}
        for w, d in sorted((w, docs[i]) for i in heads for w in slices[packs[i]]):
            first.setdefault(w, d)
        least = {p: np.array([first[w] for w in ws]) for p, ws in slices.items()}
    out: tuple[list, list, list] = ([], [], [])
    for d, r, s, p in zip(docs, rows, firsts, packs, strict=True):
        at = np.flatnonzero(least[p] < d)
        if len(at):
            for o, v in zip(out, (d, r, _ranges(at, s, k)), strict=True):
                o.append(v)
    return out


def _bucket(k: int):
    def frame(out: tuple[list, list, list]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": out[0], "row": out[1], "gone": out[2]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for part in parts:
            if carry is not None:
                part = pd.concat([carry, part], ignore_index=True)
            mini = part["mini"].to_numpy()
            at, out = 0, ([], [], [])
            for end in np.flatnonzero(mini[1:] != mini[:-1]) + 1:
                if end - at > 1:
                    for o, v in zip(out, _count(part.iloc[at:end], k), strict=True):
                        o.extend(v)
                at = end
            carry = part.iloc[at:]
            if out[0]:
                yield frame(out)
        if carry is not None and len(carry) > 1:
            out = _count(carry, k)
            if out[0]:
                yield frame(out)

    return run


def _cut(k: int, m: int):
    """Packed strings, cut again into super-k-mers by minimisers of m words; their places follow on from that of the string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for d, r, base, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ws = p.split(b" ")
                for mini, s, c in zip(*(x.tolist() for x in super_kmers(ws, k, m)), strict=True):
                    for o, v in zip(out, (mini, d, r, base + s, b" ".join(ws[s : s + c + k - 1])), strict=True):
                        o.append(v)
                if len(out[0]) > 20_000:
                    yield _pieces(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _pieces(out)

    return run


def _pieces(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["mini", "doc_id", "row", "s", "packed"])


def _sorted_buckets(packed: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, gone) of packed strings, by sorting the windows of each minimiser's bucket."""
    dealt = packed.select("mini", "doc_id", "row", "s", "packed").repartition("mini").sortWithinPartitions("mini", "packed", "doc_id")
    return dealt.mapInPandas(_bucket(k), "doc_id long, row long, gone array<int>")


def _found_again(runs: DataFrame, hot: int, name: str) -> DataFrame:
    """(mini, hot): minimisers of two documents or more, and whether they have more than `hot` super-k-mers."""
    again = runs.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    return written(again.select("mini", (F.col("n") > hot).alias("hot")), name)


def _hot(packed: DataFrame, k: int, hot: int, longer: tuple[int, ...]) -> DataFrame:
    """(doc_id, row, gone) of the super-k-mers of hot minimisers."""
    heads = packed.groupBy("mini", "packed").agg(F.min("doc_id").alias("d0")).withColumn("head", F.monotonically_increasing_id())
    heads = written(heads, "distinct-packed")
    met = written(packed.join(heads, ["mini", "packed"]).select("doc_id", "row", "s", "c", "d0", "head"), "occurrences")
    gone = met.where("doc_id > d0").select("doc_id", "row", F.array(F.col("s"), F.col("s") + F.col("c") + (k - 1)).alias("gone"))
    left, inner = heads.select(F.col("d0").alias("doc_id"), F.col("head").alias("row"), F.lit(0).alias("s"), "packed"), None
    for m in longer:
        cut = written(left.mapInArrow(_cut(k, m), "mini long, doc_id long, row long, s int, packed binary"), "cut-again")
        cut = cut.join(_found_again(cut, hot, "longer-minimisers"), "mini")
        part = _sorted_buckets(cut.where("not hot"), k)
        inner = part if inner is None else inner.union(part)
        left = cut.where("hot").select("doc_id", "row", "s", "packed")
    windows = written(left.mapInArrow(_windows(k), "window binary, doc_id long, row long, s int"), "hot-windows")
    least = windows.groupBy("window").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("window", "x")
    late = windows.join(written(least, "least"), "window").where("doc_id > x").select("doc_id", "row", F.array(F.col("s"), F.col("s") + k).alias("gone"))
    inner = late if inner is None else inner.union(late)
    inner = written(inner.groupBy("row").agg(F.flatten(F.collect_list("gone")).alias("inside")), "head-ranges").withColumnRenamed("row", "head")  # a head's, so as long as it at most
    own = met.where("doc_id = d0").join(inner, "head")
    return gone.union(own.select("doc_id", "row", F.transform("inside", lambda x: x + F.col("s")).alias("gone")))


def _windows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ws = window_slices(b.column(3)[i].as_py(), k)
                at = pa.array(np.zeros(len(ws), np.int64) + i)
                places = np.arange(len(ws), dtype=np.int32) + b.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), b.column(0).take(at), b.column(1).take(at), pa.array(places.astype(np.int32))], names=["window", "doc_id", "row", "s"])

    return run


def _remove():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, removed = [], [], []
            for t, gone in zip(_binary(b.column(1)), b.column(2), strict=True):
                ws = (t.as_py() or b"").split()
                n.append(len(ws))
                if gone.is_valid:
                    cut = np.array(gone.as_py(), np.int64).reshape(-1, 2)
                    steps = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(steps, cut[:, 0], 1)
                    np.add.at(steps, cut[:, 1], -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                removed.append(n[-1] - len(ws))
                texts.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(doc_id, text, n_words, n_removed): kept words joined by one space, for every row of `docs`.

    A word goes if a window of `k` words over it also starts in a document of a smaller id; windows are judged
    on the input. Ids must be whole numbers. Null and blank texts have no words and give an empty text; rows of a null id are returned and
    neither remove nor lose words; rows of one id don't remove each other's words; an empty table gives an
    empty one; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    runs = written(src.where("doc_id is not null and text is not null").mapInArrow(_describe(k, m), "mini long, doc_id long, row long, s int, c int"), "super-k-mers")
    again = _found_again(runs, hot, "minimisers")
    spans = runs.join(again, "mini").groupBy("doc_id", "row").agg(F.collect_set(F.struct("mini", "s", "c", "hot")).alias("spans"))  # a document's, so as long as its text at most
    packed = src.join(written(spans, "spans"), ["doc_id", "row"], "left").select("doc_id", "row", "text", "spans")
    packed = written(packed.mapInArrow(_pack(k), "mini long, doc_id long, row long, s int, c int, hot boolean, packed binary"), "packed")
    gone = _sorted_buckets(packed.where("not hot"), k)
    if packed.where("hot").limit(1).count():
        gone = gone.union(_hot(packed.where("hot"), k, hot, tuple(n for n in LONGER if m < n < k)))
    gone = gone.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    return src.join(gone, ["doc_id", "row"], "left").select("doc_id", "text", "gone").mapInArrow(_remove(), "doc_id long, text string, n_words long, n_removed long")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL = {
    "op4_substring_dedup": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
x as (select doc_id, p, array_to_string(w[p:p + {K - 1}], ' ') as s
      from (select doc_id, w, unnest(range(1, len(w) - {K - 2})) as p from d where len(w) >= {K})),
f as (select s, min(doc_id) as least from x group by s),
late as (select x.doc_id, x.p from x join f on x.s = f.s where x.doc_id > f.least),
wd as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as t from d),
g as (select wd.doc_id, wd.p, wd.t,
             sum(case when late.p is null then 0 else 1 end) over (partition by wd.doc_id order by wd.p rows between {K - 1} preceding and current row) as hits
      from wd left join late on wd.doc_id = late.doc_id and wd.p = late.p),
r as (select doc_id, count(*) as n_words, sum(case when hits > 0 then 1 else 0 end) as n_removed,
             coalesce(string_agg(case when hits = 0 then t end, ' ' order by p), '') as kept
      from g group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(r.n_removed, 0)::bigint as n_removed, sha256(coalesce(r.kept, '')) as kept_sha256
from d left join r on d.doc_id = r.doc_id"""
}
