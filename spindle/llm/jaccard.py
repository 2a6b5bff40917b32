"""Near-duplicate groups by wide SimHash fingerprints, covering LSH and the exact Jaccard similarity of shingle sets.

A bit of a set's fingerprint is 1 if set in over half of its windows' hashes, as in `simhash`. At similarity 0.8 two sets
differ in 15.2 % of the bits on average (the angle between them; at most 0.1475 / n more for a smaller set of n windows), so
64 bits and a radius of 3 would lose most pairs. The fingerprint is wider here: its first bits are cut into blocks of 3 * width,
each with a covering family of radius 1, its last FILTER words are compared in the buckets. Of B blocks a pair within 2 * B - 1 bits
has one with at most one difference (pigeonhole), so it surely meets; of pairs at 0.8 a share of some MISS doesn't (of sets of four
windows some 1e-6). Buckets are also cut by size, as sets of similarity 0.8 have sizes within a quarter: a set is in the class of its
size and in that of a quarter more.
Width, and with it the number of blocks, follows from the number of sets, for buckets of bounded size.

Pairs whose WIDE further words allow it are verified by their whole sets, so no pair below `least` is ever linked. Not all pairs of
a crowd are: first each set is with its candidates in a bucket, one that has more than NEIGHBOURS with one of the closest or the crowd's centre,
by turns of tables; then the latter, outside of their bucket's largest component, with the closest of other components; then what these
links leave in different components, each pair in the first table in which it meets and if FINE further words, made only now, allow it. Nothing
is dropped for it, as a pair within one component adds no group. The chance of a pair at 0.8 to fail a comparison of fingerprints is below
1e-6, and less above.

The last step is all pairs of what is left, in memory: it stays small because few texts of a crowd are near 0.8 to it and not
above, but nothing bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, picked, settled, written
from .components import connected_components
from .simhash import covering_masks

LEAST, SHINGLE, MISS, NEIGHBOURS, SMALL = 0.8, 5, 5e-8, 2, 0.1475
FILTER, WIDE, FINE, DEVIATIONS = 3, 16, 64, 5.3
_SALTS = np.random.default_rng(42).integers(0, 1 << 63, 1024, dtype=np.uint64)
_NEAR = "row long, n int, " + ", ".join(f"f{i} long" for i in range(FILTER))


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's windows of k words, ascending; a shorter text is one window, a wordless one none."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    joined, digest, n = b" ".join(ws), xxhash.xxh64_intdigest, len(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: max(1, n - k + 1)].tolist(), ends[min(n, k) - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[i:j]) for i, j in cuts], np.uint64))


def fingerprint(hashes: np.ndarray, words: int, first: int = 0) -> np.ndarray:
    """The SimHash of a set in `words` words of 64 bits, each over other hashes; zeros of the empty set."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] + _SALTS[None, first : first + words]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def differing(least: float, n):
    """At most this share of bits differs, on average, of two sets of similarity `least` and n windows or more."""
    return math.acos(2 * least / (1 + least)) / math.pi + SMALL / np.maximum(n, 1)


def limits(least: float, n: np.ndarray, bits: int) -> np.ndarray:
    """So many differing bits are allowed to a pair whose smaller set has n windows."""
    q = differing(least, n)
    return np.ceil(bits * q + DEVIATIONS * np.sqrt(bits * q * (1 - q))).astype(np.int64)


def width_for(sets: int) -> int:
    """A third of a block's bits: buckets keep two thirds, so each more cuts them to a quarter; 2**20 sets have 3."""
    return min(13, max(3, math.ceil(math.log(max(sets, 2), 4)) - 7))


@cache
def blocks_for(width: int, least: float = LEAST) -> int:
    """So many blocks that MISS of the pairs at `least` meet in none; a block's pair meets if two of its three parts are equal."""
    part = (1 - differing(least, 17)) ** width
    return math.ceil(math.log(MISS) / math.log(1 - 3 * part**2 + 2 * part**3))


@cache
def _masks(width: int, blocks: int) -> np.ndarray:
    return np.array([covering_masks(1, seed=b, bits=3 * width) for b in range(blocks)], np.int64)


def table_keys(fps: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """Of each fingerprint (a row of words) what each table keeps of its block, three tables a block."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")[:, : 3 * width * blocks]
    values = bits.reshape(len(fps), blocks, 3 * width).astype(np.int64) @ (1 << np.arange(3 * width, dtype=np.int64))
    return (values[:, :, None] & _masks(width, blocks)).reshape(len(fps), 3 * blocks)


def _classes(n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The size class of each set, and that of the largest set that may be similar."""
    return np.frexp(n.astype(float))[1], np.frexp(np.floor(n / least + 1e-9))[1]


def _sets(docs: DataFrame, k: int, made, schema: str) -> DataFrame:
    """Over (row, text): the columns that `made` gives of the shingle set, after the row."""
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    wanted = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary() if pa.types.is_string(b.column(1).type) else pa.large_binary())
            for at in range(0, b.num_rows, 1000):
                part = [made(shingle_set(t.as_py(), k)) for t in texts[at : at + 1000]]
                yield pa.RecordBatch.from_pylist([{"row": r, **x} for r, x in zip(b.column(0)[at : at + 1000].to_pylist(), part, strict=True)], schema=wanted)

    return docs.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, k: int, words: int) -> DataFrame:
    """(row, same, n, fp, wide): a set's digest of 128 bits, its size, its fingerprint and the next WIDE words of it."""

    def made(h: np.ndarray) -> dict:
        fp = fingerprint(h, words + WIDE)
        return {"same": xxhash.xxh3_128_hexdigest(h.tobytes()), "n": len(h), "fp": fp[:words].tobytes(), "wide": fp[words:].view(np.int64).tolist()}

    return _sets(docs, k, made, "row long, same string, n int, fp binary, wide array<long>")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row")).union(pairs.select("b"))


def alike(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose WIDE words may be of sets that are `least` similar."""
    pairs = narrow(pairs, "pairs")
    own = picked(prints.select("row", "n", "wide"), _ends(pairs), "ends-met")
    side = lambda row, n, wide: own.select(F.col("row").alias(row), F.col("n").alias(n), F.col("wide").alias(wide))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    q, bits = F.lit(differing(least, math.inf)) + SMALL / F.least("m", "n"), 64 * WIDE
    return both.where(differ <= F.ceil(bits * q + DEVIATIONS * F.sqrt(bits * q * (1 - q)))).select("a", "b")


def verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, least: float, k: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are `least` similar or more."""
    pairs = written(alike(pairs, prints, least), "alike")
    sets = written(_sets(picked(docs.select("row", "text"), _ends(pairs), "ends"), k, lambda h: {"hs": h.view(np.int64).tolist()}, "row long, hs array<long>"), "shingle-sets")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("hs").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def buckets(prints: DataFrame, width: int, least: float, *more: str) -> DataFrame:
    """(key, host, row, n, f0 .., more): each set in every table, in its own size class (host) and in that of a quarter more.

    `more` are columns of `prints` that go with every row: the rows are many times those of `prints`, which no estimate of a plan
    knows, so nothing is joined to them. Sets too small to be similar to another one, at 0.8 those of less than four windows, are left out.
    """
    blocks = blocks_for(width, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                row, n, fps = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2).to_pylist())
                own, next_ = _classes(n, least)
                who = np.concatenate([np.arange(len(n)), np.flatnonzero(next_ != own)])
                size = np.concatenate([own, next_[next_ != own]])
                keys = table_keys(fps, width, blocks)[who]
                tables = np.arange(keys.shape[1], dtype=np.int64)
                keys = ((tables[None, :] << 6 | size[:, None].astype(np.int64)) << (3 * width)) | keys
                out = [keys.ravel(), np.repeat(np.arange(len(who)) < len(n), len(tables))]
                out += [np.repeat(c[who], len(tables)) for c in (row, n, *fps[:, -FILTER:].view(np.int64).T)]
                out = [pa.array(c) for c in out] + [c.take(pa.array(np.repeat(who, len(tables)))) for c in b.columns[3:]]
                yield pa.RecordBatch.from_arrays(out, names=["key", "host", "row", "n", *[f"f{i}" for i in range(FILTER)], *more])

    return prints.where(F.col("n") >= least / (1 - least) - 1e-9).select("row", "n", "fp", *more).mapInArrow(run, ", ".join(["key long, host boolean, " + _NEAR, *[f"{c} {dict(prints.dtypes)[c]}" for c in more]]))


class _Bucket:
    """The rows of one key in order of size, and which of them may be similar by their sizes and fingerprints."""

    def __init__(self, part: pd.DataFrame, least: float, width: int):
        self.width = width
        self.rows, self.n, self.host, self.least = part["row"].to_numpy(), part["n"].to_numpy(), part["host"].to_numpy(), least
        self.f = part[[f"f{i}" for i in range(FILTER)]].to_numpy().view(np.uint64)
        self.limit = limits(least, self.n, 64 * FILTER)
        self.component = part["component"].to_numpy() if "component" in part else None

    def distances(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Differing bits of each of `at` to each of `of`; 255 where a pair can't be similar, is met in another size class or is of one component."""
        out = np.zeros((len(at), len(of)), np.uint8)
        for i in range(FILTER):
            out += np.bitwise_count(self.f[at, i, None] ^ self.f[None, of, i])
        n, m = self.n[at, None], self.n[None, of]
        may = (out <= np.maximum(self.limit[at, None], self.limit[None, of])) & (np.minimum(n, m) >= self.least * np.maximum(n, m) - 1e-9)
        may &= (self.host[at, None] | self.host[None, of]) & (at[:, None] != of[None, :])
        if self.component is not None:
            may &= self.component[at, None] != self.component[None, of]
        out[~may] = 255
        return out

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows, the rows of sizes near theirs, and their distances."""
        for start in range(0, len(self.n), 128):
            at = np.arange(start, min(start + 128, len(self.n)))
            of = np.arange(np.searchsorted(self.n, self.least * self.n[at[0]] - 1e-9), np.searchsorted(self.n, self.n[at[-1]] / self.least + 1e-9, side="right"))
            yield at, of, self.distances(at, of)

    def closest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's NEIGHBOURS closest candidates, itself where it has less, and its number of candidates."""
        near, count = np.repeat(np.arange(len(self.n))[:, None], NEIGHBOURS, axis=1), np.zeros(len(self.n), np.int64)
        for at, of, d in self.chunks():
            count[at] = (d < 255).sum(axis=1)
            for k in range(NEIGHBOURS if count[at].any() else 0):
                j = d.argmin(axis=1)
                hit = np.flatnonzero(d[np.arange(len(at)), j] < 255)
                near[at[hit], k] = of[j[hit]]
                d[hit, j[hit]] = 255
        return near, count


def _table(part: pd.DataFrame, bucket: _Bucket) -> int:
    return int(part["key"].iloc[0]) >> (3 * bucket.width + 6)


def _few(near: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of `rows` with their closest."""
    a, b = np.repeat(rows, NEIGHBOURS), near[rows].ravel()
    return a[a != b], b[a != b]


def _near(bucket: _Bucket, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row with its candidates; of those that have more than NEIGHBOURS one, by turns the centre and the closest, and a mark that others are left."""
    near, count = bucket.closest()
    a, b = _few(near, np.flatnonzero((count > 0) & (count <= NEIGHBOURS)))
    crowd = np.flatnonzero(count > NEIGHBOURS)
    if not len(crowd):
        return a, b, np.zeros(len(a), bool)
    turn = _table(part, bucket) % (NEIGHBOURS + 1)
    if turn < NEIGHBOURS:
        to = near[crowd, turn]
    else:
        bits = np.unpackbits(bucket.f[crowd].view(np.uint8), axis=1)
        centre = crowd[(bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(crowd))).sum(axis=1).argmin()]
        to = np.where(bucket.distances(np.array([centre]), crowd)[0] < 255, centre, crowd)
    return np.concatenate([a, crowd]), np.concatenate([b, to]), np.arange(len(a) + len(crowd)) >= len(a)


def _best(bucket: _Bucket, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row outside of the bucket's largest component with its candidates of other components; of those that have more than NEIGHBOURS one of
    the closest, by turns, and a mark; of the largest component's rows that have any the mark."""
    near, count = bucket.closest()
    _, which, sizes = np.unique(bucket.component, return_inverse=True, return_counts=True)
    largest = which == sizes.argmax()
    a, b = _few(near, np.flatnonzero(~largest & (count > 0) & (count <= NEIGHBOURS)))
    crowd = np.flatnonzero((count > NEIGHBOURS) | largest & (count > 0))
    to = np.where(largest[crowd], crowd, near[crowd, _table(part, bucket) % NEIGHBOURS])
    return np.concatenate([a, crowd]), np.concatenate([b, to]), np.arange(len(a) + len(crowd)) >= len(a)


def _apart(width: int, blocks: int):
    """All pairs of different components that meet in no earlier table, so that each comes once, and whose FINE words may be of similar sets."""

    def of(bucket: _Bucket, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, fine = table_keys(_matrix(part["fp"]), width, blocks), _matrix(part["fine"])
        own, limit = _table(part, bucket), limits(bucket.least, bucket.n, 64 * FINE)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, of, d in bucket.chunks():
            i, j = np.nonzero((d < 255) & (at[:, None] < of[None, :]))
            for some in range(0, len(i), 4096):
                x, y = at[i[some : some + 4096]], of[j[some : some + 4096]]
                ok = (keys[x] == keys[y]).argmax(axis=1) == own
                x, y = x[ok], y[ok]
                ok = np.bitwise_count(fine[x] ^ fine[y]).sum(axis=1, dtype=np.int64) <= limit[x]
                left.append(x[ok])
                right.append(y[ok])
        a = np.concatenate(left)
        return a, np.concatenate(right), np.zeros(len(a), bool)

    return of


def _pairs(least: float, width: int, proposed):
    """Over rows sorted by key and n: what is proposed in each bucket."""

    def of(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(part) > 1:
            bucket = _Bucket(part, least, width)
            i, j, left = proposed(bucket, part)
            if len(i):
                yield pd.DataFrame({"row": bucket.rows[i], "to": bucket.rows[j], "left": left})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for part in parts:
            part = part if carry is None else pd.concat([carry, part], ignore_index=True)
            keys = part["key"].to_numpy()
            at, found = 0, []
            for end in np.flatnonzero(keys[1:] != keys[:-1]) + 1:
                found.extend(of(part.iloc[at:end]))
                at = end
            carry = part.iloc[at:]
            if found:
                yield pd.concat(found, ignore_index=True)
        if carry is not None:
            yield from of(carry)

    return run


def _met(keyed: DataFrame, least: float, width: int, proposed, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (a > b) that `proposed` gives of the buckets, and the rows that it marks; both written."""
    said = keyed.repartition("key").sortWithinPartitions("key", "n", "row").mapInPandas(_pairs(least, width, proposed), "row long, to long, left boolean")
    mark = F.when(F.col("left"), F.col("row"))
    said = written(said.groupBy(F.greatest("row", "to").alias("a"), F.least("row", "to").alias("b")).agg(F.max(mark).alias("x"), F.min(mark).alias("y")), name)
    marked = said.select(F.col("x").alias("row")).union(said.select("y")).where("row is not null").distinct()
    return said.where("a <> b").select("a", "b"), written(marked, name + "-left")


def _placed(prints: DataFrame, marked: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(row, n, fp, component) of the marked rows."""
    rows = picked(prints.select("row", "n", "fp"), marked, "marked").join(found.withColumnRenamed("node", "row").hint("merge"), "row", "left")
    return written(rows.select("row", "n", "fp", F.coalesce("component", "row").alias("component")), name)


def near_groups(docs: DataFrame, least: float = LEAST, k: int = SHINGLE, width: int | None = None) -> DataFrame:
    """(row, group) for every row of `docs` (row long, unique; text): group is the smallest row that links reach.

    Links join texts whose sets of k-word windows, A-Z lower-cased, are `least` similar or more, and are followed
    transitively. Null and wordless texts have equal (empty) sets. Windows are equal if their 64-bit hashes are.
    """
    width = width or width_for(docs.count())
    blocks = blocks_for(width, least)
    words = -(-3 * width * blocks // 64) + FILTER
    prints = written(fingerprints(docs.select("row", F.col("text").cast("string").alias("text")), k, words), "fingerprints")
    reps = written(prints.groupBy("same").agg(F.min("row").alias("rep")), "set-reps")
    kinds = written(prints.join(reps.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi").select("row", "n", "fp", "wide"), "kinds")
    tried, marked = _met(buckets(kinds, width, least), least, width, _near, "near-pairs")
    links = written(verified(tried, kinds, docs, least, k), "near-links")
    crowd = _placed(kinds, marked, settled(lambda: connected_components(links), "near-components"), "crowd")
    best, marked = _met(buckets(crowd, width, least, "component"), least, width, _best, "best-pairs")
    best = written(best.join(tried.hint("merge"), ["a", "b"], "left_anti"), "best-untried")
    links = written(links.union(verified(best, kinds, docs, least, k)), "best-links")
    crowd = _placed(kinds, marked, settled(lambda: connected_components(links), "best-components"), "crowd-left")
    fine = _sets(picked(docs.select("row", "text"), crowd.select("row"), "rows-left"), k, lambda h: {"fine": fingerprint(h, FINE, words + WIDE).tobytes()}, "row long, fine binary")
    marks = written(crowd.join(fine.hint("merge"), "row"), "fine-fingerprints")
    cross, _ = _met(buckets(marks, width, least, "fp", "component", "fine"), least, width, _apart(width, blocks), "cross-pairs")
    cross = written(cross.join(tried.union(best).hint("merge"), ["a", "b"], "left_anti"), "cross-untried")
    groups = connected_components(links.union(verified(cross, kinds, docs, least, k)))
    labels = reps.join(groups.hint("merge"), reps.rep == groups.node, "left").select("same", F.coalesce("component", "rep").alias("group"))
    return prints.join(labels.hint("merge"), "same").select("row", "group")
