"""SimHash near-dedup by covering locality-sensitive hashing.

A radius-r covering family over 64 bits gives every bit position a non-zero vector of r+1 bits;
table v (of the 2^(r+1) - 1 non-zero v) keeps the positions whose vector is not orthogonal
to v. At most r differing positions span at most r dimensions, so some v is orthogonal
to all of them: that table masks every difference and the pair meets in one bucket. No
pair within the radius is missed. (R. Pagh, "CoveringLSH", 2016.)

Only distinct fingerprints are hashed. A bucket of more than `split_over` of them is
dealt out again under a second covering family over the bits that its own mask hides;
what remains together then agrees on about three quarters of all bits, so its size is
bounded by the values of the rest, whatever the corpus. Buckets return the edges of a
spanning star for each linked group, never all pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import connected_components

RADIUS, SHINGLE, SPLIT_OVER, SEED = 3, 3, 1024, 42
PAIRWISE_UP_TO = 4096


def fingerprint(text: bytes | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text; 0 where it has no word."""
    ws = (text or b"").lower().split()
    n = len(ws)
    if not n:
        return 0
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if n <= k:
        return digest(joined, seed)
    lens = np.fromiter(map(len, ws), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    cuts = zip((ends - lens)[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[i:j], seed) for i, j in cuts], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id, fp): the signed long whose bits are the fingerprint. Null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary() if pa.types.is_string(b.column(1).type) else pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 1, bits: int = 64) -> list[int]:
    """The kept bits of each table of a covering family, as unsigned masks; every vector is dealt equally often."""
    size = 1 << (radius + 1)
    dealt = [1 + i % (size - 1) for i in range(bits)]
    random.Random(seed).shuffle(dealt)
    return [sum(1 << i for i, a in enumerate(dealt) if (a & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct unsigned fingerprints: the index of a representative of each one's linked group."""
    n = len(fps)
    left, right = [], []
    if n <= PAIRWISE_UP_TO:
        for at in range(0, n, 256):
            i, j = np.nonzero(np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= radius)
            left.append(i + at)
            right.append(j)
    else:  # all neighbours by flipping up to `radius` of the bits that vary here: linear in the group
        order = np.argsort(fps)
        ranked = fps[order]
        varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
        places = [1 << i for i in range(64) if varying >> i & 1]
        for r in range(1, radius + 1):
            for flip in combinations(places, r):
                want = fps ^ np.uint64(reduce(int.__or__, flip))
                at = np.minimum(np.searchsorted(ranked, want), n - 1)
                hit = np.flatnonzero(ranked[at] == want)
                left.append(hit)
                right.append(order[at[hit]])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _bucket_edges(radius: int):
    def star(part: pd.DataFrame) -> pd.DataFrame:
        rep, fps = part["rep"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
        root = linked(fps, radius)
        far = root != np.arange(len(root))
        return pd.DataFrame({"a": rep[far], "b": rep[root[far]]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for part in parts:
            if carry is not None:
                part = pd.concat([carry, part], ignore_index=True)
            keys = part[["t", "key"]].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges, at = [], 0
            for end in cut:
                if end - at > 1:
                    edges.append(star(part.iloc[at:end]))
                at = end
            carry = part.iloc[at:]
            if edges:
                yield pd.concat(edges, ignore_index=True)
        if carry is not None and len(carry) > 1:
            yield star(carry)

    return run


def near_links(reps: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (columns rep, fp) linked within `radius` bits.

    The edges span each linked group of a bucket; their transitive closure is that of all links.
    """
    first = covering_masks(radius, seed=1)
    second = covering_masks(radius, seed=2)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(first)])
    keyed = reps.select("rep", "fp", F.explode(tables).alias("x")).select("rep", "fp", "x.t", "x.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(sizes, ["t", "key"]), "buckets")
    small = met.where(F.col("n") <= split_over).select("t", "key", "rep", "fp")
    # The second family goes over the bits that the first mask hides; together with the table it names the new bucket.
    again = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(_signed(m)).alias("m")) for u, m in enumerate(second)])
    mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in first]), F.col("t") + 1)
    big = met.where(F.col("n") > split_over).select("t", "key", "rep", "fp", F.explode(again).alias("x"))
    big = big.select(
        (F.lit(len(first)) + F.col("t") * len(second) + F.col("x.u")).cast("int").alias("t"),
        F.col("fp").bitwiseAND(mask.bitwiseOR(F.col("x.m"))).alias("key"), "rep", "fp",
    )
    dealt = small.union(big).repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInPandas(_bucket_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): every document with its fingerprint and the smallest id that links reach.

    Links join fingerprints at `radius` or fewer differing bits and are followed transitively.
    Ids must be whole numbers. Null texts and texts without words have fingerprint 0, which links as any other; of repeated
    rows of one id each is kept; rows with a null id keep a null component unless a link gives one. Columns other
    than the two named ones are not read, so clashing names do no harm; an empty table gives
    an empty one.
    """
    fps = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "representatives")
    found = connected_components(near_links(reps, radius))
    labels = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
SQL: dict[str, str] = {}
