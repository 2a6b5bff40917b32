"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source is a line of words, cut into shards by a seeded hash of the document id and
each shard into blocks of equal length. Blocks are apportioned to sources, and a
source's blocks to its shards, by highest quotients w / (2k + 1), giving an integer
quota for every shard. A shard's quota takes every block q // n times and the first
q % n blocks of a seeded permutation once more, so no block, and so no document, is
taken more often than the cap allows.

The driver holds one row for each source and shard: the number of sources, which must be within MAX_SOURCES, and
`n_shards` bound them, not the documents; shards grow in number only beyond SHARD_MOST words each, which keeps products of
words and blocks below 2^60. A shard's documents are lined up by a window
over (doc_id, size) rows without texts; the hottest source has the most shards.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, words, written

WEIGHTS, TOTAL, CAP = (3, 1, 2), Fraction(3, 2), 2
N_SHARDS, SHARD_WORDS, BLOCK_WORDS, SEED = 2048, 4096, 16, 7
MAX_SOURCES, SHARD_MOST = 1_000_000, 1 << 28
#: Rows of the plan that may be broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def targets(sizes: list[int], weights=WEIGHTS, total: Fraction = TOTAL, cap: int = CAP) -> list[Fraction]:
    """Shares of `total` of all sizes by repeating weights; what exceeds `cap` sizes is reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, active = total * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while active:
        per = Fraction(left) / sum(w[i] for i in active)
        over = [i for i in active if per * w[i] > cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = per * w[i]
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
            active.discard(i)
    return out


def sainte_lague(weights: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients w / (2k + 1), at most most[i] each; ties go to the earlier entry.

    Starts from a floor that every highest-quotient outcome exceeds, so only the last seats go one by one.
    """
    seats = min(seats, sum(m for w, m in zip(weights, most, strict=True) if w))
    total = sum(weights)
    got = [0] * len(weights)
    if not seats or not total:
        return got
    for i, w in enumerate(weights):
        got[i] = max(0, min(most[i], math.floor(w * seats / total) - 1))
    while sum(got) > seats:  # capped entries can leave the floor too high only by rounding
        got[max(range(len(got)), key=lambda i: (Fraction(2 * got[i] - 1) / weights[i] if got[i] else -1, i))] -= 1
    heap = [(-w / (2 * got[i] + 1), i) for i, w in enumerate(weights) if w and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _stride(n: int, seed: int) -> int:
    """A step that is coprime to n, so that i -> step * i + b permutes the n blocks."""
    step = (seed * 2654435761 + 1) % n if n > 1 else 1
    while math.gcd(step, n) != 1:
        step = step % n + 1
    return step


def _key(source) -> str:
    return "n" if source is None else "s" + source


def plan(shards: list[tuple], n_blocks: int = BLOCK_WORDS, weights=WEIGHTS, total: Fraction = TOTAL, cap: int = CAP, seed: int = SEED) -> list[tuple]:
    """From (source, shard, words): a row for each, with its source's target and its own quota of blocks."""
    by = defaultdict(list)
    for source, shard, n in sorted(shards, key=lambda x: (x[0] is None, x[0] or "", x[1])):
        by[source].append((shard, n))
    sizes = [sum(n for _, n in x) for x in by.values()]
    goals = targets(sizes, weights, total, cap)
    cut = [[max(1, round(n / n_blocks)) if n else 0 for _, n in x] for x in by.values()]
    wanted = [g * sum(c) / s if s else Fraction(0) for g, c, s in zip(goals, cut, sizes, strict=True)]
    seats = sainte_lague(wanted, round(sum(wanted)), [cap * sum(c) for c in cut])
    out = []
    for (source, own), goal, size, c, q in zip(by.items(), goals, sizes, cut, seats, strict=True):
        quotas = sainte_lague([Fraction(n) for _, n in own], q, [cap * n for n in c])
        for (shard, n), blocks, quota in zip(own, c, quotas, strict=True):
            times, extra = divmod(quota, blocks) if blocks else (0, 0)
            step = _stride(max(1, blocks), seed + shard + 1)
            out.append((_key(source), shard, n, max(1, blocks), times, extra, step, (seed * 31 + shard * 17) % max(1, blocks), size, float(goal)))
    return out


PLAN = "key string, shard int, shard_size long, n long, times long, extra long, step long, shift long, source_size long, target double"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: Fraction = TOTAL, cap: int = CAP, n_shards: int = N_SHARDS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`.

    taken counts words of the mix with repeats, at most `cap` sizes. Null or blank texts have size 0 and are
    taken 0 times; a null source is a source of its own, last; repeated rows are taken row by row; a null id
    hashes as any other; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()  # a row for each source
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix by a coarser column")
    everything = sum(r["n"] for r in sources)
    n_shards = max(n_shards, -(-everything // SHARD_MOST))
    count = {r["source"]: max(1, min(round(n_shards * r["n"] / everything) if everything else 1, r["n"] // SHARD_WORDS)) for r in sources}

    def placed(found: DataFrame, small: bool) -> DataFrame:
        return F.broadcast(found) if small else found

    counts = spark.createDataFrame([(_key(s), c) for s, c in count.items()], "key string, shards long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    lined = sized.withColumn("key", key).join(placed(counts, len(count) <= BROADCAST_ROWS), "key")
    lined = lined.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("shard", F.expr("cast(pmod(h, shards) as int)"))
    shards = [(r["source"], r["shard"], r["n"]) for r in lined.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()]
    rows = plan(shards, block, weights, total, cap, seed)
    line = W.partitionBy("key", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    lined = lined.withColumn("upto", F.sum("size").over(line)).drop("shards", "h")
    met = lined.join(placed(spark.createDataFrame(rows, PLAN), len(rows) <= BROADCAST_ROWS), ["key", "shard"])
    # Block i is the words from i * shard_size div n up to the next; a document meets the blocks from `first` to `last`.
    picked = F.expr("""
        case when size = 0 or extra = 0 then 0L else aggregate(
          sequence(greatest(0L, (upto - size) * n div shard_size - 1), least(n - 1, (upto - 1) * n div shard_size + 1)), 0L,
          (acc, i) -> acc + case when (step * i + shift) % n < extra
            then greatest(0L, least(upto, (i + 1) * shard_size div n) - greatest(upto - size, i * shard_size div n)) else 0L end) end""")
    return met.select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size") + picked).alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mix_sources": op7_mix_sources}
SQL: dict[str, str] = {}
