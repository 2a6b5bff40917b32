"""Quality rules whose cutoffs are risk-controlled.

Every rule rejects a text whose figure is above a cutoff. A cutoff is used only if
labelled good texts show, by an exact binomial bound, that it rejects at most
`risk / number of rules` of the stratum's good texts, so all rules together reject at most
`risk`, in all strata at once with probability 1 - `delta`. Testing is corrected
twice: Bonferroni over strata and rules, and within a rule the grid of cutoffs, fixed
beforehand, is walked from the mildest on and ends at the first that fails, which needs no
further correction. Among certified cutoffs the one that rejects most bad texts is taken, if
it rejects bad texts `lift` times as often as good ones; else the rule is off there.

Texts are read once, into a narrow table of figures; labels join that table. The driver
gets counts by stratum, rule and grid step, never rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

RISK, DELTA, LIFT = 0.05, 0.05, 10.0
GRID = (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)
BROADCAST_ROWS = 100_000
#: The driver gets at most strata * rules * grid * 2 counts, so their number is bounded; more is an error, never a sample.
MAX_STRATA = 10_000
SYMBOLS, SPACES = b"#*$%&|<>", b"\t\n\x0b\x0c\r "
WINDOW = 5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


def repeated_words(ws: list[bytes], k: int = WINDOW) -> int:
    """Words inside a k-word window that occurs twice or more in the text, the first included."""
    n = len(ws) - k + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, ws), np.int64, len(ws)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    seen: dict[tuple, list[int]] = defaultdict(list)  # the hash only proposes; words decide
    for i in np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist():
        seen[tuple(ws[i : i + k])].append(i)
    steps = np.zeros(len(ws) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            np.add.at(steps, at, 1)
            np.add.at(steps, np.array(at) + k, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def figures(text: bytes | None) -> tuple[int, ...]:
    """FIGURES of one UTF-8 text; all 0 for null."""
    raw = text or b""
    ws = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    points = sum(map(len, ws)) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
    body = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        len(ws), points, int(body[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(ws),
        len(lines), int(body[65:91].sum()), int(body[33]),
    )


def text_figures(docs: DataFrame, id_col: str, text_col: str, stratum: Column, carry: bool = False) -> DataFrame:
    """(doc_id, stratum, FIGURES), and if `carry` also text and `carried`, a struct of the other columns of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(2)
            rows = [figures(t.as_py()) for t in c.cast(pa.binary() if pa.types.is_string(c.type) else pa.large_binary())]
            cols = np.array(rows, np.int64).reshape(-1, len(FIGURES))
            more = b.columns[2:] if carry else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(cols[:, i]) for i in range(len(FIGURES))], *more], names=["doc_id", "stratum", *FIGURES, *["text", "carried"][: len(more)]])

    src = docs.select(F.col(id_col).alias("doc_id"), stratum.cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"), *[F.struct(*[c for c in docs.columns if c != text_col]).alias("carried")] * carry)
    kept = src.schema.fields if carry else src.schema.fields[:2]
    return src.mapInArrow(run, T.StructType([*kept[:2], *[T.StructField(f, T.LongType()) for f in FIGURES], *kept[2:]]))


def _ratios() -> dict[str, Column]:
    per_char, per_line, per_word = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_lines", "n_words"))
    return {
        "symbols": F.col("n_symbols") / per_char,
        "dup_lines": F.col("n_dup_lines") / per_line,
        "repeats": F.col("n_repeat_words") / per_word,
        "capitals": F.col("n_upper") / per_char,
        "bangs": F.col("n_bangs") / per_char,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_p(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(good: list[int], bad: list[int], n_tests: int, risk: float = RISK, rules: int = 5, delta: float = DELTA, lift: float = LIFT, grid=GRID) -> float | None:
    """The cutoff of one rule in one stratum, or None. good[i], bad[i]: texts above exactly the cutoffs from grid[i] on; the last, above none."""
    n, m, best = sum(good), sum(bad), None
    out = wrong = 0
    for i, cutoff in enumerate(grid):
        wrong, out = wrong + good[i], out + bad[i]
        # More than the mean can't pass; that also bounds the terms to sum.
        if wrong > n * risk / rules or binomial_p(wrong, n, risk / rules) > delta / n_tests:
            break
        if out and out / m >= lift * wrong / n and (best is None or out > best[0]):
            best = (out, cutoff)
    return best and best[1]


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, lift: float = LIFT) -> list[tuple]:
    """(stratum, cutoff of each rule or None), for strata with any. Counts cover every labelled document."""
    rules = list(_ratios())
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = scored.where(~base_failed()).join(marks, "doc_id")
    step = lambda r: F.aggregate(F.array(*[F.lit(c) for c in GRID]), F.lit(0), lambda a, c: a + (r <= c).cast("int"))  # noqa: E731  grid steps not exceeded
    made = F.array(*[F.struct(F.lit(i).alias("rule"), step(r).alias("step")) for i, r in enumerate(_ratios().values())])
    if marks.limit(1).count() and joined.select("stratum").distinct().limit(MAX_STRATA + 1).count() > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata are labelled; certify by a coarser column")
    counts = joined.select("stratum", (F.col("quality") == 1).alias("good"), F.explode(made).alias("x")).groupBy("stratum", "x.rule", "good", "x.step").count()
    held: dict = defaultdict(lambda: [[0] * (len(GRID) + 1) for _ in range(2)])
    for r in counts.collect():
        held[r["stratum"], r["rule"]][not r["good"]][r["step"]] += r["count"]
    strata = sorted({s for s, _ in held}, key=lambda s: (s is None, s or ""))
    found = []
    for s in strata:
        own = [certified(*held[s, i], n_tests=len(strata) * len(rules), risk=risk, rules=len(rules), delta=delta, lift=lift) if (s, i) in held else None for i in range(len(rules))]
        if any(c is not None for c in own):
            found.append((s, *own))
    return found


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA, lift: float = LIFT, carry: bool = False) -> DataFrame:
    """(doc_id, FIGURES, base_failed, kept, failed_rules) for every row of `docs`, and if `carry` also its text and `carried`, a struct of its other columns.

    Null and empty texts have figures 0 and fail the base; a null stratum is a stratum of its own; repeated rows
    are judged each; rows with null ids are judged but can't be labelled; ids keep their type; of labels with several rows for an id
    the smallest quality counts; without labels no rule is certified and the base decides alone.
    An empty table gives an empty one; other columns are not read unless carried.
    """
    spark = docs.sparkSession
    scored = written(text_figures(docs, id_col, text_col, F.col(stratum_col), carry), "figures")
    rows = cutoffs(scored, labels, risk, delta, lift)
    limits = spark.createDataFrame(rows, "s string, " + ", ".join(f"c_{r} double" for r in _ratios()))
    limits = F.broadcast(limits) if len(rows) <= BROADCAST_ROWS else limits
    met = scored.join(limits, F.col("stratum").eqNullSafe(F.col("s")), "left")
    failed = F.array_compact(F.array(*[F.when(v > F.col(f"c_{r}"), F.lit(r)) for r, v in _ratios().items()]))
    more = ["text", "carried"] if carry else []
    return met.select("doc_id", *FIGURES, base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"), *more)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL: dict[str, str] = {}
