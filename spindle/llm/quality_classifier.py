"""Quality classifier: a factorisation machine over hashed words, structure figures and metadata.

Every distinct word of a text is a feature by its hash, weighing 1 / sqrt(distinct words);
structure figures (symbols, capitals, repeated lines and so on) and the declared number of characters
are features by the step they fall on. The score is w0 + sum w_i x_i plus all pairwise terms
<v_i, v_j> x_i x_j, summed in linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2.

Trained in numpy by Adagrad on at most TRAIN_ROWS labelled documents (the smallest hashes of their ids),
which come to the driver as feature numbers, not texts; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

TRAIN_ROWS, HASH_BITS, FACTORS, EPOCHS, RATE, DECAY, SEED = 6000, 14, 8, 12, 0.1, 1e-5, 11
CUT = 0.3
_STEPS = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5])
N_FIGURES, PER_FIGURE = 10, 16
SIZE = (1 << HASH_BITS) + N_FIGURES * PER_FIGURE


def features(text: bytes | None, n_chars: int | None) -> np.ndarray:
    """Feature numbers: N_FIGURES of structure and metadata first, then one for each distinct word."""
    raw = text or b""
    ws = raw.lower().split()
    unique = set(ws)
    body = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars, n = max(1, len(raw)), max(1, len(ws))
    pipes, caps, bangs, digits = int(body[124]), int(body[65:91].sum()), int(body[33]), int(body[48:58].sum())
    symbols = int(body[list(b"#*$%&<>")].sum())
    ratios = (symbols / chars, pipes / chars, caps / chars, bangs / chars, digits / chars, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(unique) / n)
    steps = np.searchsorted(_STEPS, ratios)
    logs = (min(15, len(ws).bit_length()), min(15, (chars // n)), min(15, max(0, n_chars or 0).bit_length()))
    figures = (1 << HASH_BITS) + np.arange(N_FIGURES) * PER_FIGURE + np.concatenate([steps, logs])
    hashed = np.fromiter(map(crc32, unique), np.int64, len(unique)) & ((1 << HASH_BITS) - 1)
    return np.concatenate([figures, np.sort(hashed)]).astype(np.int32)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, starts and owners of several documents."""
    lens = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    owner = np.repeat(np.arange(len(rows)), lens)
    values = np.repeat(1 / np.sqrt(np.maximum(1, lens - N_FIGURES)), lens).astype(np.float32)
    values[(starts[:, None] + np.arange(N_FIGURES)).ravel()] = 0.5
    return np.concatenate(rows), values, starts, owner


class FactorisationMachine:
    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = SEED) -> None:
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, factors)).astype(np.float32)

    def raw(self, rows: list[np.ndarray]) -> tuple:
        idx, x, starts, owner = _flat(rows)
        vx = self.v[idx] * x[:, None]
        s = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.w0 + np.add.reduceat(self.w[idx] * x, starts) + pairs, idx, x, owner, vx, s

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 64, seed: int = SEED) -> FactorisationMachine:
        """Weighted log loss, each class with half of the weight; one class or none leaves a constant score."""
        y = np.asarray(y, np.float32)
        n, good = len(y), float(y.sum())
        if not n or good in (0.0, float(n)):
            self.w0 = 0.0 if not n else (3.0 if good else -3.0)
            self.v[:] = 0
            return self
        weight = np.where(y == 1, 0.5 * n / good, 0.5 * n / (n - good)).astype(np.float32)
        rng, gw, gv, g0 = np.random.default_rng(seed), np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                own = order[at : at + batch]
                z, idx, x, owner, vx, s = self.raw([rows[i] for i in own])
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)
                e = err[owner] * x
                used, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, e, len(used)) + DECAY * self.w[used]
                full = e[:, None] * (s[owner] - vx)
                dv = np.stack([np.bincount(back, full[:, f], len(used)) for f in range(full.shape[1])], 1) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                g0 += float(err.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.w0 -= rate * float(err.sum()) / g0**0.5
        return self


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        c = b.column(1)
        texts = c.cast(pa.binary() if pa.types.is_string(c.type) else pa.large_binary())
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield part, [features(t.as_py(), n.as_py()) for t, n in zip(texts.slice(at, 512), part.column(2), strict=True)]


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """`docs`: doc_id, text, n_chars; `labels`: doc_id, quality. Of several labels for an id the smallest counts."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(train_rows)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame(marks.select(F.col("doc_id").cast(id_type), "y").collect(), f"id {id_type}, y long")  # at most train_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _featured(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32())), part.column(3)], names=["doc_id", "features", "y"])

    met = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text", "n_chars", "y")
    made = met.mapInArrow(run, f"doc_id {id_type}, features array<int>, y long")
    got = made.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), F.xxhash64("features")).limit(train_rows).toArrow()  # ids may repeat
    rows = [np.asarray(x.values, np.int32) for x in got.column("features")]
    order = sorted(range(len(rows)), key=lambda i: (got.column("doc_id")[i].as_py(), len(rows[i]), rows[i].tobytes()))
    y = got.column("y").to_numpy()
    return FactorisationMachine().fit([rows[i] for i in order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    Labels are learnt only outside the held-out fold. Null and empty texts are scored by their structure alone; a
    null number of characters counts as 0; repeated rows are scored each; ids keep their type; without labels every score is 0.5; an empty
    table gives an empty one; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(chars_col).cast("long").alias("n_chars"))
    model = train(src, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _featured(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(rows))], names=["doc_id", "score"])

    scored = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
