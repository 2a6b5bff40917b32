"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the UTF-8 bytes of a text, one in each direction; at every
position their states together give a distribution over the languages, and a document's
probabilities are the means over its positions. Texts are read whole, in windows of
WINDOW bytes whose states start at zero; the windows of a batch of documents run side by
side, so that memory is set by the batch and one step serves thousands of positions.

Trained in numpy by backpropagation through time on about TRAIN_WINDOWS windows a language, picked by a hash
of the id in proportion to the language's rows; only those short windows come to the driver.
Arrays hold units in rows and windows in columns, which keeps every pass contiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

WINDOW, HIDDEN, SIDE_BY_SIDE, PAD = 128, 8, 1024, 256
TRAIN_WINDOWS, TRAIN_BYTES, EPOCHS, BATCH, RATE, SEED = 1200, 64, 6, 128, 0.02, 5
MAX_WINDOWS_OF_A_DOC = 8


#: Values of lang that may be learnt; each is an output unit.
MAX_LANGUAGES = 1000


class BiGru:
    """x: byte tables (2, 3H, 257) holding the gates' inputs; u: recurrences (2, 3H, H); o, c: the output layer.

    Gates in order z (keep), r (reset), n (new state): h' = n + z (h - n), n = tanh(x_n + r (u_n h)).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng, h = np.random.default_rng(seed), hidden
        self.labels, self.h = labels, h
        self.x = rng.normal(0, 0.3, (2, 3 * h, 257)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (2, 3 * h, h)).astype(np.float32)
        self.o = rng.normal(0, 0.3, (len(labels), 2 * h)).astype(np.float32)
        self.c = np.zeros((len(labels), 1), np.float32)
        self._pad()

    def _pad(self) -> None:
        """A padding byte closes the keep gate: the state stays as it is."""
        self.x[:, :, PAD] = 0
        self.x[:, : self.h, PAD] = 30

    def states(self, data: np.ndarray, d: int, keep: bool = False) -> tuple:
        """States (T, H, B) of direction d over bytes (T, B), at their own positions; with `keep`, also what training needs."""
        steps, width = data.shape
        h, x, u = self.h, self.x[d].copy(), self.u[d].copy()
        x[: 2 * h] *= 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        u[: 2 * h] *= 0.5
        out = np.empty((steps, h, width), np.float32)
        state, a, b = np.zeros((h, width), np.float32), np.empty((3 * h, width), np.float32), np.empty((3 * h, width), np.float32)
        tape = []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(x, data[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=b)
            gates = a[: 2 * h]
            gates += b[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r, n, hn = a[:h], a[h : 2 * h], a[2 * h :], b[2 * h :]
            if keep:
                hn = hn.copy()
                n += r * hn
            else:
                hn *= r
                n += hn
            np.tanh(n, out=n)
            if keep:
                tape.append((t, state, z.copy(), r.copy(), n.copy(), hn))
            new = out[t]
            np.subtract(state, n, out=new)
            new *= z
            new += n
            state = new
        return out, tape

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Distribution (L, T, B) at every position of bytes (T, B)."""
        both = np.concatenate([self.states(data, 0)[0], self.states(data, 1)[0]], axis=1)
        logits = np.matmul(self.o, both)  # (T, L, B)
        logits += self.c
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(1, 0, 2)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution (documents, L) over all positions of each text; uniform for an empty one."""
        sums = np.zeros((len(texts), len(self.labels)))
        lens = np.array([len(t) for t in texts])
        counts = -(-lens // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        begins = np.concatenate([[0], np.cumsum(lens)[:-1]])
        first = np.repeat(np.cumsum(counts) - counts, counts)
        start = begins[owner] + (np.arange(len(owner)) - first) * WINDOW
        size = np.minimum(WINDOW, begins[owner] + lens[owner] - start)
        raw = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        order = np.argsort(-size, kind="stable")  # windows of like sizes side by side, cut to the longest
        for at in range(0, len(order), SIDE_BY_SIDE):
            own = order[at : at + SIDE_BY_SIDE]
            reach = np.arange(size[own[0]])[:, None]
            inside = reach < size[own]
            data = np.where(inside, raw[start[own] + reach].astype(np.intp), PAD)  # bytes alone have no room for the padding
            p = (self.probabilities(data) * inside).sum(axis=1)
            for k in range(len(self.labels)):
                sums[:, k] += np.bincount(owner[own], p[k], len(texts))
        return np.where(lens[:, None] > 0, sums / np.maximum(1, lens)[:, None], 1 / len(self.labels))

    def gradients(self, data: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of bytes (T, B) with labels y (B,), and its gradients, back through time."""
        steps, width = data.shape
        h = self.h
        runs = [self.states(data, d, keep=True) for d in (0, 1)]
        both = np.concatenate([r[0] for r in runs], axis=1)
        logits = np.matmul(self.o, both) + self.c
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        real = (data != PAD).astype(np.float32)
        total = max(1.0, float(real.sum()))
        at_y = p[:, y, np.arange(width)]
        loss = float(-(np.log(at_y + 1e-9) * real).sum() / total)
        err = p
        err[:, y, np.arange(width)] -= 1
        err *= (real / total)[:, None, :]
        grads = {"o": np.einsum("tlb,thb->lh", err, both), "c": err.sum(axis=(0, 2))[:, None], "x": np.zeros_like(self.x), "u": np.zeros_like(self.u)}
        from_out = np.matmul(self.o.T, err)  # (T, 2H, B)
        for d in (0, 1):
            un, back = self.u[d, 2 * h :], np.zeros((h, width), np.float32)
            for t, before, z, r, n, hn in reversed(runs[d][1]):
                dh = back + from_out[t, d * h : (d + 1) * h]
                da_n = dh * (1 - z) * (1 - n * n)
                da_r = da_n * hn * r * (1 - r)
                da_z = dh * (before - n) * z * (1 - z)
                dhn = da_n * r
                da = np.concatenate([da_z, da_r, da_n])
                back = dh * z + self.u[d, : 2 * h].T @ da[: 2 * h] + un.T @ dhn
                grads["u"][d, : 2 * h] += da[: 2 * h] @ before.T
                grads["u"][d, 2 * h :] += dhn @ before.T
                for k in range(3 * h):
                    grads["x"][d, k] += np.bincount(data[t], da[k], 257)
        return loss, grads

    def fit(self, windows: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> BiGru:
        """Adam on the mean position loss, gradients clipped by norm."""
        rng, names = np.random.default_rng(seed), ("x", "u", "o", "c")
        m, v, step = {k: np.zeros_like(getattr(self, k)) for k in names}, {k: np.zeros_like(getattr(self, k)) for k in names}, 0
        longest = max(map(len, windows), default=0)
        data = np.full((longest, len(windows)), PAD, np.intp)
        for i, w in enumerate(windows):
            data[: len(w), i] = np.frombuffer(w, np.uint8)
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                _, grads = self.gradients(data[:, own], y[own])
                norm = sum(float((g**2).sum()) for g in grads.values()) ** 0.5
                step += 1
                for k in names:
                    g = grads[k] * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    now = rate * 0.5**epoch if epoch > epochs // 2 else rate
                    setattr(self, k, (getattr(self, k) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
                self._pad()
        return self


def train(docs: DataFrame, per_language: int = TRAIN_WINDOWS, n_bytes: int = TRAIN_BYTES, fold_of: int = 5) -> BiGru | None:
    """A network learnt from text and lang outside the held-out fold; None if there is nothing to learn from."""
    src = docs.where("lang is not null and text is not null and length(text) > 0").where(fold(F.col("doc_id"), fold_of) != 0).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}  # a row for each language
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    if not counts:
        return None
    # A language with few rows gives several windows of each; one with many, a hashed share of its rows.
    rows = [(k, min(MAX_WINDOWS_OF_A_DOC, -(-per_language // n)), min(1.0, per_language / n)) for k, n in counts.items()]
    plan = docs.sparkSession.createDataFrame(rows, "lang string, each int, share double")
    picked = src.join(F.broadcast(plan), "lang").where(F.expr(f"pmod(xxhash64({SEED}L, doc_id), 1000000) < share * 1000000"))
    cuts = picked.withColumn("i", F.explode(F.sequence(F.lit(1), "each"))).withColumn("at", F.expr(f"1 + pmod(xxhash64(i, doc_id), greatest(1, length(text) - {n_bytes}))"))
    # Every other window is short, as whole texts can be, and stands at the beginning.
    size = F.expr(f"if(i % 2 = pmod(xxhash64(doc_id), 2), {n_bytes}, 4 + pmod(xxhash64(doc_id, i), {n_bytes} - 4))").cast("int")
    cuts = cuts.withColumn("size", size).withColumn("at", F.expr(f"if(size = {n_bytes}, at, 1)"))
    got = cuts.select("lang", F.expr("substring(text, cast(at as int), size)").alias("w"), F.xxhash64("i", "doc_id").alias("h")).orderBy("h", "lang", "w").limit(per_language * 2 * len(counts)).collect()
    labels = sorted(counts)
    windows = [r["w"].encode()[:n_bytes] for r in got]
    return BiGru(labels).fit(windows, np.array([labels.index(r["lang"]) for r in got]))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_WINDOWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`.

    lang_pred is `und`, with score 0, for null texts and texts without a letter, and for all if no language could
    be learnt. A null lang is not learnt from; a null id is in a fold as the empty text; repeated rows are judged each; ids keep their type; an empty
    table gives an empty one; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(src, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                raw = part.column(1).cast(pa.binary() if pa.types.is_string(part.column(1).type) else pa.large_binary()).to_pylist()
                lettered = part.column(2).to_pylist()
                langs, scores = ["und"] * len(raw), np.zeros(len(raw))
                own = [i for i, ok in enumerate(lettered) if ok]
                if model is not None and own:
                    p = model.pooled([raw[i] for i in own])
                    top = p.argmax(axis=1)
                    scores[own] = np.clip(p[np.arange(len(own)), top], 0, 1)
                    for i, k in zip(own, top.tolist(), strict=True):
                        langs[i] = model.labels[k]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = src.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
