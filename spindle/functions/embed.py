"""Embedders. Text is split into identifier parts, looked up in a token matrix, averaged by weight and scaled to length 1."""

from __future__ import annotations

import json
import math
import re
import urllib.request
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingRefused
from ..operators.search import missing_embeddings
from .text import PARTS, identifier_tokens

BATCH, BROADCAST_TOKENS = 64, 200_000


class Embedder(Protocol):
    """namespace: (provider, model, dim)."""

    namespace: tuple[str, str, int]

    def embed(self, text: str) -> list[float]: ...

    def embed_nodes(self, nodes: DataFrame) -> DataFrame: ...


def split_one(text: str) -> list[str]:
    return [t.lower() for t in re.split(PARTS, text) if t]


def _scaled(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


class StaticEmbedder:
    """A token matrix from a JSON file {provider, model, dim, tokens, matrix[, weights]}."""

    def __init__(self, path: str, provider: str | None = None, model: str | None = None, dim: int | None = None) -> None:
        try:
            data = json.loads(Path(path).read_text())
        except (OSError, ValueError) as e:
            raise EmbeddingRefused(f"can't read the matrix {path}: {e}") from e
        for key in ("provider", "model", "dim", "tokens", "matrix"):
            if key not in data:
                raise EmbeddingRefused(f"the matrix has no {key!r}")
        tokens, matrix, weights = data["tokens"], data["matrix"], data.get("weights")
        checks = {
            "dim is no positive number": not isinstance(data["dim"], int) or data["dim"] < 1,
            "it has no token": not tokens,
            "tokens repeat": len(set(tokens)) != len(tokens),
            "tokens and rows differ in number": len(tokens) != len(matrix),
            "a row is not of its dim": any(len(r) != data["dim"] for r in matrix),
            "weights and tokens differ in number": weights is not None and len(weights) != len(tokens),
            "a value is no finite number": any(not math.isfinite(x) for r in matrix for x in r),
            "it is not the one configured": any(want is not None and want != data[k] for k, want in (("provider", provider), ("model", model), ("dim", dim))),
        }
        for why, wrong in checks.items():
            if wrong:
                raise EmbeddingRefused(f"the matrix {path} is refused: {why}")
        self.namespace = (data["provider"], data["model"], data["dim"])
        self.rows = {t: (r, w) for t, r, w in zip(tokens, matrix, weights or [1.0] * len(tokens), strict=True)}

    def embed(self, text: str) -> list[float]:
        known = [self.rows[t] for t in split_one(text) if t in self.rows]
        total = sum(w for _, w in known)
        return _scaled([sum(w * r[i] for r, w in known) / total for i in range(self.namespace[2])]) if total else [0.0] * self.namespace[2]

    def embed_nodes(self, nodes: DataFrame) -> DataFrame:
        """(node_id, vec) by a join with the matrix; without any known token the vector is zero."""
        spark, dim = nodes.sparkSession, self.namespace[2]
        matrix = spark.createDataFrame([(t, [float(x) for x in r], float(w)) for t, (r, w) in self.rows.items()], "token string, r array<double>, w double")
        matrix = F.broadcast(matrix) if len(self.rows) <= BROADCAST_TOKENS else matrix
        own = nodes.select(F.col("id").alias("node_id"), F.posexplode_outer(identifier_tokens(F.concat_ws(" ", "title", "body"))).alias("pos", "token"))
        sums = [F.coalesce(F.sum(F.col("w") * F.get("r", F.lit(i))), F.lit(0.0)) for i in range(dim)]
        pooled = own.join(matrix, "token", "left").groupBy("node_id").agg(F.array(*sums).alias("v"))
        n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        return pooled.select("node_id", F.transform("v", lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")).alias("vec"))


class ServerEmbedder:
    """A local HTTP embedding server; texts go in batches. Its dimension is measured, not believed."""

    def __init__(self, model: str, url: str = "http://127.0.0.1:11434", dim: int | None = None, timeout: int = 120) -> None:
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout
        found = len(self.many(["probe"])[0])
        if dim is not None and dim != found:
            raise EmbeddingRefused(f"{model} gives {found} values, not {dim}")
        self.namespace = ("ollama", model, found)

    def many(self, texts: list[str]) -> list[list[float]]:
        """Vectors at length 1 in order; empty texts aren't sent and have zero vectors. Another number of vectors is refused."""
        asked = [t for t in texts if t.strip()]
        got: list = []
        if asked:
            body = json.dumps({"model": self.model, "input": asked}).encode()
            request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    got = json.load(r).get("embeddings", [])
            except (OSError, ValueError) as e:
                raise EmbeddingRefused(f"the embedding server at {self.url} failed: {e}") from e
            if len(got) != len(asked):
                raise EmbeddingRefused(f"asked for {len(asked)} vectors, got {len(got)}")
        vectors, zero = iter(got), [0.0] * (len(got[0]) if got else 1)
        return [_scaled(next(vectors)) if t.strip() else zero for t in texts]

    def embed(self, text: str) -> list[float]:
        return self.many([text])[0]

    def embed_nodes(self, nodes: DataFrame) -> DataFrame:
        many = self.many

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at in range(0, len(part), BATCH):
                    some = part.iloc[at : at + BATCH]
                    yield pd.DataFrame({"node_id": some["node_id"], "vec": many(some["text"].tolist())})

        return nodes.select(F.col("id").alias("node_id"), F.concat_ws(" ", "title", "body").alias("text")).mapInPandas(run, "node_id long, vec array<float>")


def from_locator(locator: str) -> Embedder:
    """`static:<file>` or `ollama:<model>[@<url>]`; anything else is refused."""
    kind, _, rest = locator.partition(":")
    if kind == "static" and rest:
        return StaticEmbedder(rest)
    m = re.fullmatch(r"([\w./-]+(?::[\w.-]+)?)(?:@(https?://[\w.\-\[\]]+(?::\d+)?))?", rest)
    if kind == "ollama" and m:
        return ServerEmbedder(m[1], *([m[2]] if m[2] else []))
    raise EmbeddingRefused(f"{locator!r} is neither static:<file> nor ollama:<model>[@<url>]")


def from_config(config: dict | None) -> Embedder | None:
    """An embedder from {provider, model, dim, locator}; None if there is no such block, half a block is refused."""
    if not config:
        return None
    lacking = [k for k in ("provider", "model", "dim", "locator") if k not in config]
    if lacking:
        raise EmbeddingRefused(f"the embeddings block lacks {', '.join(lacking)}")
    found = from_locator(config["locator"])
    if found.namespace != (config["provider"], config["model"], config["dim"]):
        raise EmbeddingRefused(f"configured {config['provider']}/{config['model']}/{config['dim']}, found {'/'.join(map(str, found.namespace))}")
    return found


def embed_store(store, embedder: Embedder):
    """(store, embedded, degenerate): vectors for the nodes that lack one in the namespace; zero vectors are counted and not stored. If all are zero nothing is written."""
    got = embedder.embed_nodes(missing_embeddings(store.nodes, store.embeddings, embedder.namespace))
    zero = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) == 0
    n = got.agg(F.count("*").alias("n"), F.count_if(zero).alias("z")).first()
    if n["n"] and n["n"] == n["z"]:
        raise EmbeddingRefused(f"all {n['n']} vectors are zero")
    return store.with_embeddings(got.where(~zero), embedder.namespace), n["n"] - n["z"], n["z"]
