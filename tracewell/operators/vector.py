"""Exact nearest neighbours by Euclidean distance, embedding and reranking providers."""

from __future__ import annotations

import logging
import os
import time
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)
LEG = 50


def knn(vectors: DataFrame, id_col: str, vec_col: str, query: Sequence[float], top_k: int = LEG, digits: int = 6) -> DataFrame:
    """``id, distance``: the nearest vectors, ties by id; vectors that are null, of another length or hold NaN are passed over.

    The distance is one fold over two arrays inside the JVM, without a shuffle; only the top-k of each task
    leaves it.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    square = F.aggregate(F.zip_with(F.col(vec_col), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    ok = (F.size(vec_col) == len(query)) & F.col(id_col).isNotNull()
    rows = vectors.where(ok).select(F.col(id_col).alias("id"), F.sqrt(square).alias("distance")).where("not isnan(distance) and distance is not null")
    return rows.select("id", F.round("distance", digits).alias("distance")).orderBy("distance", "id").limit(top_k)


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def choose_device(wanted: str | None = None) -> str:
    """``cuda``, ``mps`` or ``cpu``: the one asked for (or named by TRACEWELL_DEVICE) if it is there, else the fastest that is.

    Without torch there is only the CPU. Executors choose for themselves.
    """
    wanted = (wanted or os.environ.get("TRACEWELL_DEVICE") or "auto").lower()
    there = {"cpu"}
    try:
        import torch

        there |= {"cuda"} if torch.cuda.is_available() else set()
        there |= {"mps"} if torch.backends.mps.is_available() else set()
    except ImportError:
        pass
    if wanted in there:
        return wanted
    if wanted != "auto":
        logger.warning("no device %s here", wanted)
    return next(d for d in ("cuda", "mps", "cpu") if d in there)


def warm_up(embedder: Embedder, task: str = "nl2code") -> float:
    """Embeds one text, so that a provider loads its model before it is needed; returns the seconds that took."""
    began = time.perf_counter()
    made = embedder.embed([f"{task}: warm up"])[0]
    if len(made) != embedder.dim:
        raise ValueError(f"the provider gives vectors of {len(made)} numbers and says {embedder.dim}")
    return time.perf_counter() - began


class HashedNgrams:
    """Deterministic stand-in for a model: hashed character trigrams of a text, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            s = f"  {t.lower()} "
            for i in range(len(s) - 2):
                h = zlib.crc32(s[i : i + 3].encode("utf-8", "replace"))
                v[h % self.dim] += 1.0 if h & 0x10000 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm if norm else 0.0 for x in v])
        return out


class QueryEmbedder:
    """Embeds queries on the driver and keeps the last 128."""

    def __init__(self, embedder: Embedder, task: str = "nl2code"):
        self.dim = embedder.dim
        self._one = lru_cache(maxsize=128)(lambda text: tuple(embedder.embed([f"{task}: {text}"])[0]))

    def __call__(self, text: str) -> list[float]:
        return list(self._one(text))


def embed_column(rows: DataFrame, text_col: str, embedder: Embedder, task: str, out: str = "embedding") -> DataFrame:
    """Adds the embedding of ``"task: text"``; the provider is shipped once and works in Arrow batches. Null text gives null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            here = b.notna()
            made = iter(embedder.embed([f"{task}: {t}" for t in b[here]]))
            yield pd.Series([next(made) if ok else None for ok in here], index=b.index, dtype=object)

    return rows.withColumn(out, run(F.col(text_col)))


class Reranker(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> list[float]: ...


def rerank(hits: DataFrame, query: str, text_col: str, reranker: Reranker | None, top_k: int, order: Sequence[str], most_chars: int = 2000) -> DataFrame:
    """Hits in the order of the reranker's score; without one, unchanged. ``order`` breaks ties (the order so far)."""
    if reranker is None:
        return hits

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(reranker.score(query, [(t or "")[:most_chars] for t in texts]), dtype=float)

    return hits.withColumn("rerank_score", run(F.col(text_col))).orderBy(F.desc("rerank_score"), *order).limit(top_k)
