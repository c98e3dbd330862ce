"""Reciprocal-rank fusion of a keyword and a vector leg."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fusion constant and the labels of a hit.
RRF_K = 60
BOTH, KEYWORD, SEMANTIC = "hybrid (BM25 + semantic)", "keyword match (BM25)", "semantic match (vector)"


def ranked(leg: DataFrame, score: str, name: str) -> DataFrame:
    """``id, <name>``: 1-based rank of a leg. A leg holds a few dozen rows, so one task ranks it."""
    return leg.select("id", F.row_number().over(Window.orderBy(score, "id")).alias(name))


def fuse(keyword: DataFrame, vector: DataFrame, top_k: int = 10, code: bool = True) -> DataFrame:
    """``id, rrf, bm25_rank, vec_rank, score, confidence, match_reason`` of the best hits of two legs (``id, score`` and ``id, distance``).

    Order: fused score, then rank in the keyword leg, then in the vector leg. The displayed score
    relates the fused one to the best that was possible: with ``code`` for the legs that hit,
    otherwise for both.
    """
    none = F.lit(None).cast("int")
    both = ranked(keyword, "score", "r").select("id", F.col("r").alias("bm25_rank"), none.alias("vec_rank")).unionByName(
        ranked(vector, "distance", "r").select("id", none.alias("bm25_rank"), F.col("r").alias("vec_rank"))
    )
    part = lambda c: F.coalesce(1.0 / (F.lit(float(RRF_K)) + F.col(c)), F.lit(0.0))
    hits = both.groupBy("id").agg(F.max("bm25_rank").alias("bm25_rank"), F.max("vec_rank").alias("vec_rank")).withColumn("rrf", part("bm25_rank") + part("vec_rank"))
    twice = F.col("bm25_rank").isNotNull() & F.col("vec_rank").isNotNull()
    possible = F.when(twice, 2.0 / (RRF_K + 1)).otherwise(1.0 / (RRF_K + 1)) if code else F.lit(2.0 / (RRF_K + 1))
    percent = F.least(F.lit(100.0), F.round(F.col("rrf") / possible * 100, 9))
    return (
        hits.withColumn("score", F.round(percent, 1))
        .withColumn("confidence", F.round(percent / 100, 3))
        .withColumn("match_reason", F.when(twice, BOTH).when(F.col("bm25_rank").isNotNull(), KEYWORD).otherwise(SEMANTIC))
        .orderBy(F.desc("rrf"), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last())
        .limit(top_k)
    )
