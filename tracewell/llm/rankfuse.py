"""One ranking from several differently scaled scores: first principal component of ranks.

Scores of one query are replaced by their ranks, so neither range nor distribution matters.
The correlation matrix of the ranks is aggregated per query; its first principal component
weighs the scores. A component's sign is arbitrary and its loadings may even oppose each
other when scores disagree, so each loading is oriented to the declared direction of its
score. Items are ordered by their projection.

Ranks are taken without ever putting a query's items into one task: distinct scores are
pre-aggregated, range-partitioned over all queries at once, and each stretch of a query in a
partition gets its offset from the counts of the stretches before it. What a query as a whole
has (its size, moments and loadings) is one row a query, joined back to its items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def distributed_rank(values: DataFrame, group: str, score: str) -> DataFrame:
    """``group, score, rank double, n_scored long``: average rank (1 = smallest) of each distinct score in its group.

    ``values`` has one row per item; null scores get no rank. Ties share the mean of their
    ranks. A group may hold any share of all rows: equal scores are counted map-side, and what
    one task sorts is a slice of the whole, not a group.
    """
    spark = values.sparkSession
    counts = values.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that both readers below see the same stretches.
    sliced = cut(counts.repartitionByRange(parts, group, score).withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(group, "_slice").agg(F.sum("_n").alias("_sum"))
    by_slice = Window.partitionBy(group).orderBy("_slice")
    offsets = totals.select(
        group,
        "_slice",
        F.coalesce(F.sum("_sum").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy(group)).alias("n_scored"),
    )
    inside = F.sum("_n").over(Window.partitionBy(group, "_slice").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        sliced.withColumn("_upto", inside)
        .join(offsets, [group, "_slice"])
        .select(group, score, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias("rank"), "n_scored")
    )


def principal_weights(matrix: list[list[float]]) -> list[float]:
    """Loadings of the first principal component of a correlation matrix, each oriented to its score's declared direction.

    Where the largest eigenvalue is a multiple one, as that of uncorrelated scores, the component
    taken is the one of its space that lies nearest to equal loadings.
    """
    import numpy as np

    values, vectors = np.linalg.eigh(np.array(matrix, float))
    top = vectors[:, values >= values[-1] - 1e-9]
    w = np.abs(top @ top.sum(0)) if top.shape[1] > 1 else np.abs(top[:, 0])
    return (w / np.linalg.norm(w)).tolist()


def fuse_rankings(items: DataFrame, group: str, item: str, scores: Sequence[tuple[str, bool]]) -> DataFrame:
    """One order per group over all scores: ``group, item, projection double`` and ``rank_<score>``.

    ``items`` has at most one row per (group, item); ``scores`` are (column, smaller_is_better).
    The best item has the largest projection; ties are ordered by item.

    Defined results: an item without a score (null or NaN) stands behind all that have it, at
    the mean of the places left over; rows with a null group or item are left out; a score that
    is constant in a group (or a group of one item) has no variance and counts nothing; an
    empty table gives no rows; further columns are ignored.

    Each group's matrix is solved in Arrow batches. For two scores the oriented loadings come out
    equal in size whatever their correlation, so both count alike.
    """
    names = [c for c, _ in scores]
    clean = items.select(group, item, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in names])
    clean = clean.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    # A smaller rank is better throughout.
    for c, smaller in scores:
        if not smaller:
            clean = clean.withColumn(c, -F.col(c))
    clean = cut(clean)
    sizes = clean.groupBy(group).agg(F.count(F.lit(1)).alias("_all"))
    ranked = clean.join(sizes, group)
    for c in names:
        ranks = distributed_rank(clean, group, c).select(group, c, F.col("rank").alias(f"rank_{c}"))
        ranked = ranked.join(ranks, [group, c], "left")
    counted = [F.count(f"rank_{c}").alias(f"_has_{c}") for c in names]
    # Standardised ranks need the moments of each group, missing ones filled in.
    ranked = cut(ranked.select(group, item, "_all", *[f"rank_{c}" for c in names]))
    have = ranked.groupBy(group).agg(*counted)
    filled = ranked.join(have, group)
    for c in names:
        filled = filled.withColumn(f"rank_{c}", F.coalesce(f"rank_{c}", (F.col(f"_has_{c}") + 1 + F.col("_all")) / F.lit(2.0)))
    filled = filled.select(group, item, *[f"rank_{c}" for c in names])
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    moments = filled.groupBy(group).agg(
        *[F.avg(f"rank_{c}").alias(f"_avg_{c}") for c in names],
        *[F.stddev_pop(f"rank_{c}").alias(f"_std_{c}") for c in names],
        *[F.corr(f"rank_{names[i]}", f"rank_{names[j]}").alias(f"_r_{i}_{j}") for i, j in pairs],
    )
    weighted = _loadings(moments, names, pairs)
    z = [
        F.when(F.col(f"_std_{c}") > 0, (F.col(f"_avg_{c}") - F.col(f"rank_{c}")) / F.col(f"_std_{c}")).otherwise(0.0) * F.col(f"_w_{c}")
        for c in names
    ]
    total = z[0]
    for x in z[1:]:
        total = total + x
    return filled.join(weighted, group).select(group, item, total.alias("projection"), *[f"rank_{c}" for c in names])


def _loadings(moments: DataFrame, names: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """The groups' moments with the oriented loadings ``_w_<score>``."""
    if len(names) == 1:
        return moments.withColumn(f"_w_{names[0]}", F.lit(1.0))
    r = F.array(*[F.coalesce(F.nanvl(F.col(f"_r_{i}_{j}"), F.lit(0.0)), F.lit(0.0)) for i, j in pairs])

    @F.pandas_udf("array<double>")
    def solve(rows):
        import pandas as pd

        out = []
        for row in rows:
            m = [[1.0] * len(names) for _ in names]
            for (i, j), v in zip(pairs, row):
                m[i][j] = m[j][i] = float(v)
            out.append(principal_weights(m))
        return pd.Series(out)

    solved = moments.withColumn("_w", solve(r))
    return solved.withColumns({f"_w_{c}": F.get("_w", F.lit(k)) for k, c in enumerate(names)})


def heads(ranking: DataFrame, group: str, item: str) -> DataFrame:
    """The item at the head of each group's order; combined map-side."""
    best = F.min_by(item, F.struct((-F.round("projection", 9)).alias("p"), F.col(item)))
    return ranking.groupBy(group).agg(best.alias(item))


def search_scores(symbols_fts: DataFrame, symbol_embeddings: DataFrame) -> DataFrame:
    """``query_id, symbol_id, bm25_score, vec_distance``: one row per scored pair, repeated rows joined by their best score."""
    keyword = symbols_fts.where("query_id is not null and symbol_id is not null").select("query_id", "symbol_id", "bm25_score", F.lit(None).cast("double").alias("vec_distance"))
    vector = symbol_embeddings.where("query_id is not null and symbol_id is not null").select("query_id", "symbol_id", F.lit(None).cast("double").alias("bm25_score"), "vec_distance")
    number = lambda c: F.min(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c)
    return keyword.unionByName(vector).groupBy("query_id", "symbol_id").agg(number("bm25_score"), number("vec_distance"))
