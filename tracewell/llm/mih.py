"""Most similar vectors by multi-index hashing over learned binary codes.

Vectors are projected on their principal axes, rotated so that signs lose least (iterative
quantisation) and reduced to 64 sign bits. A code is cut into m substrings, each indexed by
its value. By the pigeonhole principle two codes within Hamming distance m - 1 agree in at
least one substring, so probing the m buckets of a code retrieves every code within that
radius. What a bucket brings is reranked by the cosine of the floats inside the bucket's own
task, and only the best k of each row leave it: no pair list of a bucket is ever written.

Substrings are as wide as keeps a bucket at a few rows whatever the number of rows; wider ones
agree less often, so their number grows slowly with the rows, over further rotations where one
code has no bits left. A hot bucket is cut into blocks and its block pairs are worked by
different tasks. Rows whose buckets bring fewer than k others probe all buckets within one bit
of theirs, and what is short even then meets all rows in blocks, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, stored

DIM, K = 64, 5
#: Rows on which the projection and rotation are fitted (the index holds every row).
FIT_ROWS = 16_384
#: Rows that a bucket has about; sets the width of a substring.
BUCKET_ROWS = 8
#: Substrings up to BASE_ROWS rows, and the power of the rows with which their number grows beyond.
SUBSTRINGS, BASE_ROWS, GROWTH = 5, 100_000, 0.25
#: Least and greatest width of a substring.
WIDTHS = (4, 32)
#: Rows per block of a bucket; hot buckets are worked as pairs of blocks.
BLOCK = 4096
#: Rows of a block of all rows that short rows meet.
MEETING = 65_536


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """One row per id with a vector of the right length, without null, NaN or infinite numbers, that isn't all zero."""
    ok = (
        F.col(id_col).isNotNull()
        & (F.size(vec_col) == dim)
        & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vec_col, lambda x: x != 0)
    )
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def fit_rotation(sample: np.ndarray, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthogonal map of unit vectors: principal axes, then the rotation that brings them nearest to signs."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(sample)))
    projected = centred @ axes[:, ::-1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(sample.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ vt).T
    return mean, axes[:, ::-1] @ turn


def cuts(bits: int, m: int) -> list[tuple[int, int]]:
    """(shift, width) of m substrings as even as possible."""
    edges = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def layout(rows: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(rotation, shift, width) of the substrings for so many rows."""
    width = min(WIDTHS[1], max(WIDTHS[0], np.log2(max(2, rows) / BUCKET_ROWS)))
    each = max(1, round(bits / width))
    wanted = max(SUBSTRINGS, int(np.ceil(SUBSTRINGS * (rows / BASE_ROWS) ** GROWTH)))
    return [(r, a, w) for r in range(-(-wanted // each)) for a, w in cuts(bits, each)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _floats(m: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(m, "float32").ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), flat)


def encode(vectors: DataFrame, spans: list[tuple[int, int, int]], dim: int = DIM, fit_rows: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """``id, buckets array<long>, unit array<float>``. ``vectors(id, vec)`` must be usable ones.

    The fit takes the ``fit_rows`` rows with the smallest hash of their id: a bounded sample
    that doesn't depend on partitioning.
    """
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").toPandas()
    turns = sorted({r for r, _, _ in spans})
    if len(sample):
        x = np.stack(sample["vec"].to_numpy()).astype("float64")
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        fitted = [fit_rotation(x, seed=seed + r) for r in turns]
    else:
        fitted = [(np.zeros(dim), np.eye(dim)) for _ in turns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim).astype("float64")
            # Scaled first, so that huge or tiny numbers neither overflow nor vanish.
            x /= np.abs(x).max(1, keepdims=True)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            bits = [(unit - mean) @ turn > 0 for mean, turn in fitted]
            buckets = np.zeros((len(x), len(spans)), "i8")
            for j, (r, shift, width) in enumerate(spans):
                part = bits[r][:, shift : shift + width]
                buckets[:, j] = (j << 40) + part @ (1 << np.arange(part.shape[1], dtype="i8"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, len(spans)), pa.int32()), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, _floats(unit)], names=["id", "buckets", "unit"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, buckets array<long>, unit array<float>")


def _best(ids_a, a, ids_b, b, k: int):
    """Of each row of a its k most similar of b, as (id, other, similarity) arrays."""
    found = []
    step = max(1, 4_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        s = slice(at, at + step)
        sims = a[s] @ b.T
        sims[ids_a[s, None] == ids_b[None, :]] = -9
        few = min(len(b), k + 3)
        top = np.argpartition(-sims, few - 1, axis=1)[:, :few] if few < len(b) else np.tile(np.arange(len(b)), (len(sims), 1))
        rows = np.repeat(np.arange(len(sims)), top.shape[1])
        cols = top.ravel()
        ok = sims[rows, cols] > -5
        rows, cols = rows[ok], cols[ok]
        exact = np.einsum("ij,ij->i", a[s][rows].astype("float64"), b[cols].astype("float64"))
        order = np.lexsort((ids_b[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        found.append((ids_a[s][rows[keep]], ids_b[cols[keep]], exact[keep]))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.array([], "i8"), np.array([], "i8"), np.array([])]


_OUT = "id long, other long, sim double"


def _emit(parts) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["id", "other", "sim"])


def _bucket_worker(dim: int, k: int, both: bool = True):
    """Works rows that come sorted by bucket; side 0 = one block with itself, 1 and 2 = the two sides of a pair (only 1 asks unless ``both``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list = []

        def work(key, side, ids, m):
            edges = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1), True])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo < 2:
                    continue
                i, x, sd = ids[lo:hi], m[lo:hi], side[lo:hi]
                if sd[0] == 0 and sd[-1] == 0:
                    done.append(_best(i, x, i, x, k))
                else:
                    p, q = sd == 1, sd == 2
                    if p.any() and q.any():
                        done.append(_best(i[p], x[p], i[q], x[q], k))
                        if both:
                            done.append(_best(i[q], x[q], i[p], x[p], k))

        def merged():
            return [np.concatenate(x) for x in zip(*held)]

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(j).to_numpy() for j in range(3)], 1)
            held.append((key, b.column(3).to_numpy(), b.column(4).to_numpy(), _matrix(b.column(5), dim)))
            if np.array_equal(held[0][0][0], key[-1]):
                continue  # still the same bucket
            key, side, ids, m = merged()
            last = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1
            work(key[:last], side[:last], ids[:last], m[:last])
            held[:] = [(key[last:], side[last:], ids[last:], m[last:])]
            if sum(len(x[0]) for x in done) > 20_000:
                yield _emit(done)
                done.clear()
        if held:
            work(*merged())
        if done:
            yield _emit(done)

    return run


def neighbours(vectors: DataFrame, id_col: str = "symbol_id", vec_col: str = "embedding", dim: int = DIM, k: int = K, fit_rows: int = FIT_ROWS, block: int = BLOCK, spans: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """``id, other, sim``: of every usable vector its k most similar others by cosine, best first by (sim, other id).

    Defined results: vectors that are null, of another length, all zero or hold null, NaN or
    infinite numbers take no part; repeated ids count once (the smallest vector); equal vectors
    of different ids are neighbours at similarity 1; fewer than k others give fewer rows; an
    empty table gives none; further columns are ignored. Approximate only in that a neighbour
    that shares no substring is missed unless its row found fewer than k.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    spans = spans or layout(rows, min(dim, 64))
    base = cut(encode(usable(vectors, id_col, vec_col, dim), spans, dim, fit_rows))
    probes = base.select("id", F.explode("buckets").alias("bucket"))
    # Buckets beyond one block; their number is bounded by rows * substrings / block.
    hot = probes.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    # Stored, so that the vectors needn't be shuffled to meet the few hot buckets.
    hot = stored(hot)
    full = base.select("id", "unit", F.explode("buckets").alias("bucket"))
    laid = full.join(hot, "bucket", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    other = F.sequence(F.lit(0), F.col("nb") - 1)
    laid = laid.withColumn("b", own).select("id", "unit", "bucket", "b", F.explode(other).alias("x"))
    side = F.when(F.col("b") == F.col("x"), 0).when(F.col("b") < F.col("x"), 1).otherwise(2)
    laid = laid.select("bucket", F.least("b", "x").alias("lo"), F.greatest("b", "x").alias("hi"), side.alias("side"), "id", "unit")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    group = ["bucket", "lo", "hi"]

    def worked(rows: DataFrame, both: bool) -> DataFrame:
        return rows.repartition(parts, *group).sortWithinPartitions(*group, "side").mapInArrow(_bucket_worker(dim, k, both), _OUT)

    found = cut(_top(worked(laid, True), k))

    def short(near: DataFrame) -> DataFrame:
        return base.join(near.where(F.size("best") >= k).select("id"), "id", "left_anti")

    few = cut(short(found))
    if not few.isEmpty():
        found = cut(_merged(found, _top(worked(_widened(few, base, spans), False), k), k))
        few = cut(short(found))
    if not few.isEmpty():
        # What is short even then meets all rows, block by block.
        blocks = max(parts, rows // MEETING + 1)
        asked = few.select("id", "unit", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x"), F.lit(1).alias("ask"))
        every = base.select("id", "unit", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("x"), F.lit(0).alias("ask"))
        rest = asked.unionByName(every).repartition(blocks, "x").sortWithinPartitions("x", "ask").mapInArrow(_all_worker(dim, k), _OUT)
        found = _merged(found, _top(rest, k), k)
    return found.select("id", F.explode("best").alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.n")).alias("sim"))


def _widened(few: DataFrame, base: DataFrame, spans: list[tuple[int, int, int]]) -> DataFrame:
    """Rows for the bucket workers in which ``few`` ask the members of all buckets one bit away from theirs."""
    flips = F.array(*[F.array(*[F.lit(1 << b).cast("long") for b in range(w)]) for _, _, w in spans])
    near = F.flatten(F.transform("buckets", lambda v, j: F.transform(F.get(flips, j), lambda f: v.bitwiseXOR(f))))
    asked = few.select(F.explode(near).alias("bucket"), "id", "unit")
    members = base.select(F.explode("buckets").alias("bucket"), "id", "unit").join(stored(asked.select("bucket").distinct()), "bucket", "left_semi")
    zero, one = F.lit(0), F.lit(1)
    return asked.select("bucket", zero.alias("lo"), one.alias("hi"), one.alias("side"), "id", "unit").unionByName(members.select("bucket", zero.alias("lo"), one.alias("hi"), F.lit(2).alias("side"), "id", "unit"))


def _all_worker(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, mats = None, [], []
        for b in batches:
            part, ask = b.column(2).to_numpy(), b.column(3).to_numpy()
            i, m = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            for v in np.unique(part):
                if v != x:
                    x, ids, mats = v, [], []
                here = part == v
                data, wanted = here & (ask == 0), here & (ask == 1)
                if data.any():
                    ids.append(i[data])
                    mats.append(m[data])
                if wanted.any() and ids:
                    if len(ids) > 1:
                        ids, mats = [np.concatenate(ids)], [np.concatenate(mats)]
                    yield _emit([_best(i[wanted], m[wanted], ids[0], mats[0], k)])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    pair = F.struct((-F.col("sim")).alias("n"), F.col("other").alias("other"))
    return found.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(pair)), 1, k).alias("best"))


def _merged(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The best k of two lists per row."""
    return a.unionByName(b).groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))


def pairs(near: DataFrame) -> DataFrame:
    """``symbol_a < symbol_b``: pairs of which at least one is among the most similar of the other."""
    return near.select(F.least("id", "other").alias("symbol_a"), F.greatest("id", "other").alias("symbol_b")).distinct()
