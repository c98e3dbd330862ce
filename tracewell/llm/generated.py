"""Generated, minified or vendored files and data saved as code.

Notices in the header label files: in the path, in the leading comment, or as a declaration that
only opens a table of values. The features never see them. A random forest on compression ratio,
token entropy, identifier lengths and comment density is fitted on all labelled files and scores
every file. A notice in path or comment names a file by itself; any other file is named by the
forest alone, from a probability that is set on all labelled files too, each scored by a forest
fitted without it.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

#: Parts of the labelled files. To set the probability, each is scored by a forest fitted on the other parts.
FOLDS = 4
#: Least share of labelled files among the files that reach the probability set.
PRECISION = 0.5
#: Bins of a feature, of about equal share over all files, between which the forest may split.
BINS = 32
#: Steps for each doubling of a feature and one, in which files are counted to set the bins.
STEPS = 1024
#: Files for each task of a fit, and most tasks: the draws of a forest then depend on the files alone.
TASK_FILES, TASKS = 5_000, 64
TREES, DEPTH, LEAF, SEED = 24, 10, 10, 7

FEATURES = ("compression", "entropy", "ident_length", "ident_short", "ident_share", "token_pace", "comment_density")
_TOKEN = re.compile(r"[^\W\d]\w*|\d+|[^\w\s]")
_IDENT = re.compile(r"[^\W\d]\w*")
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define)|/\*|\*|--).*$", re.M)

_PARTS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("line_start", T.LongType()),
        T.StructField("symbol_id", T.LongType()),
        T.StructField("notice", T.BooleanType()),
        T.StructField("opening", T.BooleanType()),
        *[T.StructField(c, T.DoubleType()) for c in ("chars", "packed", "entropy_sum", "tokens", "ident_sum", "idents", "short", "comment")],
    ]
)


def measures(text: str) -> tuple[float, ...]:
    """Additive parts of the features of one text, in the order of the schema above."""
    from .generated_rules import hidden

    body = hidden(text)
    raw = body.encode("utf-8", "replace")
    tokens = Counter(_TOKEN.findall(body))
    n = sum(tokens.values())
    entropy = -sum(c * math.log2(c / n) for c in tokens.values()) if n else 0.0
    idents = [(w, c) for w, c in tokens.items() if _IDENT.match(w)]
    return (
        float(len(raw)),
        float(len(zlib.compress(raw, 6))) if raw else 0.0,
        entropy,
        float(n),
        float(sum(len(w) * c for w, c in idents)),
        float(sum(c for _, c in idents)),
        float(sum(c for w, c in idents if len(w) == 1)),
        float(sum(len(m) for m in _COMMENT.findall(body))),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .generated_rules import opening_notice, text_notice

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(3).to_pylist()
            notices = [pa.array([notice(t) for t in texts]) for notice in (text_notice, opening_notice)]
            cols = list(zip(*[measures(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *notices, *(pa.array(c, pa.float64()) for c in cols)], names=_PARTS.names)


def _by_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .generated_rules import path_notice

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([path_notice(p) for p in b.column(1).to_pylist()])], names=["file_id", "path_notice"])


def file_features(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_id, path_notice, text_notice, opening`` and the features, one row per file.

    The parts are measured per text and summed map-side, so a file with many symbols is never
    gathered; the notices are those of the file's first text.
    """
    texts = symbols.where(F.col("file_id").isNotNull() & F.col("source_text").isNotNull()).select(
        F.col("file_id").cast("long").alias("file_id"), F.coalesce(F.col("line_start").cast("long"), F.lit(2**40)).alias("line_start"), F.col("symbol_id").cast("long").alias("symbol_id"), "source_text"
    )
    parts = texts.mapInArrow(_measure, _PARTS)
    sums = parts.groupBy("file_id").agg(
        *[F.min_by(c, F.struct("line_start", "symbol_id")).alias(to) for c, to in (("notice", "text_notice"), ("opening", "opening"))],
        *[F.sum(c).alias(c) for c in _PARTS.names[5:]],
    )
    paths = files.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "path").dropDuplicates(["file_id"]).mapInArrow(_by_path, "file_id long, path_notice boolean")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return paths.join(sums, "file_id", "left").select(
        "file_id",
        "path_notice",
        F.coalesce("text_notice", F.lit(False)).alias("text_notice"),
        F.coalesce("opening", F.lit(False)).alias("opening"),
        ratio("packed", "chars").alias("compression"),
        ratio("entropy_sum", "tokens").alias("entropy"),
        ratio("ident_sum", "idents").alias("ident_length"),
        ratio("short", "idents").alias("ident_short"),
        ratio("idents", "tokens").alias("ident_share"),
        ratio("chars", "tokens").alias("token_pace"),
        ratio("comment", "chars").alias("comment_density"),
        F.coalesce("chars", F.lit(0.0)).alias("chars"),
    )


def _weight(hits, named, labelled):
    """F-measure with beta 1/2, of numbers, arrays or columns."""
    return 1.25 * hits / (0.25 * labelled + named)


def _proven(hits, named, precision: float):
    return hits >= precision * (named + 2)


def threshold(scored: list[tuple[float, float]], precision: float = PRECISION) -> float:
    """The probability from which most labelled files are named, weighing false names double, at no less than the precision
    (of two files more, so that a few files prove nothing); above 1 if there is none.

    ``scored`` are (probability, label) pairs of files, each scored by a forest that wasn't fitted on it.
    """
    import numpy as np

    if not scored:
        return 2.0
    p, y = np.array(scored, float).T
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits, named = np.cumsum(y), np.arange(1, len(y) + 1)
    # At the last file of each run of equal probabilities.
    ok = np.r_[p[1:] != p[:-1], True] & _proven(hits, named, precision)
    if not ok.any():
        return 2.0
    at = int(np.argmax(np.where(ok, _weight(hits, named, max(1.0, y.sum())), -1.0)))
    # Between the last file named and the first one not named.
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


def threshold_of_all(scored: DataFrame, precision: float = PRECISION) -> float:
    """The same over a table of ``probability, label``, of any size: equal probabilities are counted map-side, and what
    one task sums up is a slice of their range.
    """
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = scored.groupBy("probability").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("named"))
    # Written once, so that all readers below see the same slices.
    sliced = cut(counts.repartitionByRange(parts, F.desc("probability")).withColumn("slice", F.spark_partition_id()))
    before, labelled, seen = [], 0.0, 0
    # One row a slice.
    for r in sliced.groupBy("slice").agg(F.sum("hits").alias("hits"), F.sum("named").alias("named")).orderBy("slice").collect():
        before.append((r["slice"], labelled, seen))
        labelled, seen = labelled + r["hits"], seen + r["named"]
    if not before:
        return 2.0
    offsets = scored.sparkSession.createDataFrame(before, "slice int, hits_before double, named_before long")
    inside = Window.partitionBy("slice").orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sliced.select("slice", "probability", *[F.sum(c).over(inside).alias(c) for c in ("hits", "named")]).join(offsets, "slice")
    hits, named = F.col("hits") + F.col("hits_before"), F.col("named") + F.col("named_before")
    best = upto.where(_proven(hits, named, precision)).agg(F.max_by("probability", F.struct(_weight(hits, named, max(1.0, labelled)), "probability"))).first()[0]
    if best is None:
        return 2.0
    after = sliced.where(F.col("probability") < best).agg(F.max("probability")).first()[0]
    return (best + (after or 0.0)) / 2


def _steps(feature: str) -> Column:
    return F.floor(F.log2(F.col(feature) + 1) * STEPS).cast("double")


def cuts(features: DataFrame) -> list[list[float]]:
    """For each feature the steps at which a new bin begins, from the counts of all files at each step."""
    steps = features.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), _steps(c).alias("step")) for i, c in enumerate(FEATURES)])))
    # At most STEPS rows for each doubling, however many files there are.
    counts = steps.groupBy("feature", "step").count().orderBy("feature", "step").collect()
    out: list[list[float]] = [[] for _ in FEATURES]
    n = sum(r["count"] for r in counts) // len(FEATURES)
    for i, found in enumerate(out):
        held, left = 0, n
        for r in counts:
            if r["feature"] != i:
                continue
            # The fit looks for the values that a feature takes among ten thousand files: no bin is so small that it could miss it.
            if held * BINS >= n and left * BINS * 16 >= n:
                found.append(r["step"])
                held = 0
            held, left = held + r["count"], left - r["count"]
    return out


def binned(features: DataFrame) -> DataFrame:
    """``features`` of files with text, with the vector ``features`` of their bins, in an order fixed by the files."""
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    splits = [[-math.inf, *(found or [0.0]), math.inf] for found in cuts(features)]
    bins = [f"{c}_bin" for c in FEATURES]
    steps = features.withColumns({f"{c}_step": _steps(c) for c in FEATURES})
    found = Bucketizer(splitsArray=splits, inputCols=[f"{c}_step" for c in FEATURES], outputCols=bins).transform(steps)
    # Bins are numbers to the forest; their mark as categories goes.
    found = found.withColumns({b: F.col(b).alias(b, metadata={}) for b in bins})
    rows = VectorAssembler(inputCols=bins, outputCol="features").transform(found).select("file_id", "label", "fold", "features")
    # Each task of a fit draws by the place of a row.
    return cut(rows.repartition(min(TASKS, 1 + features.count() // TASK_FILES), "file_id").sortWithinPartitions(F.xxhash64("file_id"), "file_id"))


def probabilities(rows: DataFrame) -> tuple[DataFrame, float]:
    """``file_id, probability`` by a forest fitted on all ``rows``, and the probability from which it names a file.

    None and above 1 if labels are all alike; a fold without which they are doesn't count.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, maxBins=BINS, seed=SEED, featureSubsetStrategy="all", subsamplingRate=0.8)

    def scored(fold: int | None) -> DataFrame:
        """A fold by the forest of the others, or all rows by the forest of all."""
        fitted, to = (rows, rows) if fold is None else (rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold))
        return forest.fit(fitted).transform(to).select("file_id", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))

    pairs = [(r["fold"], r["label"]) for r in rows.select("fold", "label").distinct().collect()]
    if len({label for _, label in pairs}) < 2:
        return rows.select("file_id", F.lit(0.0).alias("probability")), 2.0
    folds = [k for k in range(FOLDS) if len({label for fold, label in pairs if fold != k}) == 2]
    # The fits are many small jobs that leave room beside each other.
    with ThreadPool(FOLDS + 1) as pool:
        named, *apart = pool.map(inheritable_thread_target(rows.sparkSession)(scored), [None, *folds])
    return named.drop("label"), threshold_of_all(functools.reduce(DataFrame.union, apart)) if apart else 2.0


def classify(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_id, sign, probability``: files that aren't hand-written; sign is path, text or forest.

    Defined results: a file without symbols or with null or empty texts is judged by its path alone, a
    null path by its text alone; repeated file ids count once, repeated symbols weigh as often
    as they come; rows with a null file_id and further columns are ignored; an empty table, or
    labels all alike, leave only what notices say.
    """
    noticed = F.col("path_notice") | F.col("text_notice")
    features = file_features(files, symbols).withColumn("label", (noticed | F.col("opening")).cast("double"))
    # Written once: the bins, the fits and the result all read it.
    features = cut(features.withColumn("fold", F.pmod(F.shiftright(F.xxhash64("file_id"), 8), F.lit(FOLDS))))
    found, least = probabilities(binned(features.where("chars > 0")))
    sign = F.when(F.col("path_notice"), "path").when(F.col("text_notice"), "text").when(F.col("probability") >= least, "forest")
    return features.join(found, "file_id", "left").select("file_id", sign.alias("sign"), F.coalesce("probability", F.lit(0.0)).alias("probability")).where("sign is not null")
