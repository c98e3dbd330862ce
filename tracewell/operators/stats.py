"""Index statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

TOP_EXTENSIONS = 10


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of each table, in one plan."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def kind_histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def extension_histogram(files: DataFrame, compat: bool = False, top: int = TOP_EXTENSIONS) -> DataFrame:
    """The most frequent extensions; with ``compat`` everything from the path's first dot counts as one."""
    path = F.col("path")
    ext = text.extension_from_first_dot(path) if compat else text.extension(path)
    rows = files.where(F.contains(path, F.lit("."))) if compat else files.where(ext != "")
    return rows.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(top)


def as_map(histogram: DataFrame, key: str, value: str = "n") -> DataFrame:
    """A histogram as one map-typed row, for the API."""
    return histogram.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("distribution"))


def last_indexed(files: DataFrame, doc_files: DataFrame) -> DataFrame:
    return files.agg(F.max("last_modified").alias("last_code")).withColumn("last_docs", doc_files.agg(F.max("last_modified")).scalar())
