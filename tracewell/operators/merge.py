"""Merging scans and extracted rows into stored tables without in-place updates: every function gives the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key. Source keys must be unique; null keys never replace."""
    return target.join(source.select(*key), list(key), "left_anti").select(target.columns).unionByName(source.select(target.columns))


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(rows.columns)


def insert_or_ignore(target: DataFrame, source: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Source rows whose key is new, first one wins; what is stored stays."""
    fresh = first_wins(source, key, order).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(fresh.select(target.columns))


def delete_by(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*key).distinct(), list(key), "left_anti").select(target.columns)


def freshness(scan: DataFrame, stored: DataFrame, by: str = "last_modified") -> DataFrame:
    """``path, status`` of every path in either: new, changed, same or gone.

    By ``last_modified`` a path is the same unless the scan is newer; by ``file_hash`` if the
    hashes agree, whatever their case.
    """
    a = scan.select("path", F.col(by).alias("_now"), F.lit(True).alias("_here"))
    b = stored.select("path", F.col(by).alias("_then"), F.lit(True).alias("_known"))
    same = F.col("_then") >= F.col("_now") if by == "last_modified" else F.lower("_then") == F.lower("_now")
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_here").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def latest(scans: DataFrame, key: str = "path", order: Sequence[str] = ("seen_at", "scan_id")) -> DataFrame:
    """The newest row per key."""
    cols = [c for c in scans.columns if c != key]
    return scans.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def stale(stored: DataFrame, scan: DataFrame, prefix: str = "") -> DataFrame:
    """Stored rows under a prefix whose path the scan doesn't have."""
    under = stored.where(F.startswith("path", F.lit(prefix))) if prefix else stored
    return under.join(scan.select("path").distinct(), "path", "left_anti")


def resolve_parents(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """``extracted(file_id, idx, parent_idx, name, kind, line_start ...)`` with the stored id of each row's parent.

    A parent that lost against an earlier row of its key is found by that key.
    """
    key = ["file_id", "name", "kind", "line_start"]
    ids = extracted.select("idx", *key).join(stored.select("symbol_id", *key), key).select("file_id", F.col("idx").alias("parent_idx"), F.col("symbol_id").alias("parent_symbol_id"))
    return extracted.join(ids, ["file_id", "parent_idx"], "left")


def numbered(rows: DataFrame, group: str, order: Sequence[str], start: int = 0, name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1 + start)
