"""Questions about a git history: commit search and detail, file history, blame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..validation import commit_hash, line_range

MAX_RESULTS, SCAN_FACTOR = 20, 5


def _shown(commits: DataFrame) -> DataFrame:
    return commits.select("seq", F.substring("full_hash", 1, 7).alias("hash"), "full_hash", text.stripped(F.col("message")).alias("message"), "author", "date")


def search_commits(commits: DataFrame, query: str, max_results: int = MAX_RESULTS, scan_limit: int | None = None) -> DataFrame:
    """Commits whose message holds the query, whatever its case, newest first (``seq`` ascends into the past).

    Only the newest ``scan_limit`` commits are looked at, five times the results by default.
    """
    newest = commits.orderBy("seq").limit(scan_limit or SCAN_FACTOR * max_results)
    return _shown(newest.where(F.contains(F.lower("message"), F.lit(query.lower())))).orderBy("seq").limit(max_results)


def file_history(commits: DataFrame, stats: DataFrame, path: str, max_results: int = MAX_RESULTS) -> DataFrame:
    """The newest commits that touched a path, without following renames."""
    touched = stats.where(F.col("path") == path).select("full_hash").distinct()
    return _shown(commits.join(touched, "full_hash")).orderBy("seq").limit(max_results)


def files_changed(commits: DataFrame, stats: DataFrame) -> DataFrame:
    """Commits with the number of files each changed; 0 for a commit without any."""
    counts = stats.groupBy("full_hash").agg(F.countDistinct("path").alias("files_changed"))
    return _shown(commits).join(counts, "full_hash", "left").withColumn("files_changed", F.coalesce("files_changed", F.lit(0).cast("long")))


def commit_detail(commits: DataFrame, stats: DataFrame, prefix: str, target: str | None = None) -> DataFrame:
    """The files of the commit whose hash starts with the prefix: ``hash, message, path, insertions, deletions``."""
    return detail_of(commits.where(F.startswith("full_hash", F.lit(commit_hash(prefix)))), stats, target)


def detail_of(commits: DataFrame, stats: DataFrame, target: str | None = None) -> DataFrame:
    """The same for the newest of some commits."""
    wanted = commits.orderBy("seq").limit(1)
    files = stats if target is None else stats.where(F.col("path") == target)
    return F.broadcast(_shown(wanted)).join(files, "full_hash", "left").select("hash", "full_hash", "message", "author", "path", "insertions", "deletions").orderBy("path")


def blame_groups(lines: DataFrame, start: int | None = None, end: int | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Runs of adjacent lines of one commit: ``keys, line_start, line_end, hash, n_lines, content``.

    ``lines(keys, line_number, full_hash, line_content)``; the range applies before the
    grouping. A run breaks where the short hash changes or a line number is missing.
    """
    start, end = line_range(start, end)
    rows = lines.where("line_number is not null")
    if start is not None:
        rows = rows.where(F.col("line_number") >= start)
    if end is not None:
        rows = rows.where(F.col("line_number") <= end)
    w = Window.partitionBy(*keys).orderBy("line_number")
    short = F.substring("full_hash", 1, 7)
    broken = (F.lag(short).over(w) != short) | (F.lag("line_number").over(w) != F.col("line_number") - 1)
    runs = rows.withColumn("hash", short).withColumn("_new", F.coalesce(broken, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line_number", "line_content"))), lambda x: x["line_content"])
    return runs.groupBy(*keys, "_run", "hash").agg(F.min("line_number").alias("line_start"), F.max("line_number").alias("line_end"), F.count(F.lit(1)).alias("n_lines"), F.array_join(parts, "\n").alias("content")).drop("_run")
