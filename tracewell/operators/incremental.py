"""Processing only new or changed records.

A run takes the records whose content differs from what the last *committed* run knew.
Three rules make that exact under failures:

* the watermark is the sequence in which rows were committed to the source, not a time in the
  rows: a row that arrives late has a number beyond the watermark, so the next run sees it;
* a run's upper bound is fixed when it starts, so rows that arrive while it works belong to
  the next one. Rows seen after the run's own time wait in its commit until a run may take them;
* output, state and watermark become visible together, by one commit file that can be created
  only once. A run that dies leaves files that no commit names, and the next run starts from
  the same lower bound.

``changed_records`` is the plan of any number of runs at once, ``IncrementalJob`` commits them,
``replay`` drives a job through a log of runs.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir

#: Up to so many bounds are compiled into one expression; beyond that they are searched in Arrow batches.
TREE_LIMIT = 128
#: Commits after which a job writes its state anew instead of adding to it.
COMPACT_EVERY = 16
#: The column that numbers the commits of the source.
SEQUENCE = "ingest_seq"


def canonical_path(path: Column) -> Column:
    """``\\`` becomes ``/`` and any number of leading ``./`` goes; null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def _micros(t: datetime) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def interval_of(at: Column, bounds: Sequence[int]) -> Column:
    """1-based number of the first bound (microseconds, ascending) at or after ``at``; null beyond the last.

    The bounds are the commit log of one job: driver metadata whose length is the number of runs.
    """
    micros = F.unix_micros(at)
    if len(bounds) <= TREE_LIMIT:

        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo + 1) if lo < len(bounds) else F.lit(None).cast("int")
            mid = (lo + hi) // 2
            return F.when(micros <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

        return F.when(micros.isNotNull(), tree(0, len(bounds)))
    kept = np.array(bounds, "int64")

    @F.pandas_udf("int")
    def search(values: pd.Series) -> pd.Series:
        found = np.searchsorted(kept, values.fillna(0).to_numpy("int64"), side="left") + 1
        return pd.Series(found, dtype="Int32").where(values.notna().to_numpy() & (found <= len(kept)), None)

    return search(micros)


def states(scans: DataFrame, known: DataFrame, bounds: Sequence[datetime]) -> DataFrame:
    """Of each path its state at each run that saw it: ``run, path, file_hash, previous_hash, at, changed``.

    Arguments and defined results are those of ``changed_records``; ``at`` is the (seen_at,
    scan_id) of the row that gave the state. ``known`` may carry such an ``at``: a row that
    arrives late and is older than what is known then changes nothing.

    One shuffle on ``path``: the newest row per (path, run) is pre-aggregated map-side, so a hot
    path contributes at most one row per task and run, and the window sees at most one row per
    run of a path.
    """
    marks = [_micros(b) for b in bounds]
    if marks != sorted(marks):
        raise ValueError("bounds must ascend: the watermark is monotonic")
    seen = scans.select(
        canonical_path(F.col("path")).alias("path"),
        F.lower("file_hash").alias("file_hash"),
        interval_of(F.col("seen_at"), marks).alias("run"),
        F.struct(F.col("seen_at").cast("timestamp").alias("seen_at"), F.col("scan_id").cast("long").alias("scan_id")).alias("at"),
    ).where("path is not null and file_hash is not null and run is not null")
    start = known.select(
        canonical_path(F.col("path")).alias("path"),
        F.lower("file_hash").alias("file_hash"),
        F.lit(0).alias("run"),
        (F.col("at") if "at" in known.columns else F.struct(F.lit(None).cast("timestamp").alias("seen_at"), F.lit(None).cast("long").alias("scan_id"))).alias("at"),
    ).where("path is not null and file_hash is not null")
    newest = seen.unionByName(start).groupBy("path", "run").agg(F.max(F.struct("at", "file_hash")).alias("s"))
    by_run = Window.partitionBy("path").orderBy("run")
    # A state holds until a newer row comes, in whatever run that is.
    held = newest.withColumn("s", F.max("s").over(by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (
        held.withColumn("previous_hash", F.lag("s.file_hash").over(by_run))
        .where("run > 0")
        .select("run", "path", "s.file_hash", "previous_hash", "s.at", (~F.col("s.file_hash").eqNullSafe(F.col("previous_hash"))).alias("changed"))
    )


def changed_records(scans: DataFrame, known: DataFrame, bounds: Sequence[datetime]) -> DataFrame:
    """Per run (``run``, 1-based position in ``bounds``) the paths whose content is new or changed.

    ``scans(path, file_hash, seen_at, scan_id)`` is what was observed, ``known(path, file_hash)``
    the state before the first run. Returns ``run int, path string, file_hash string,
    previous_hash string`` (previous null: new path).

    Defined results: null hashes, null paths and null ``seen_at`` are passed over; of several
    rows of one path and interval the newest by (seen_at, scan_id) counts; repeated rows change
    nothing; hashes compare without case; rows beyond the last bound make no case; no bounds or
    no scans give no rows; further columns of either input are ignored.
    """
    return states(scans, known, bounds).where("changed").select("run", "path", "file_hash", "previous_hash")


def replay(scans: DataFrame, known: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """What each run of a log that committed had to process: ``run_id, path, file_hash, previous_hash``.

    ``runs(run_id, started_at, status)``: only status ``ok`` committed. The log is read by the
    driver like any commit log; its length is the number of runs, not of records. A job in
    ``root`` (a folder of its own in the shared folder, which goes with the application) catches
    up on all of them in one commit. A table without ``ingest_seq`` is the source's first commit.
    """
    spark = scans.sparkSession
    ok = sorted(
        (r["started_at"], r["run_id"])
        for r in runs.where("status = 'ok' and started_at is not null").select("run_id", F.unix_micros("started_at").alias("started_at")).collect()
    )
    bounds = [datetime.fromtimestamp(0, timezone.utc) + pd.Timedelta(microseconds=m).to_pytimedelta() for m, _ in ok]
    ids = F.array(*[F.lit(i) for _, i in ok]) if ok else F.array().cast("array<int>")
    if SEQUENCE not in scans.columns:
        scans = scans.withColumn(SEQUENCE, F.lit(1).cast("long"))
    job = IncrementalJob(spark, root or f"{checkpoint_dir(spark)}/incremental-{uuid.uuid4().hex}")
    if root is None:
        job.log.delete_on_exit()
    if bounds:
        job.run(scans, known, bounds)
    return job.output().select(F.get(ids, F.col("run") - 1).cast("int").alias("run_id"), "path", "file_hash", "previous_hash")


class CommitLog:
    """Numbered commit files in a folder of any Hadoop file system; a number can be taken only once.

    A commit file is written in full under another name first, and then appears by one atomic
    step that fails if the number is taken: a hard link on a local disk, a rename that refuses
    to overwrite on file systems with atomic renames, a conditional create on others. A store
    that has none of these is refused.
    """

    #: Schemes whose rename is atomic and refuses an existing target.
    RENAMES = ("hdfs", "viewfs", "webhdfs", "swebhdfs", "abfs", "abfss", "ofs", "o3fs")

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("_commits"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def size(self, folder: str) -> int:
        """Bytes under a folder."""
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def delete_on_exit(self) -> None:
        """The folder goes when the application ends."""
        self._fs.deleteOnExit(self._path(""))

    def _names(self) -> list[str]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path("_commits")))
        return sorted(n for n in found if n.endswith(".json") and not n.startswith("."))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"_commits/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        return [self._read(n) for n in self._names()]

    def last(self) -> dict | None:
        """The newest commit; no older file is read."""
        names = self._names()
        return self._read(names[-1]) if names else None

    def has(self, seq: int) -> bool:
        return self._fs.exists(self._path(f"_commits/{seq:012d}.json"))

    @staticmethod
    def _link(draft: str, final: str, content: bytes) -> None:
        try:
            os.link(draft, final)
        except FileExistsError:
            raise
        except OSError:
            # A mount without hard links: created only once all the same, but not in one step with its content.
            with open(final, "xb") as out:
                out.write(content)

    def commit(self, entry: dict) -> None:
        """All or nothing; raises if another run has taken the same number."""
        final = self._path(f"_commits/{entry['seq']:012d}.json")
        content = bytearray(json.dumps(entry).encode())
        scheme = self._fs.getUri().getScheme()
        if scheme != "file" and scheme not in self.RENAMES:
            out = self._fs.createFile(final).overwrite(False).must("fs.option.create.conditional.overwrite", True).build()
            out.write(content)
            out.close()
            return
        draft = self._path(f"_commits/.{entry['seq']:012d}-{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(content)
        out.close()
        try:
            if scheme == "file":
                self._link(draft.toUri().getPath(), final.toUri().getPath(), bytes(content))
            else:
                none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, none)
        except Exception as e:
            raise RuntimeError(f"commit {entry['seq']} was taken by another run") from e
        finally:
            self._fs.delete(draft, False)


_STATE = "run int, path string, file_hash string, previous_hash string, at struct<seen_at: timestamp, scan_id: long>, changed boolean"
_WAITING = "path string, file_hash string, seen_at timestamp, scan_id long"


class IncrementalJob:
    """Exactly-once processing of changed records into ``root``.

    ``run`` reads the last commit's watermark, fixes the upper bound, processes what changed,
    writes to a folder of its own and publishes folder, state and watermark by one commit file.
    What a failed run wrote is never read. ``output`` reads the folders that commits name.

    A commit adds the new states of the paths it saw to a chain of folders; every
    ``compact_every`` commits the chain is written anew, so that a run reads a bounded number of
    folders however long the history is.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.log, self.compact_every = spark, CommitLog(spark, root), compact_every

    def watermark(self) -> tuple[int, int, datetime | None]:
        """Number of the last commit, the source's sequence it reached, and its own time."""
        last = self.log.last()
        return (last["seq"], last["source"], datetime.fromisoformat(last["upper"])) if last else (0, 0, None)

    def _parquet(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def output(self) -> DataFrame:
        """Everything that was committed, with the commit ``_seq``; without a ``process`` these are the changed records."""
        out = [(e["seq"], e["data"], e["plain"]) for e in self.log.entries()]
        plain = [d for _, d, p in out if p]
        made = [d for _, d, p in out if not p]
        if made:
            if plain:
                raise ValueError("some commits were made with a process and some without")
            return self.spark.read.parquet(*made)
        return self._parquet(plain, _STATE + ", _seq int").where("changed").drop("changed", "at")

    def known(self, baseline: DataFrame) -> DataFrame:
        """State after the last commit: baseline, overlaid with the states of the chain."""
        last = self.log.last()
        base = baseline.select(canonical_path(F.col("path")).alias("path"), "file_hash", F.lit(None).cast("struct<seen_at: timestamp, scan_id: long>").alias("at"))
        if not last:
            return base
        newer = self._parquet(last["chain"], _STATE).select("path", "file_hash", "at")
        return base.unionByName(newer).groupBy("path").agg(F.max(F.struct("at", "file_hash")).alias("s")).select("path", "s.file_hash", "s.at")

    def run(self, scans: DataFrame, baseline: DataFrame, uppers: datetime | Sequence[datetime], process: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Process what the source has committed since the last run, up to the time ``uppers``; returns the new commit's number.

        ``scans`` carries ``ingest_seq``, the number under which the source committed a row: it
        only grows, and no row appears later under a number that was visible. Several ``uppers``
        are runs caught up on in one commit. ``process`` gets ``run, path, file_hash,
        previous_hash``; if it raises, nothing is committed.
        """
        uppers = [uppers] if isinstance(uppers, datetime) else list(uppers)
        last = self.log.last() or {"seq": 0, "source": 0, "upper": None, "chain": [], "waiting": []}
        if last["upper"] and _micros(uppers[0]) < _micros(datetime.fromisoformat(last["upper"])):
            raise ValueError("the upper bound lies before the committed one")
        seq = last["seq"] + 1
        # The upper bound is fixed here: what the source commits from now on has a larger number.
        top = scans.agg(F.max(SEQUENCE)).first()[0]
        source = max(last["source"], top or 0)
        fresh = scans.where((F.col(SEQUENCE) > last["source"]) & (F.col(SEQUENCE) <= source)).select(*[c.split(" ")[0] for c in _WAITING.split(", ")])
        if last["waiting"]:
            fresh = fresh.unionByName(self._parquet(last["waiting"], _WAITING))
        folder = f"{self.log.root}/data/{seq:012d}-{uuid.uuid4().hex}"
        numbered = F.lit(seq).cast("int").alias("_seq")
        states(fresh, self.known(baseline), uppers).select("*", numbered).write.parquet(f"{folder}/states")
        fresh.where((F.unix_micros("seen_at") > F.lit(_micros(uppers[-1]))) & F.col("file_hash").isNotNull() & F.col("path").isNotNull()).write.parquet(f"{folder}/waiting")
        data = f"{folder}/states"
        if process:
            data = f"{folder}/output"
            changed = self._parquet([f"{folder}/states"], _STATE).where("changed").select("run", "path", "file_hash", "previous_hash")
            process(changed).withColumn("_seq", numbered).write.parquet(data)
        chain = [*last["chain"], f"{folder}/states"]
        if len(chain) > self.compact_every:
            newest = self._parquet(chain, _STATE).groupBy("path").agg(F.max(F.struct("at", "file_hash")).alias("s"))
            newest.select(F.lit(0).alias("run"), "path", "s.file_hash", F.lit(None).cast("string").alias("previous_hash"), "s.at", F.lit(False).alias("changed")).write.parquet(f"{folder}/snapshot")
            chain = [f"{folder}/snapshot"]
        self.log.commit({"seq": seq, "source": source, "upper": uppers[-1].isoformat(), "data": data, "plain": process is None, "chain": chain, "waiting": [f"{folder}/waiting"]})
        return seq
