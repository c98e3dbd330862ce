"""Incremental ingest as a stream of scan manifests.

The file source can't see changed or deleted files, so each scan writes a small manifest (path,
time, hash, status) and the stream reads manifests; each micro-batch runs the same idempotent
merge. A batch that is replayed after a failure finds its number committed and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..operators.incremental import COMPACT_EVERY, CommitLog

SCHEMA = "path string, last_modified double, file_hash string, status string, scanned_at timestamp, scan_id long"


def write_manifest(scan: DataFrame, stored: DataFrame, folder: str, scan_id: int) -> None:
    """Appends the states of a scan against what is stored, unchanged paths left out; a gone path is a tombstone."""
    states = merge.freshness(scan, stored, "file_hash").where("status <> 'same'")
    rows = states.join(scan.select("path", "last_modified", "file_hash"), "path", "left")
    rows.select("path", "last_modified", "file_hash", "status", F.current_timestamp().alias("scanned_at"), F.lit(scan_id).cast("long").alias("scan_id")).write.mode("append").parquet(folder)


_VERSION = "path string, last_modified double, file_hash string, status string, version long"


class ManifestSink:
    """Merges manifests into versions of a ``path, last_modified, file_hash`` table; the version of a batch is published by one commit.

    A batch adds the newest row of each of its paths, a gone path as a tombstone; every
    ``compact_every`` batches the chain of additions is written anew.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.root, self.log, self.compact_every = spark, root.rstrip("/"), CommitLog(spark, root), compact_every

    def _newest(self, chain: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_VERSION).parquet(*chain) if chain else self.spark.createDataFrame([], _VERSION)
        return merge.latest(rows, "path", ("version",)).where("status <> 'gone'").select("path", "last_modified", "file_hash")

    def table(self) -> DataFrame:
        last = self.log.last()
        return self._newest(last["chain"] if last else [])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        seq = batch_id + 1
        if self.log.has(seq):
            return
        last = self.log.last()
        folder = f"{self.root}/versions/{seq:012d}"
        newest = merge.latest(batch, "path", ("scanned_at", "scan_id"))
        newest.select("path", "last_modified", "file_hash", "status", F.lit(seq).cast("long").alias("version")).write.mode("overwrite").parquet(folder)
        chain = [*(last["chain"] if last else []), folder]
        if len(chain) > self.compact_every:
            whole = f"{self.root}/snapshots/{seq:012d}"
            self._newest(chain).select("*", F.lit("same").alias("status"), F.lit(seq).cast("long").alias("version")).write.mode("overwrite").parquet(whole)
            chain = [whole]
        self.log.commit({"seq": seq, "chain": chain})


def run_available(spark: SparkSession, manifests: str, sink: ManifestSink, checkpoint: str) -> StreamingQuery:
    """Processes all manifests that are there and ends."""
    stream = spark.readStream.schema(SCHEMA).parquet(manifests)
    query = stream.writeStream.foreachBatch(sink.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
