"""The index of one source tree: immutable snapshots, published one by one by a commit file.

An indexing run reads the last snapshot and takes only new and changed files. A table to which it
only adds rows gets one more folder; a table that loses rows, or whose folders have become many, is
written anew; a table that nothing touches stays as it is. Readers see either the old or the new
snapshot. Ids are 64-bit hashes of natural keys, so they are the same in every run; a run whose ids
collide with those of other keys is refused.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import IndexingError
from .extract import code as code_extract
from .extract import markdown
from .functions import text
from .operators import docs, fts, merge, vector
from .operators.incremental import CommitLog
from . import logs
from .session import cut
from .sources import tree

# The tables and their columns.
SCHEMAS = {
    "files": "file_id long, path string, last_modified double, file_hash string",
    "symbols": "symbol_id long, name string, kind string, file_id long, line_start int, line_end int, parent_symbol_id long, source_text string",
    "references_": "symbol_name string, file_id long, line_number int",
    "file_lines": "file_id long, line_number int, text string",
    "symbol_embeddings": "symbol_id long, embedding array<float>",
    "doc_files": "doc_file_id long, path string, last_modified double, file_hash string, doc_type string",
    "doc_chunks": "chunk_id long, doc_file_id long, chunk_index int, section_title string, content string, line_start int, line_end int",
    "doc_embeddings": "chunk_id long, embedding array<float>",
    "symbol_postings": "term string, id long, col string, positions array<int>",
    "symbol_lengths": "id long, length int",
    "doc_postings": "term string, id long, col string, positions array<int>",
    "doc_lengths": "id long, length int",
}
#: Folders of one table before it is written anew.
COMPACT_EVERY = 16
SYMBOL_COLS, DOC_COLS = ("name", "source_text"), ("content", "section_title")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, embedder: vector.Embedder | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder = embedder or vector.HashedNgrams()
        self.log = CommitLog(spark, self.root)

    @property
    def model(self) -> dict:
        return {"embedding_model": type(self.embedder).__name__, "embedding_dim": self.embedder.dim}

    def current(self) -> dict | None:
        """The last commit, unless it was made with another embedding model: then the index counts as empty."""
        last = self.log.last()
        return last if last and last["model"] == self.model else None

    def table(self, name: str) -> DataFrame:
        entry = self.current()
        if entry is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*entry["tables"][name])

    def last_commit_time(self) -> dict[str, float | None]:
        """Epoch seconds of the last commit."""
        entry = self.current()
        return {"snapshot": entry["at"] if entry else None}

    def storage(self) -> dict:
        """Size and folders of the current snapshot, and size of everything under the root."""
        entry = self.current()
        folders = [f for t in entry["tables"].values() for f in t] if entry else []
        sizes = self.spark.createDataFrame([(sum(self.log.size(f) for f in folders), self.log.size(self.root))], "current long, total long")
        shown = sizes.select(text.megabytes(F.col("current")).alias("size_mb"), text.megabytes(F.col("total")).alias("total_mb")).first()
        return {"snapshot": entry["seq"] if entry else None, "folders": len(folders), **shown.asDict()}

    def _publish(self, tables: dict[str, tuple[DataFrame, DataFrame, bool]]) -> int:
        """``tables``: name to (what stays of the old rows, new rows, whether old rows go)."""
        last, current = self.log.last(), self.current()
        seq = last["seq"] + 1 if last else 1
        folder = f"{self.root}/snapshots/{seq:012d}-{uuid.uuid4().hex}"
        made: dict[str, list[str]] = {}
        for name, (kept, new, loses) in tables.items():
            chain = current["tables"][name] if current else []
            adds = not new.isEmpty()
            if chain and not loses and not adds:
                made[name] = chain
                continue
            anew = loses or not chain or len(chain) >= COMPACT_EVERY
            out = (kept.unionByName(new) if anew else new).select(*[c.split(" ")[0] for c in SCHEMAS[name].split(", ")])
            if name.endswith("_postings"):
                # Sorted by term, so that a query skips all row groups but its own terms'.
                out = out.repartitionByRange("term").sortWithinPartitions("term", "id")
            out.write.parquet(f"{folder}/{name}.parquet")
            made[name] = [*([] if anew else chain), f"{folder}/{name}.parquet"]
        self.log.commit({"seq": seq, "tables": made, "model": self.model, "at": time.time()})
        return seq

    @staticmethod
    def _refuse_collisions(old: DataFrame, new: DataFrame, id_col: str, key: list[str]) -> None:
        """Two keys under one id would join strangers."""
        both = new.select(id_col, *key).join(old.select(id_col, *[F.col(k).alias(f"_{k}") for k in key]), id_col)
        other = F.lit(False)
        for k in key:
            other = other | ~F.col(k).eqNullSafe(F.col(f"_{k}"))
        within = new.groupBy(id_col).agg(F.countDistinct(F.struct(*key)).alias("n")).where("n > 1")
        if not both.where(other).isEmpty() or not within.isEmpty():
            raise IndexingError(f"two different keys {key} have the same {id_col}")

    def index(self, directory: str, progress: Callable[[int, int, str], None] | None = None) -> dict:
        """Index what is new or changed under a directory, drop what is gone; returns counts."""
        directory, began = os.path.abspath(directory), time.perf_counter()

        def tell(done: int, what: str, files: int = 0, of: int = 0) -> None:
            if progress:
                pace = logs.pace(files, of, time.perf_counter() - began)
                progress(done, 100, f"{what} ({pace})" if pace else what)

        tell(0, "scanning")
        old = {n: self.table(n) for n in SCHEMAS}
        under = directory + "/"

        scan = cut(tree.scan(self.spark, directory))
        known = old["files"].where(F.startswith("path", F.lit(under)))
        state = cut(merge.freshness(scan, known))
        changed = cut(tree.read_text(scan.join(state.where("status in ('new', 'changed')").select("path"), "path")).withColumn("file_id", F.xxhash64("path")))
        drop = cut(old["files"].join(state.where("status in ('changed', 'gone')").select("path"), "path").select("file_id", "path"))
        # The counts are of this run: a scan and its states, bounded by the tree.
        counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
        fresh, seen = counts.get("new", 0) + counts.get("changed", 0), sum(n for s, n in counts.items() if s != "gone")
        self._refuse_collisions(old["files"], changed, "file_id", ["path"])
        tell(20, "extracting", seen - fresh, seen)

        raw = cut(code_extract.extract_all(changed))
        key = ["file_id", "name", "kind", "line_start"]
        every = raw.where("what = 'symbol'").drop("what").withColumn("symbol_id", F.xxhash64(*key))
        parents = merge.resolve_parents(every.drop("symbol_id"), every.select("symbol_id", *key).dropDuplicates(key))
        new_symbols = cut(merge.first_wins(parents.select(*key, "line_end", "parent_symbol_id", "source_text", "idx"), key, ["idx"]).withColumn("symbol_id", F.xxhash64(*key)))
        new_refs = raw.where("what = 'reference'").select(F.col("name").alias("symbol_name"), "file_id", F.col("line_start").alias("line_number")).distinct()
        prompt = F.concat("kind", F.lit(" "), "name", F.lit(": "), F.substring(F.coalesce("source_text", F.lit("")), 1, 1000))
        new_vectors = vector.embed_column(new_symbols.select("symbol_id", prompt.alias("t")), "t", self.embedder, "code2code").select("symbol_id", "embedding")

        self._refuse_collisions(old["symbols"].join(drop, "file_id", "left_anti"), new_symbols, "symbol_id", key)
        tell(50, "embedding", seen, seen)
        loses = not drop.isEmpty()
        gone_symbols = cut(old["symbols"].join(drop, "file_id").select("symbol_id", F.col("symbol_id").alias("id")))
        tables = {
            "files": (merge.delete_by(old["files"], drop, ["file_id"]), changed.select("file_id", "path", "last_modified", "file_hash"), loses),
            "symbols": (merge.delete_by(old["symbols"], drop, ["file_id"]), new_symbols.select(old["symbols"].columns), loses),
            "references_": (merge.delete_by(old["references_"], drop, ["file_id"]), new_refs, loses),
            "file_lines": (merge.delete_by(old["file_lines"], drop, ["file_id"]), tree.lines_of(changed), loses),
            "symbol_embeddings": (merge.delete_by(old["symbol_embeddings"], gone_symbols, ["symbol_id"]), new_vectors, loses),
            "symbol_postings": (merge.delete_by(old["symbol_postings"], gone_symbols, ["id"]), fts.postings(new_symbols, "symbol_id", SYMBOL_COLS), loses),
            "symbol_lengths": (merge.delete_by(old["symbol_lengths"], gone_symbols, ["id"]), fts.lengths(new_symbols, "symbol_id", SYMBOL_COLS), loses),
        }
        doc_tables, doc_counts = self._docs(directory, old, changed, drop, new_symbols)
        tell(80, "publishing", seen, seen)
        seq = self._publish(tables | doc_tables)
        tell(100, "done", seen, seen)
        return {
            "snapshot": seq, "files_indexed": fresh, "files_skipped": counts.get("same", 0), "files_removed": counts.get("gone", 0), "symbols_indexed": new_symbols.count(), "references_indexed": new_refs.count(),
            **doc_counts, "chunks_indexed": doc_tables["doc_chunks"][1].count(), "total_files": self.table("files").count(), "total_doc_files": self.table("doc_files").count(),
        }

    def _docs(self, directory: str, old: dict, changed_code: DataFrame, dropped_code: DataFrame, new_symbols: DataFrame) -> tuple[dict, dict]:
        under = directory + "/"
        texts = cut(tree.read_text(tree.scan(self.spark, directory, docs=True)).withColumn("doc_file_id", F.xxhash64("path")))
        known = old["doc_files"].where(F.startswith("path", F.lit(under)) & (F.col("doc_type") != "docstring"))
        state = cut(merge.freshness(texts, known, "file_hash"))
        changed = texts.join(state.where("status in ('new', 'changed')").select("path"), "path")
        # Docstrings go with the code file they come from.
        drop = cut(known.join(state.where("status in ('changed', 'gone')").select("path"), "path").select("doc_file_id").unionByName(dropped_code.select(F.xxhash64("path").alias("doc_file_id"))))

        chunk_id = F.xxhash64("doc_file_id", "chunk_index").alias("chunk_id")
        from_markdown = markdown.chunk_all(changed)
        defs = new_symbols.where(F.col("kind").isin("function", "method", "class")).join(changed_code.where(F.col("path").rlike(r"\.pyi?$")).select("file_id", "path"), "file_id")
        found = cut(defs.select("path", "name", "line_start", "line_end", code_extract.docstring_column(F.col("source_text")).alias("docstring")).where("docstring is not null"))
        fresh = docs.new_docstrings(found, merge.delete_by(old["doc_files"], drop, ["doc_file_id"]), old["doc_chunks"])
        from_code = fresh.select(F.xxhash64("path").alias("doc_file_id"), "chunk_index", F.col("name").alias("section_title"), F.col("docstring").alias("content"), "line_start", "line_end")
        new_chunks = cut(from_markdown.unionByName(from_code).select(chunk_id, "doc_file_id", "chunk_index", "section_title", "content", "line_start", "line_end"))
        new_files = changed.select("doc_file_id", "path", "last_modified", "file_hash", docs.doc_type(F.col("path")).alias("doc_type")).unionByName(
            changed_code.join(fresh.select("path").distinct(), "path").select(F.xxhash64("path").alias("doc_file_id"), "path", "last_modified", "file_hash", F.lit("docstring").alias("doc_type"))
        )
        prompt = F.concat(F.coalesce("section_title", F.lit("")), F.lit(": "), "content")
        vectors = vector.embed_column(new_chunks.select("chunk_id", prompt.alias("t")), "t", self.embedder, "nl2code").select("chunk_id", "embedding")
        gone = cut(old["doc_chunks"].join(drop, "doc_file_id").select("chunk_id", F.col("chunk_id").alias("id")))
        counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
        loses = not drop.isEmpty()
        return {
            "doc_files": (merge.delete_by(old["doc_files"], drop, ["doc_file_id"]), new_files, loses),
            "doc_chunks": (merge.delete_by(old["doc_chunks"], drop, ["doc_file_id"]), new_chunks, loses),
            "doc_embeddings": (merge.delete_by(old["doc_embeddings"], gone, ["chunk_id"]), vectors, loses),
            "doc_postings": (merge.delete_by(old["doc_postings"], gone, ["id"]), fts.postings(new_chunks, "chunk_id", DOC_COLS), loses),
            "doc_lengths": (merge.delete_by(old["doc_lengths"], gone, ["id"]), fts.lengths(new_chunks, "chunk_id", DOC_COLS), loses),
        }, {"doc_files_indexed": counts.get("new", 0) + counts.get("changed", 0), "doc_files_skipped": counts.get("same", 0), "doc_files_removed": counts.get("gone", 0)}
