"""The tools: indexing, search, history and dead code over one directory; results are plain dicts.

Errors come back in wire form. Results are cut to their top-k, or to a page, before they reach
the driver.
"""

from __future__ import annotations

import functools
import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs
from . import validation as val
from .errors import ValidationError, wire
from .functions import text
from .index_store import IndexStore
from .operators import code, deadcode, docs, fts, history, stats, vector
from .session import cut
from .sources import gitlog

# The modes of the routed tools.
CODE_MODES = ("topic_discovery", "definition", "references", "file_structure")
HISTORY_MODES = ("commits", "commit_detail", "file_history", "blame")
#: Rows of one page of a result that no top-k bounds.
PAGE = 1000
logger = logging.getLogger(__name__)
HINT = "The index is empty: run index_codebase on the directory first."


def _tool(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(*args, **kwargs) -> dict:
        try:
            with logs.timed(f.__name__, logger) as said:
                out = f(*args, **kwargs)
                said |= {k: out[k] for k in ("count", "files_indexed") if k in out}
                return out
        except Exception as e:  # noqa: BLE001 - every failure has a wire form
            return wire(e)

    return run


def _rows(df: DataFrame) -> list[dict]:
    """Of a result that is bounded already."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _page(df: DataFrame, offset: int = 0, limit: int = PAGE) -> tuple[list[dict], bool]:
    """One page of an ordered result, and whether more follows."""
    rows = _rows(df.offset(offset).limit(limit + 1))
    return rows[:limit], len(rows) > limit


class Engine:
    def __init__(self, spark: SparkSession, index_root: str | None = None, embedder: vector.Embedder | None = None, reranker: vector.Reranker | None = None):
        self.spark, self.index_root, self.reranker = spark, index_root, reranker
        self.embedder = embedder or vector.HashedNgrams()
        self.embed_query = vector.QueryEmbedder(self.embedder)

    def store(self, directory: str) -> IndexStore:
        root = val.directory(directory)
        return IndexStore(self.spark, self.index_root or os.path.join(str(root), ".tracewell"), self.embedder)

    @staticmethod
    def _hinted(out: dict, key: str, store: IndexStore) -> dict:
        if not out[key] and store.table("files").isEmpty():
            out["hint"] = HINT
        return out

    # -- legs --------------------------------------------------------------

    def _hybrid(self, store: IndexStore, query: str, top_k: int) -> DataFrame:
        keyword = fts.bm25(store.table("symbol_postings"), store.table("symbol_lengths"), query)
        near = vector.knn(store.table("symbol_embeddings"), "symbol_id", "embedding", self.embed_query(query))
        hits = code.hybrid_search(keyword, near, store.table("symbols"), store.table("files"), top_k)
        return vector.rerank(hits, query, "source_text", self.reranker, top_k, ["rrf"])

    # -- tools -------------------------------------------------------------

    @_tool
    def check_index_status(self, directory: str) -> dict:
        store = self.store(directory)
        counts = {r["table_name"]: r["n"] for r in stats.row_counts({n: store.table(n) for n in ("files", "symbols", "doc_files", "doc_chunks")}).collect()}
        return {"indexed": counts["files"] > 0, **counts} | ({} if counts["files"] else {"hint": HINT})

    @_tool
    def get_index_stats(self, directory: str) -> dict:
        store = self.store(directory)
        names = ("files", "symbols", "references_", "doc_files", "doc_chunks", "symbol_embeddings", "doc_embeddings")
        last = stats.last_indexed(store.table("files"), store.table("doc_files")).select(text.iso_utc(F.col("last_code")).alias("code"), text.iso_utc(F.col("last_docs")).alias("docs")).first()
        return {
            "status": "ok",
            "counts": {r["table_name"]: r["n"] for r in stats.row_counts({n: store.table(n) for n in names}).collect()},
            "symbol_kinds": stats.as_map(stats.kind_histogram(store.table("symbols")), "kind").first()[0],
            "file_extensions": stats.as_map(stats.extension_histogram(store.table("files")), "ext").first()[0],
            "last_indexed": {"code": last["code"], "docs": last["docs"]},
            "freshness": {"age_seconds": {k: None if t is None else round(time.time() - t, 1) for k, t in store.last_commit_time().items()}},
            "embedding": store.model | {"device": vector.choose_device()},
            "storage": store.storage(),
        }

    @_tool
    def index_codebase(self, directory: str, progress: Callable[[int, int, str], None] | None = None) -> dict:
        """``progress(done, of, what)`` is told each phase, with the pace where files are counted."""
        store, root, began = self.store(directory), str(val.directory(directory)), time.perf_counter()
        took = {"warm_up_seconds": round(vector.warm_up(self.embedder), 3)}
        out = store.index(root, progress)
        seconds = time.perf_counter() - began
        files = out["files_indexed"] + out["files_skipped"] + out["doc_files_indexed"] + out["doc_files_skipped"]
        return {"status": "ok", "directory": root, **out, "performance": took | {"total_time_seconds": round(seconds, 2), "files_per_second": round(files / seconds, 1), "total_files_processed": files}}

    @_tool
    def search_code(self, query: str, search_type: str, directory: str, top_k: int | None = None, offset: int = 0) -> dict:
        more, (mode, q, store) = False, (val.one_of(search_type, CODE_MODES), val.query(query), self.store(directory))
        if mode == "definition":
            found = cut(code.exact_or_first(self._hybrid(store, q, code.DEFINITION_POOL), q))
            out = _rows(code.with_context(found, store.table("symbols"), store.table("doc_files"), store.table("doc_chunks")).withColumn("highlights", fts.highlights(q, F.col("source_text"))).drop("rrf", "bm25_rank", "vec_rank"))
        elif mode == "references":
            out, more = _page(code.find_references(q, store.table("references_"), store.table("files"), store.table("symbols"), store.table("file_lines")), offset)
        elif mode == "file_structure":
            path = q if os.path.isabs(q) else os.path.join(str(val.directory(directory)), q)
            out, more = _page(code.file_structure(path, store.table("symbols"), store.table("files")), offset)
        else:
            k = val.top_k(top_k, default=code.TOPIC_FILES)
            hits = self._hybrid(store, q, code.TOPIC_POOL).persist()
            out = _rows(code.topic_files(hits, k))
            snippets: dict[str, list] = {}
            for r in _rows(code.top_snippets(hits).orderBy("file_path", "place")):
                snippets.setdefault(r.pop("file_path"), []).append(r)
            hits.unpersist()
            out = [r | {"top_snippets": snippets.get(r["file_path"], [])} for r in out]
        return self._hinted({"status": "ok", "search_type": mode, "query": q, "results": out, "count": len(out), "more": more}, "results", store)

    @_tool
    def search_docs(self, query: str, directory: str, top_k: int | None = None, include_context: bool = False) -> dict:
        q, k, store = val.query(query), val.top_k(top_k), self.store(directory)
        keyword = fts.bm25(store.table("doc_postings"), store.table("doc_lengths"), q)
        near = vector.knn(store.table("doc_embeddings"), "chunk_id", "embedding", self.embed_query(q))
        found = docs.search_documentation(keyword, near, store.table("doc_chunks"), store.table("doc_files"), k)
        if include_context:
            found = found.join(docs.with_neighbours(store.table("doc_chunks")).select("chunk_id", "previous", "following"), "chunk_id", "left")
        found = found.orderBy(F.desc("rrf"), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last()).drop("rrf", "bm25_rank", "vec_rank")
        out = _rows(vector.rerank(found, q, "content", self.reranker, k, [F.desc("score")]))
        return self._hinted({"status": "ok", "query": q, "results": out, "count": len(out)}, "results", store)

    @_tool
    def search_history(self, query: str, search_type: str, directory: str, target_file: str | None = None, line_start: int | None = None, line_end: int | None = None, max_results: int = history.MAX_RESULTS, offset: int = 0) -> dict:
        extra: dict = {}
        mode = val.one_of(search_type, HISTORY_MODES)
        start, end = val.line_range(line_start, line_end)
        repo = gitlog.find_root(str(val.directory(directory)))
        if mode in ("file_history", "blame") and not target_file:
            raise ValidationError(f"target_file is required for {mode}")
        if mode == "commits":
            out = history.search_commits(gitlog.read(self.spark, "git_log", repo, target_file), val.query(query), max_results)
        elif mode == "commit_detail":
            out = history.commit_detail(gitlog.read(self.spark, "git_log", repo), gitlog.read(self.spark, "git_stat", repo), query, target_file)
            head = gitlog.read(self.spark, "git_log", repo).where(F.startswith("full_hash", F.lit(val.commit_hash(query)))).orderBy("seq").select("full_hash", "author_email", "parents").first()
            if head:
                extra = {"author_email": head["author_email"], "parent_hashes": list(head["parents"]), "diff": gitlog.diff(repo, head["full_hash"], target_file) if target_file else None}
        elif mode == "file_history":
            commits = gitlog.read(self.spark, "git_log", repo, target_file)
            out = history.file_history(commits, commits.select("full_hash", F.lit(target_file).alias("path")), target_file, max_results)
        else:
            groups = history.blame_groups(gitlog.read(self.spark, "git_blame", repo, target_file), start, end)
            commits = gitlog.read(self.spark, "git_log", repo).select(F.substring("full_hash", 1, 7).alias("hash"), "author", "date", text.first_line(F.col("message")).alias("commit_message"))
            out = groups.join(commits, "hash", "left").orderBy("line_start")
        rows, more = _page(out, offset)
        for r in rows:
            if r.get("date") is not None:
                r["date"] = r["date"].isoformat()
        return {"status": "ok", "search_type": mode, "results": rows, "count": len(rows), "more": more} | extra

    @_tool
    def find_dead_code(self, directory: str, min_confidence: float = deadcode.MIN_CONFIDENCE, kinds: list[str] | None = None, include_tests: bool = False, top_k: int | None = None) -> dict:
        store, k = self.store(directory), val.top_k(top_k, *val.DEAD_CODE_TOP_K)
        if not isinstance(min_confidence, (int, float)) or not 0 <= min_confidence <= 1:
            raise ValidationError("min_confidence must lie in 0..1", {"provided": min_confidence})
        wanted = list(dict.fromkeys(deadcode.KINDS if kinds is None else [val.one_of(x, deadcode.KINDS, "kind") for x in kinds]))
        s, f, r = store.table("symbols"), store.table("files"), store.table("references_")
        out = _rows(deadcode.find_dead_code(s, f, r, min_confidence, wanted, include_tests, k, store.table("file_lines")))
        limits = deadcode.limitations(s, f, wanted).first()
        notes = [f"{limits['shared_names']} names are shared by several symbols"] if limits["shared_names"] else []
        if limits["blind_extensions"]:
            notes.append(f"calls by member-access aren't recorded for {', '.join(limits['blind_extensions'])}")
        return self._hinted({"status": "ok", "candidates": out, "count": len(out), "total_symbols": limits["total_symbols"], "limitations": notes}, "candidates", store)
