"""Questions about code: definitions, references, file structure, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from . import fusion

DEFINITION_POOL, DEFINITION_FALLBACK, TOPIC_POOL, TOPIC_FILES = 20, 5, 50, 15


def with_symbols(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A few hits (``id`` ...) with their symbol and file; the large tables are read for those ids only."""
    few = F.broadcast(hits.withColumnRenamed("id", "symbol_id"))  # at most a retrieval leg or two
    named = symbols.join(few, "symbol_id")
    return named.join(files.select("file_id", F.col("path").alias("file_path")), "file_id")


def hybrid_search(keyword: DataFrame, vector: DataFrame, symbols: DataFrame, files: DataFrame, top_k: int = 10) -> DataFrame:
    hits = fusion.fuse(keyword, vector, top_k, code=True)
    return with_symbols(hits, symbols, files).select(
        "symbol_id", "name", "kind", "file_path", "line_start", "line_end", "parent_symbol_id", "source_text", "score", "confidence", "match_reason", "rrf", "bm25_rank", "vec_rank"
    )


def _best() -> list:
    """Order of fused hits."""
    return [F.desc("rrf"), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last()]


def exact_or_first(hits: DataFrame, name: str, fallback: int = DEFINITION_FALLBACK) -> DataFrame:
    """Hits of exactly this name, or the first few if there are none. ``hits`` is a handful of rows."""
    every = Window.partitionBy()
    marked = hits.withColumn("_exact", F.col("name") == name).withColumn("_any", F.max("_exact").over(every)).withColumn("_place", F.row_number().over(every.orderBy(*_best())))
    return marked.where(F.col("_exact") | (~F.col("_any") & (F.col("_place") <= fallback))).drop("_exact", "_any", "_place")


def with_context(found: DataFrame, symbols: DataFrame, doc_files: DataFrame, doc_chunks: DataFrame) -> DataFrame:
    """Adds ``parent struct<name,kind>``, ``docstring`` and ``signature``.

    The docstring is the chunk with the smallest id of the file's docstrings whose lines hold
    the definition's first line.
    """
    parents = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), F.struct("name", "kind").alias("parent"))
    docs = (
        doc_files.where("doc_type = 'docstring'")
        .select("doc_file_id", F.col("path").alias("file_path"))
        .join(doc_chunks.select("doc_file_id", "chunk_id", "content", F.col("line_start").alias("_from"), F.col("line_end").alias("_to")), "doc_file_id")
    )
    keyed = found.join(docs, (found.file_path == docs.file_path) & found.line_start.between(docs["_from"], docs["_to"])).groupBy("symbol_id").agg(F.min_by("content", "chunk_id").alias("docstring"))
    return found.join(parents, "parent_symbol_id", "left").join(keyed, "symbol_id", "left").withColumn("signature", text.signature(F.col("source_text")))


def find_references(name: str, references: DataFrame, files: DataFrame, symbols: DataFrame, file_lines: DataFrame | None = None) -> DataFrame:
    """``file_path, line_number, source_line, containing_symbol, containing_kind`` of a name's references, by path and line.

    The containing symbol is the narrowest whose lines hold the reference (ties by id). Repeated
    references count once; one without a line has neither source line nor container.
    """
    refs = references.where(F.col("symbol_name") == name).select("file_id", "line_number").distinct()
    spans = symbols.select("file_id", "symbol_id", "name", "kind", "line_start", "line_end")
    inside = (
        refs.join(spans, "file_id")
        .where(F.col("line_number").between(F.col("line_start"), F.col("line_end")))
        .groupBy("file_id", "line_number")
        .agg(F.min_by(F.struct("name", "kind"), F.struct((F.col("line_end") - F.col("line_start")).alias("w"), "symbol_id")).alias("c"))
    )
    out = refs.join(inside, ["file_id", "line_number"], "left")
    if file_lines is not None:
        out = out.join(file_lines.select("file_id", "line_number", F.trim("text").alias("source_line")), ["file_id", "line_number"], "left")
    else:
        out = out.withColumn("source_line", F.lit(None).cast("string"))
    return (
        out.join(files.select("file_id", F.col("path").alias("file_path")), "file_id")
        .select("file_path", "line_number", "source_line", F.col("c.name").alias("containing_symbol"), F.col("c.kind").alias("containing_kind"))
        .orderBy("file_path", "line_number")
    )


def file_structure(path: str, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A file's symbols with their parents' names, in order of lines."""
    own = symbols.join(files.where(F.col("path") == path).select("file_id"), "file_id")
    parents = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("parent"))
    return own.join(parents, "parent_symbol_id", "left").select("symbol_id", "name", "kind", "line_start", "line_end", "parent").orderBy("line_start", "symbol_id")


def topic_files(hits: DataFrame, top_k: int = TOPIC_FILES) -> DataFrame:
    """Files by the sum of their hits' scores, with names and kinds that matched and a summary.

    Names come in the order of the hits (at most ten), kinds sorted.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("rrf")).alias("a"), F.coalesce("bm25_rank", F.lit(1 << 30)).alias("b"), F.coalesce("vec_rank", F.lit(1 << 30)).alias("c"), "name")))
    rolled = hits.groupBy("file_path").agg(F.round(F.sum("score"), 4).alias("relevance_score"), ordered.alias("_o"), F.sort_array(F.collect_set("kind")).alias("_k"))
    names = F.transform("_o", lambda x: x["name"])
    kinds = F.array_join("_k", ", ")
    return (
        rolled.select(
            "file_path",
            "relevance_score",
            F.slice(names, 1, 10).alias("matched_symbols"),
            kinds.alias("symbol_kinds"),
            F.concat(F.lit("Contains "), kinds, F.lit(": "), text.named_list(names)).alias("summary"),
        )
        .orderBy(F.desc("relevance_score"), "file_path")
        .limit(top_k)
    )


def top_snippets(hits: DataFrame, per_file: int = 2) -> DataFrame:
    """The best hits of each file with a shortened text."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), *_best(), "symbol_id"))
    rows = hits.where(F.length("source_text") > 0).withColumn("place", place).where(F.col("place") <= per_file)
    return rows.select("file_path", "place", "name", "kind", text.line_range(F.col("line_start"), F.col("line_end")).alias("line_range"), text.truncated_code(F.col("source_text")).alias("code"))
