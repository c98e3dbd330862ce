"""Documentation chunks: retrieval context, docstrings, merging into what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fusion

CONTEXT_LENGTH, MIN_DOCSTRING = 200, 20


def search_documentation(keyword: DataFrame, vector: DataFrame, doc_chunks: DataFrame, doc_files: DataFrame, top_k: int = 10) -> DataFrame:
    hits = F.broadcast(fusion.fuse(keyword, vector, top_k, code=False).withColumnRenamed("id", "chunk_id"))  # at most top_k rows
    return doc_chunks.join(hits, "chunk_id").join(doc_files.select("doc_file_id", F.col("path").alias("source_file"), "doc_type"), "doc_file_id").select(
        "chunk_id", "content", "source_file", "section_title", "line_start", "line_end", "doc_type", "score", "rrf", "bm25_rank", "vec_rank"
    )


def with_neighbours(doc_chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_file_id, chunk_index, previous, following``: the first characters of the chunks just before and after.

    Only direct neighbours by index count. Of chunks stored twice under one index the smallest
    id stands for the index. The neighbours come by an equi-join on (file, index), so a file may
    have any number of chunks.
    """
    kept = doc_chunks.where("doc_file_id is not null and chunk_index is not null")
    one = kept.groupBy("doc_file_id", "chunk_index").agg(F.min_by("content", "chunk_id").alias("_text")).withColumn("_text", F.substring("_text", 1, CONTEXT_LENGTH))
    before = one.select("doc_file_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("_text").alias("previous"))
    after = one.select("doc_file_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("_text").alias("following"))
    key = ["doc_file_id", "chunk_index"]
    return kept.select("chunk_id", *key).join(before, key, "left").join(after, key, "left")


def doc_type(path):
    """``readme`` or ``markdown`` by the file's name."""
    return F.when(F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^readme(\.(md|markdown|txt|rst))?$"), "readme").otherwise("markdown")


def new_docstrings(found: DataFrame, doc_files: DataFrame, doc_chunks: DataFrame) -> DataFrame:
    """Docstrings that aren't stored yet, with the index each gets in its file.

    ``found(path, name, line_start, line_end, docstring)``; one is stored if its file has a
    docstring chunk of that title and first line. Indexes go on from the file's last one, in
    order of (line, name).
    """
    stored = doc_files.where("doc_type = 'docstring'").select("doc_file_id", "path").join(doc_chunks.select("doc_file_id", "chunk_index", "section_title", F.col("line_start").alias("at")), "doc_file_id")
    key = ["path", "name", "line_start"]
    long = found.where(F.length(F.trim("docstring")) >= MIN_DOCSTRING).groupBy(*key).agg(F.min(F.struct("docstring", "line_end")).alias("d")).select(*key, "d.line_end", "d.docstring")
    fresh = long.join(stored.select("path", F.col("section_title").alias("name"), F.col("at").alias("line_start")).distinct(), ["path", "name", "line_start"], "left_anti")
    last = stored.groupBy("path").agg(F.max("chunk_index").alias("last"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line_start", "name"))
    return fresh.join(last, "path", "left").select("path", "name", "line_start", "line_end", "docstring", (F.coalesce("last", F.lit(-1)) + place).alias("chunk_index"))
