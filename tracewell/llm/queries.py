"""Driver queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, generated, markup, mih, packing, pairs, rankfuse, residue, splitter

SCORES = [("bm25_score", True), ("vec_distance", True)]


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.extract_pairs(table(spark, d, "symbols"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("symbol_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.label_and_clean(table(spark, d, "doc_chunks")).where("is_markup").select("chunk_id")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.label_and_clean(table(spark, d, "doc_chunks")).select("chunk_id", "is_markup", "clean")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.classify(table(spark, d, "files"), table(spark, d, "symbols")).select("file_id")


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    scores = rankfuse.search_scores(table(spark, d, "symbols_fts"), table(spark, d, "symbol_embeddings"))
    return rankfuse.fuse_rankings(scores, "query_id", "symbol_id", SCORES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rankfuse.heads(_ranking(spark, d), "query_id", "symbol_id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).withColumn("projection", F.round("projection", 6))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = mih.neighbours(table(spark, d, "symbol_embeddings"))
    return near.select(F.col("id").alias("symbol_id"), F.col("other").alias("neighbour_id"), F.round("sim", 6).alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mih.pairs(mih.neighbours(table(spark, d, "symbol_embeddings")))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_oversized(table(spark, d, "doc_chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).where("piece_index = 0").select("chunk_id")


def p7_joined(spark: SparkSession, d: str) -> DataFrame:
    """The texts that pieces give back without their overlaps, and whether every piece keeps the limit."""
    new = F.when(F.col("piece_index") == 0, F.col("piece")).otherwise(F.expr(f"substring(piece, {splitter.OVERLAP + 1})"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("piece_index", new.alias("t")))), lambda x: x["t"])
    return p7_pieces(spark, d).groupBy("chunk_id").agg(F.array_join(parts, "").alias("content"), (F.max(F.length("piece")) <= splitter.MAX_SIZE).alias("fits"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids stand for."""
    return bpe.decode_corpus(p8_ids(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(table(spark, d, "documents")))


def p9_placed(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers, whether all of their tokens are there once, and how many windows are overfull."""
    placed = p9_containers(spark, d)
    over = placed.groupBy("container_id", "window", "tier").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > F.col("tier")).alias("n")).scalar()
    return placed.groupBy("doc_id").agg((F.sum("n_tokens") == F.max(F.col("token_start") + F.col("n_tokens"))).alias("complete")).withColumn("n_overfull", over)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_pairs, p3_found, p3_clean, p4_found, p5_found, p5_ranking, p6_found, p6_neighbours, p7_found, p7_pieces, p7_joined, p8_ids, p8_text, p9_containers, p9_placed, p10_found)}
