"""The queries of the training-data operators, each with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import email_text, knn, leakage, mixing, mojibake, names, personal, splitting
from loregraph.session import table


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every page of type person or company with the id of its entity."""
    return names.resolve_entities(table(spark, d, "pages").filter(F.col("type").isin("person", "company")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_entity_pairs(p1_entities(spark, d))


def chunk_collection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_chunks").filter(F.col("model") == "embed-v2").select("id", "embedding")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest chunks of every chunk whose id is divisible by 20."""
    return knn.nearest_vectors(chunk_collection(spark, d), "id", "embedding", F.col("id") % 20 == 0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    n = p2_neighbours(spark, d)
    return n.select(F.least("query_id", "neighbour_id").alias("chunk_a"), F.greatest("query_id", "neighbour_id").alias("chunk_b")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized page body and chunk."""
    pages = splitting.split_oversized(table(spark, d, "pages"), "page", "id", "compiled_truth")
    return pages.unionByName(splitting.split_oversized(table(spark, d, "content_chunks"), "chunk", "id", "chunk_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).filter("piece_no = 1").select("item_kind", "item_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document enters the mix."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the mix uses up: every document as often as the cap allows, and still fewer tokens than the target."""
    return p7_shares(spark, d).filter("mixed_docs = src_docs * max_repeats AND mixed_tokens < target_tokens").select("source")


def p3_emails(spark: SparkSession, d: str) -> DataFrame:
    """Every email reduced to the text its sender newly wrote."""
    return email_text.reduce_emails(table(spark, d, "pages").filter(F.col("type") == "email"), "id", "compiled_truth")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_emails(spark, d).select("page_id", F.explode("old_lines").alias("line_no"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled document with its chains and restored text."""
    return mojibake.restore_documents(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the items that leaked into it."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text of pages and chunks that holds personal information, redacted, with what was found."""
    pages = table(spark, d, "pages")
    model = personal.train_surnames(pages)
    a = personal.find_personal(pages, "id", ["compiled_truth", "timeline"], model, "pages")
    return a.unionByName(personal.find_personal(table(spark, d, "content_chunks"), "id", ["chunk_text"], model, "content_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_redacted(spark, d).select("tbl", "row_id", "field", F.explode("found").alias("x")).select("tbl", "row_id", "field", "x.kind", "x.start_pos")


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_neighbours, p3_found, p3_emails, p4_found, p4_pieces, p5_found, p5_redacted, p6_found, p6_leaks, p7_found, p7_mix, p7_shares, p8_found, p8_restored)}
