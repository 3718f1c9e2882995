"""Queries of the training-text operators and the SQL that some of them can be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import boilerplate, encode, history, leaks, lookalike, pieces, residue
from weftline.session import table, through_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.oversized(table(spark, sf, "md_sections"), table(spark, sf, "chunk_profiles"))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_sections(table(spark, sf, "md_sections"), table(spark, sf, "chunk_profiles"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return history.dedupe_batches(table(spark, sf, "feed_items"))[0]


def p2_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return history.dedupe_batches(table(spark, sf, "feed_items"))[1]


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return through_table(boilerplate.article_parts(table(spark, sf, "fetch_results"), table(spark, sf, "sources")), "parts")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.block_hashes(_parts(spark, sf), residue.residue_pages)


def p3_articles(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.articles(_parts(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_pages(_parts(spark, sf))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.remove_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.equal_looking(table(spark, sf, "documents"))


def p8_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", lookalike.canonical(F.col("text")).alias("text"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = lookalike.classes(table(spark, sf, "documents"))
    return c.select("doc_id", F.lower(F.hex("class_id")).alias("class_id"), F.lower(F.hex("text_id")).alias("text_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_accepted, p3_found, p3_articles, p4_found, p6_ids, p7_found, p7_clean, p8_found, p8_canonical, p8_classes)}

SQL = {
    "p1_found": """
        SELECT s.section_id FROM md_sections s JOIN chunk_profiles p ON p.profile = coalesce(s.profile, 'standard')
        WHERE length(s.text) > p.max_chars
    """,
}
