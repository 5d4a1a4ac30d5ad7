"""Queries of the text problems over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.leak import leaked_passages, without_leaks
from strandline.llm.pack import pack_texts
from strandline.llm.subjects import subject_areas
from strandline.sources.tables import table


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The rulings in containers of 2,048 tokens."""
    return pack_texts(table(spark, d, "documents"), "doc_id", "text", 2048)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "docket_no")
    return leaked_passages(docs, table(spark, d, "eval_items"), "doc_id", "text", "item_id", "passage", "docket_no")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which held-out items leaked, into how many rulings, and the longest part."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))


def p8_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the rulings left when the affected ones are removed."""
    return without_leaks(table(spark, d, "documents").select("doc_id", "source"), _leaks(spark, d), "doc_id")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "docket_no")
    return subject_areas(docs, table(spark, d, "subject_examples"), "doc_id", "text", "text", "subject_code", "docket_no")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject_code").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Rulings and sentences about the facts per subject."""
    return _subjects(spark, d).groupBy("subject_code").agg(F.count("*").alias("n_docs"), F.round(F.sum(F.col("share") * F.col("n_facts")), 0).alias("n_sentences"))


QUERIES = {
    "p7_containers": p7_containers, "p8_found": p8_found, "p8_items": p8_items, "p8_clean_corpus": p8_clean_corpus,
    "p9_found": p9_found, "p9_composition": p9_composition,
}
SQL: dict[str, str] = {}
