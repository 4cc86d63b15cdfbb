"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.runtime import checkpoint_dir, cut, spread, table
from skarn.llm import chat, decontaminate, html_text, langid, language_model, packing, permutation_index, simhash, toxicity, warc


def fold(of: int) -> Column:
    """crc32 of the doc_id as text (of nothing where it is null), modulo ``of``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", "toxic")
    model = toxicity.fit(docs.where(fold(3) != 1), labels)
    return toxicity.score(docs, model, extra={"held_out": fold(3) == 1})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spread(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.try_to_number(F.replace(F.col(c), F.lit(warc.RECORD_ID), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    back = warc.read_archives(spark, path, with_payload=False)
    back = cut(back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))
    warc.delete(spark, path)
    return back


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(spread(table(spark, sf_dir, "documents")))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages")))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(spread(table(spark, sf_dir, "documents")), fold(10) != 0, extra={"held_out": fold(10) == 0})


def op8_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = langid.fit(docs.where(fold(5) != 0))
    return langid.predict(docs, model, extra={"held_out": fold(5) == 0})


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_html": op6_html,
    "op7_language_model": op7_language_model,
    "op8_permutation": op8_permutation,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
}

ORACLES = {
    "op3_warc": warc.ORACLE,
    "op4_chat": chat.ORACLE,
}
