"""The corpus pipeline: toxicity, language, near duplicates, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. Rows are followed by their place in docs, not by doc_id, so repeated ids do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.runtime import checkpoint_dir, cut, table
from skarn.llm import decontaminate, langid, near_copies, packing, toxicity
from skarn.llm.queries import fold

#: Hits up to this many rows are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 100_000
LEAST_LANGUAGE_SCORE = 0.5


def _whole(docs: DataFrame):
    return {"_doc": F.struct(*(F.col(f"`{c}`") for c in docs.columns))}


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number, and the name of its column, which docs hasn't. docs is read from files, so the numbers are the same every time."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model of the labelled training rows."""
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", "toxic")
    model = toxicity.fit(docs.where(fold(3) != 1), labels)
    return toxicity.score(docs, model, extra=_whole(docs)).where("predicted = 0").select("_doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: neither without letters nor torn between languages."""
    model = langid.fit(docs.where(fold(5) != 0))
    found = langid.predict(docs, model, extra=_whole(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard similarity of 0.8 at least) the document with the smallest doc_id."""
    placed, row = _numbered(docs)
    groups = near_copies.near_copy_groups(placed.select(row, "text"), id_col=row)
    named = placed.select("doc_id", row).join(groups, row)
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", row)).alias("first")).select(f"first.{row}")
    return placed.join(first, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    placed, row = _numbered(docs)
    hits = decontaminate.contaminated(placed.select(row, "text"), table(spark, sf_dir, "benchmark"), id_col=row)
    hits = cut(hits.select(row).distinct())
    small = hits.count() <= BROADCAST_ROWS
    return placed.join(F.broadcast(hits) if small else hits, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: None: the classifiers and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
