"""Line-based resources and tables: word lists, tab-separated rows, judgements, and typed readers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "url string, title string, content string, doc_type string, subdomain string, content_hash string, published_at string, crawled_at string, updated_at string, status string"
LINKS = "src string, dst string, anchor string"
FILES = "file_url string, file_type string, page_url string, subdomain string, discovered_at string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines that aren't blank and don't begin with #."""
    return spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))


def tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = F.split("value", "\t", len(names))
    return lines(spark, path).select(*(F.trim(F.try_element_at(parts, F.lit(i + 1))).alias(n) for i, n in enumerate(names))).where(F.col(names[-1]).isNotNull())


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of lines ``qid 0 doc_id rel``; lines with fewer columns or a gain that is no integer are skipped, and of
    repeated judgements the largest line counts."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.size(c) >= 4).select(c[0].alias("qid"), c[2].alias("doc_id"), F.expr(r"try_cast(split(trim(value), '\\s+')[3] AS int)").alias("rel"), F.monotonically_increasing_id().alias("line"))
    return rows.where("rel is not null").groupBy("qid", "doc_id").agg(F.max_by("rel", "line").alias("rel"))


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A table with a declared schema; a missing column or another type fails."""
    df = spark.read.format(format).load(path) if format == "parquet" else spark.read.format(format).schema(schema).load(path)
    want = spark.createDataFrame([], schema).schema
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df.select(*want.names)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order; 0 or less means all."""
    return df.orderBy(*order).limit(n) if n > 0 else df


MOST_CHARACTERS = 2_000_000


def extracted(spark: SparkSession, path: str, extract: Callable[[bytes], str | None], most: int = MOST_CHARACTERS) -> DataFrame:
    """(path, text) of the binary files below path: what extract(bytes) gives, white space collapsed, at most ``most`` characters; an
    error or null gives an empty text."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str:
            try:
                return " ".join((extract(bytes(data or b"")) or "").split())[:most]
            except Exception:  # one broken file is no reason to lose the others
                return ""

        return content.map(one)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", run("content").alias("text"))
