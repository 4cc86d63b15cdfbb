"""Retrieval metrics over ranked lists and judgements, pooling, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["config", "qid"]


def _dcg(gain: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), gain) - 1) / F.log2(place + 1.0)


def per_query(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(config, qid, p, r, f1, ap, rr, ndcg) of ranked(config, qid, rank, doc_id) against qrels(qid, doc_id, rel); queries
    without a positive judgement are left out; lists are cut at k, and precision divides by k even for short lists."""
    graded = ranked.where(F.col("rank") <= k).join(qrels, ["qid", "doc_id"], "left")
    return of_counts(graded, qrels.groupBy("qid", "rel").agg(F.count("*").alias("n")), k)


def of_counts(graded: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """per_query of lists whose judgements are already joined, graded(config, qid, rank, rel), where counts(qid, rel, n) says how many documents a query has of each."""
    upto = Window.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = counts.where("rel > 0 and n > 0").withColumn("last", F.sum("n").over(upto))
    first = F.col("last") - F.col("n") + 1
    places = F.when(first <= k, F.sequence(first, F.least(F.col("last"), F.lit(k).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    gains = F.aggregate(F.transform(places, lambda p: _dcg(F.col("rel"), p)), F.lit(0.0), lambda s, x: s + x)
    ideal = levels.withColumn("gain", gains).groupBy("qid").agg(F.sum("n").alias("relevant"), F.sum("gain").alias("idcg"))
    lists = graded.where(F.col("rank") <= k).withColumn("rel", F.coalesce("rel", F.lit(0)))
    hit = (F.col("rel") > 0).cast("int")
    running = F.sum(hit).over(Window.partitionBy(*KEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lists.withColumns({"hit": hit, "found": running})
    sums = rows.groupBy(*KEY).agg(
        F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") > 0, F.col("found") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.min(F.when(F.col("hit") > 0, F.col("rank"))).alias("first"), F.sum(_dcg(F.col("rel"), F.col("rank"))).alias("dcg"),
    )
    p, r = F.col("hits") / F.lit(k), F.col("hits") / F.col("relevant")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = {"p": p if k > 0 else F.lit(0.0), "r": r, "f1": ratio(2 * p * r, p + r), "ap": F.col("precisions") / F.col("relevant"), "rr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "ndcg": ratio(F.col("dcg"), F.col("idcg"))}
    return sums.join(ideal, "qid").select(*KEY, *(F.round(v, 6).alias(n) for n, v in out.items()))


def mean(metrics: DataFrame) -> DataFrame:
    """(config, queries, and the means)"""
    return metrics.groupBy("config").agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c not in KEY))


def pool(ranked: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, first_config): the union of the top k of all configurations, each document once."""
    return ranked.where(F.col("rank") <= k).groupBy("qid", "doc_id").agg(F.min("config").alias("first_config"))


def read_labels(rows: DataFrame) -> DataFrame:
    """(status, n) and judgements: rows(qid, doc_id, rel text) with rel 0, 1 or 2 are kept, blank and bad ones counted."""
    rel = F.trim(F.coalesce("rel", F.lit("")))
    return rows.withColumn("status", F.when(rel == "", "blank").when(rel.isin("0", "1", "2"), "ok").otherwise("bad")).withColumn("rel", F.expr("try_cast(trim(rel) AS int)"))


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The nearest-rank percentile of value: the smallest with at least this share of the rows at or below it.
    Values are counted before they are ranked, so repeated ones travel once."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(value)
    ranked = counted.withColumns({"seen": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*by))})
    return ranked.where(F.col("seen") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*by).agg(F.min(value).alias("percentile"), F.max("all").alias("n"))
