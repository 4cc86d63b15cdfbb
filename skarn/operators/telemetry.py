"""Service telemetry: request counts, cumulative latency histograms, rates, quantiles, requests in flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def requests_total(requests: DataFrame) -> DataFrame:
    return requests.groupBy("path", "status").agg(F.count("*").alias("requests"))


def latency_histogram(requests: DataFrame, bounds: tuple[float, ...] = BOUNDS, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, le, cumulative, sum_seconds, n): one pass with a conditional count for each bound, then a row for each."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = requests.groupBy(*by).agg(*counts, F.count("seconds").alias("n"), F.round(F.sum("seconds"), 6).alias("sum_seconds"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("cumulative")))
    return wide.select(*by, F.explode(rows).alias("r"), "sum_seconds", "n").select(*by, "r.le", "r.cumulative", "sum_seconds", "n")


def request_rate(requests: DataFrame, window: str = "1 minute", seconds: int = 60, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Requests a second in tumbling windows."""
    w = requests.groupBy(F.window("ts", window).alias("w"), *by).agg(F.count("*").alias("requests"))
    return w.select(F.col("w.start").alias("window_start"), *by, "requests", F.round(F.col("requests") / seconds, 6).alias("rate"))


def bucket_quantile(histogram: DataFrame, q: float, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """The quantile by linear interpolation inside the bucket that holds it; in the last bucket the highest finite bound."""
    order = Window.partitionBy(*by).orderBy("le")
    h = histogram.withColumns({"below": F.coalesce(F.lag("cumulative").over(order), F.lit(0)), "low": F.coalesce(F.lag("le").over(order), F.lit(0.0))})
    rank = F.lit(q) * F.col("n")
    inside = h.where((F.col("cumulative") >= rank) & (F.col("below") < rank))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / (F.col("cumulative") - F.col("below")))
    return inside.select(*by, F.round(value, 6).alias("quantile"))


def in_flight(requests: DataFrame, bucket: str = "hour") -> DataFrame:
    """(bucket_start, started, ended, in_flight, highest): requests under way at the end of each time bucket and the most at once in it.

    Starts and ends are +1 and -1; each bucket is summed by itself, and only the bucket totals run over the whole time.
    """
    end = F.col("ts") + F.make_dt_interval(secs=F.col("seconds"))
    steps = requests.where("ts is not null and seconds is not null").select(F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy("s.at").agg(F.sum("s.d").alias("d"), F.count_if(F.col("s.d") > 0).alias("started"), F.count_if(F.col("s.d") < 0).alias("ended")).withColumn("bucket_start", F.date_trunc(bucket, "at"))
    inside = Window.partitionBy("bucket_start").orderBy("at")
    local = steps.withColumn("run", F.sum("d").over(inside))
    totals = local.groupBy("bucket_start").agg(F.sum("d").alias("d"), F.max("run").alias("most"), F.sum("started").alias("started"), F.sum("ended").alias("ended"))
    upto = Window.orderBy("bucket_start")  # one row for each bucket of time
    now = F.sum("d").over(upto)
    return totals.select("bucket_start", "started", "ended", now.alias("in_flight"), (now - F.col("d") + F.col("most")).alias("highest"))


def uptime(requests: DataFrame) -> DataFrame:
    return requests.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))
