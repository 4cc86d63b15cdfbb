"""Structured Streaming: upserts with change detection, and telemetry windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.ingest import upsert


class UpsertSink:
    """foreachBatch target that keeps a table as Parquet versions under a shared path; a repeated batch overwrites its own version."""

    def __init__(self, path: str, schema: str, key: str = "url", sequence: str = "crawled_at"):
        self.path, self.schema, self.key, self.sequence = path, schema, key, sequence

    def _versions(self, spark) -> list[int]:
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def current(self, spark, before: int | None = None) -> DataFrame:
        have = [v for v in self._versions(spark) if before is None or v < before]
        return spark.read.schema(self.schema).parquet(f"{self.path}/v{have[-1]}") if have else spark.createDataFrame([], self.schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = Window.partitionBy(self.key).orderBy(F.desc(self.sequence))
        one = batch.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        upsert(one, self.current(spark, batch_id), self.key).write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")


def run_upserts(stream: DataFrame, sink: UpsertSink, checkpoint: str) -> None:
    """Everything that is there, once; run again for what has come since."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def request_rate_stream(requests: DataFrame, window: str = "1 minute", seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Streaming form of the request rate: windows are final once the watermark has passed."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "path").agg(F.count("*").alias("requests"))
    return w.select(F.col("w.start").alias("window_start"), "path", "requests", F.round(F.col("requests") / seconds, 6).alias("rate"))

