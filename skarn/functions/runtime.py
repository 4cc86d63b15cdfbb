"""Session plumbing shared by the operators: lineage cuts, shipping the package, table reading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skarn-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and read it from there afterwards."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Like cut, for tables of many small rows: compressed files below the shared checkpoint folder, read by column."""
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_skarn_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="skarn-ship-"), "skarn_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._skarn_shipped = True


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """df.mapInArrow for a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of files that gives fewer tasks than there are cores is dealt out over all cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: A key with more rows than this, and than a HOT_SHARE of all, is joined by broadcast: fewer than HOT_SHARE keys can have so many.
HOT_ROWS, HOT_SHARE = 1_000, 50_000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """left join right on key, where right has one row for each key with the number of its rows in left (column count), of ``total`` in all. Hot keys are
    taken out of the shuffle: their rows of right, of which there are at most HOT_SHARE whatever the data, are broadcast, so no task holds a hot
    key's rows of left together. left should be cheap to read twice."""
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = cut(right.where(F.col(count) > least)) if total > HOT_ROWS else None
    if hot is None or hot.isEmpty():
        return left.join(right, key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(count) <= least), key)
    return left.join(F.broadcast(hot), key).select(*rest.columns).union(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
