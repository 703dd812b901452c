"""Session helpers that every layer shares: shipping the package to executors, scaled
parallelism, and cutting lineage in a folder that all machines see."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="codelode-")  # on the driver; Spark's file server deals it out
    target = os.path.join(folder, "codelode_pkg.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = target


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one under the temporary folder is set only
    where nothing names one and driver and executors are one machine, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codelode-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, work isn't repeated,
    and a lost executor loses nothing. With `placed`, later joins and aggregates know by which
    columns its rows are dealt out and don't deal them again: an adaptive plan forgets that."""
    spark = df.sparkSession
    shared_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    if placed:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    del df
    gc.collect()  # then plans that only led here are free
    spark.sparkContext._jvm.System.gc()  # and Spark drops their shuffle files
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with `name`: each row's place, from 0 on, in the order of the columns. Rows are dealt
    out by range and ranked within their part; parts' sizes, one row each, give the rest."""
    parts = cut(df.repartitionByRange(shuffle_width(df.sparkSession), *columns).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*columns)) - 1
    return parts.withColumn("_rank", rank).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_rank")).drop("_part", "_base", "_rank")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
