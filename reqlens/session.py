"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "reqlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; the cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: all event times are read and written in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = os.path.join(tempfile.gettempdir(), "reqlens-shared")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused, so reruns cannot collide."""
    return f"{shared_dir(spark)}/reqlens/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike an executor-local checkpoint the copy survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_a_task: int = 25_000) -> DataFrame:
    """Deal rows out for CPU-heavy row work: a task gets ``rows_a_task`` rows at most, and every core has a task.

    Partitions of a scan say nothing of its work: a row group is never divided, so all rows of a file may be in one
    of them and the others empty. Rows are counted first, from the footers where ``df`` is a scan.
    """
    tasks = -(-df.count() // rows_a_task)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks))


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice.

    The optimiser moves a filter below the projection that made its columns and repeats their expressions
    there; for a parsed JSON record or a scan of many patterns that doubles the work and multiplies the size
    of the plan. A projection with a partition id is not crossed, so the finished columns are tested.
    """
    return (
        df.withColumn("_once", F.spark_partition_id())
        .where(condition & (F.col("_once") >= 0))
        .drop("_once")
    )
