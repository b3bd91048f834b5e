"""Log folders as streams. A rotated file is read once complete; Kafka topics work the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow_folder(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Non-blank lines of the files that appear in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).where(F.trim("value") != "")


def follow_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Lines of a Kafka topic; needs the Kafka connector on the class path."""
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .load()
    )
    return rows.select(F.col("value").cast("string").alias("value")).where(F.trim("value") != "")


def follow_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Parquet files that match a path or pattern."""
    return spark.readStream.schema(schema).format("parquet").load(path)
