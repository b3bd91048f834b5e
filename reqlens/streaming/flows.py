"""The two log streams, stream deduplication, windowed counts, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from reqlens.functions import parse
from reqlens.operators import joins, metrics, rules, views
from reqlens.session import scratch_path, where_once
from reqlens.sources.store import KeyedStore

LATENESS = "10 minutes"

Scorer = Callable[[DataFrame], DataFrame]


def unscored(df: DataFrame) -> DataFrame:
    """Stand-in scorer: alerts are stored without a score."""
    return df.withColumn("ai_status", F.lit("unavailable"))


def quarantined(lines: DataFrame) -> DataFrame:
    """Audit lines that do not parse."""
    return where_once(parse.parse_audit(lines), F.col("_bad").isNotNull()).select("_bad")


def first_seen(df: DataFrame, ts: str = "ts", key: str = "alert_key", lateness: str = LATENESS) -> DataFrame:
    """Drop repeats of a key that arrive within the lateness bound; state stays bounded."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def misses(lines: DataFrame, signatures: list[rules.Signature]) -> DataFrame:
    """Access lines the firewall let through although a signature matches.

    The status test comes first: it is cheap and the patterns then run on passed requests only.
    """
    parsed = parse.parse_access(lines)
    passed = where_once(parsed, F.col("_bad").isNull() & parse.is_passed(F.col("http_status")))
    hit = where_once(rules.prefilter(passed, signatures), F.size("matched_signatures") > 0)
    return hit.withColumns(
        {"source": F.lit(views.MISS_SOURCE), "triggered_rules": F.col("matched_signatures"),
         "status": F.lit("generated")}
    )


def bodies(lines: DataFrame) -> DataFrame:
    """Bodies the access log holds: method, uri, ts, body."""
    return where_once(parse.parse_access(lines), F.col("body") != "").select("method", "uri", "ts", "body")


def enrich_batch(batch: DataFrame, store: KeyedStore, scorer: Scorer) -> DataFrame:
    """Skip keys stored as enriched, score the rest, mark what was scored. Only buckets of the batch's keys are read."""
    fresh = joins.without_enriched(batch, store.lookup(batch).select("alert_key", "ai_status"))
    return scorer(fresh)


def into_store(
    df: DataFrame, store: KeyedStore, checkpoint: str, scorer: Scorer | None = None, order: str | None = None,
    mode: str = "append",
) -> DataStreamWriter:
    """Writer that upserts every micro-batch once.

    The checkpoint names the writer: a replay of a batch that is stored changes nothing, and another stream into the
    same store has batches of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if store.applied(batch_id, checkpoint):
            return
        batch.persist()
        try:
            rows = enrich_batch(batch, store, scorer) if scorer else batch
            store.upsert(rows, batch_id, order, writer=checkpoint)
        finally:
            batch.unpersist()

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_once(writer: DataStreamWriter) -> StreamingQuery:
    """Take all there is in a single batch, then stop; for sources without a plan of their own for what is there."""
    query = writer.trigger(once=True).start()
    query.awaitTermination()
    return query


def stream_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into Parquet and read the result."""
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", out)
    run_available(writer.option("checkpointLocation", checkpoint))
    return spark.read.schema(df.schema).parquet(out)


def windowed_requests(access: DataFrame, size: str, lateness: str = LATENESS) -> DataFrame:
    """Requests and errors per tumbling window of event time."""
    counted = access.withWatermark("ts", lateness).groupBy(F.window("ts", size).alias("w"))
    return counted.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(metrics.is_error(F.col("http_status"))).alias("errors")
    ).select(F.col("w.start").alias("window_start"), "requests", "errors")


def windows_to_store(df: DataFrame, store: KeyedStore, checkpoint: str) -> StreamingQuery:
    """Keep the latest count of every window, open windows included."""
    return run_available(into_store(df, store, checkpoint, mode="update"))


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark, over the recent progress of a query."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"]
    )
