"""Audit and access lines as one stream into stored alerts: bodies filled, scored by the model in force, no line lost.

Every batch parses its audit lines, drops keys that are stored as enriched, fills empty bodies, scores, and upserts.
Bodies come from access lines of the same method and URI at most five minutes older: first from those of the batch by
an as-of join, then from a keyed store of the last body of each request, which the batch's access lines update after
its alerts are committed. Both stores take a batch once, so a replay after any failure ends in the same tables. There
is no watermark: late alerts, and alerts whose time cannot be read (they keep their body), are stored like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from reqlens.functions import parse
from reqlens.operators import joins, views
from reqlens.session import where_once
from reqlens.sources.store import KeyedStore
from reqlens.streaming import flows

BODY = "request string, us bigint, seq bigint, body string"
TTL_US = joins.BODY_TTL_SECONDS * joins.MICROS


def body_store(spark: SparkSession, path: str) -> KeyedStore:
    """Last body of each method and URI."""
    return KeyedStore(spark, path, "request", BODY)


def request_of(method: Column, uri: Column) -> Column:
    return F.sha2(F.concat_ws("\n", method, uri), 256)


def log_lines(audit: DataFrame, access: DataFrame) -> DataFrame:
    """(kind, seq, value): both logs as one stream; seq is the order of lines."""
    return audit.select(F.lit("audit").alias("kind"), "seq", "value").unionByName(access.select(F.lit("access").alias("kind"), "seq", "value"))


def parsed_alerts(lines: DataFrame) -> DataFrame:
    """Audit lines to firewall alerts with a positive score, whether or not their time can be read."""
    scored = where_once(parse.parse_audit(lines), F.col("_bad").isNull() & views.is_scored())
    return scored.withColumns({"source": F.lit("coraza"), "coraza_flagged": F.lit(True)}).drop("_bad")


def parsed_bodies(lines: DataFrame) -> DataFrame:
    """(method, uri, ts, seq, body) of access lines that hold a body."""
    return where_once(parse.parse_access(lines), F.col("_bad").isNull() & (F.col("body") != "")).select("method", "uri", "ts", "seq", "body")


def with_bodies(alerts: DataFrame, bodies: DataFrame, stored: KeyedStore) -> DataFrame:
    """Alerts with empty bodies filled from the batch, else from the store."""
    timed = F.col("ts").isNotNull()
    filled = joins.fill_bodies(alerts.where(timed), bodies, "seq").unionByName(alerts.where(~timed))
    empty = (F.col("body") == "") & F.col("ts").isNotNull()
    asks = filled.where(empty).withColumn("request", request_of(F.col("method"), F.col("uri")))
    last = stored.lookup(asks).select("request", F.col("us").alias("_us"), F.col("body").alias("_body"))
    age = F.unix_micros("ts") - F.col("_us")
    found = F.when((age >= 0) & (age < TTL_US), F.col("_body"))
    answered = asks.join(last, "request", "left").withColumn("_found", found).withColumns(
        {"body_length": F.coalesce(F.octet_length("_found"), F.col("body_length")), "body": F.coalesce("_found", "body")})
    return filled.where(~empty).unionByName(answered.select(*filled.columns))


def store_bodies(bodies: DataFrame, stored: KeyedStore, batch: int, writer: str) -> None:
    """The last body of each request; one older than what is stored does not replace it."""
    keyed = bodies.select(request_of(F.col("method"), F.col("uri")).alias("request"), F.unix_micros("ts").alias("us"), "seq", "body")
    last = keyed.groupBy("request").agg(F.max_by(F.struct("us", "seq", "body"), F.struct("us", "seq")).alias("l")).select("request", "l.*")
    have = stored.lookup(last).select("request", F.col("us").alias("_us"))
    newer = last.join(have, "request", "left").where(F.col("_us").isNull() | (F.col("us") >= F.col("_us"))).drop("_us")
    stored.upsert(newer, batch, writer=writer)


def take_batch(lines: DataFrame, batch: int, writer: str, alerts: KeyedStore, bodies: KeyedStore, scorer: flows.Scorer) -> None:
    """One batch of lines into both stores; alerts are committed first, as they read the bodies from before the batch."""
    if alerts.applied(batch, writer) and bodies.applied(batch, writer):
        return
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        """Each step is used several times by the next; a lost block is computed again."""
        kept.append(df.persist())
        return kept[-1]

    try:
        lines = keep(lines)
        held = keep(parsed_bodies(lines.where("kind = 'access'")))
        if not alerts.applied(batch, writer):
            parsed = keep(parsed_alerts(lines.where("kind = 'audit'")))
            fresh = keep(joins.without_enriched(parsed, alerts.lookup(parsed).select("alert_key", "ai_status")))
            alerts.upsert(scorer(keep(with_bodies(fresh, held, bodies))), batch, "seq", writer)
        if not bodies.applied(batch, writer):
            store_bodies(held, bodies, batch, writer)
    finally:
        for df in kept:
            df.unpersist()


def alerts_into_store(lines: DataFrame, alerts: KeyedStore, bodies: KeyedStore, checkpoint: str, scorer: flows.Scorer) -> DataStreamWriter:
    """Writer of a stream of ``log_lines``."""
    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: take_batch(batch, number, checkpoint, alerts, bodies, scorer))
