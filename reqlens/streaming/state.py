"""Keyed stream state: body cache, login bursts, service states."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BODY_TTL_MS = 300_000
WINDOW_US = 60_000_000
BLOCK_US = 60_000_000
MAX_FAILURES = 5
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Large keyed state lives in RocksDB, outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ---- body cache --------------------------------------------------------------

FILLED = "method string, uri string, us long, seq long, body string"


class BodyCache(StatefulProcessor):
    """Last body of a (method, uri) within five minutes of event time; alerts take it.

    Rows: kind ``body`` stores, kind ``alert`` asks. State is one body and its time per key; an event-time
    timer frees a key five minutes after its last body.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cache = handle.getValueState("cache", "us long, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, body = self.cache.get() if self.cache.exists() else (None, None)
        stored = at
        chunks = list(rows)
        batch = pd.concat(chunks) if len(chunks) > 1 else chunks[0]
        batch = batch.assign(asks=batch["kind"] == "alert").sort_values(["us", "asks", "seq"])
        bodies = []
        for row in batch.itertuples(index=False):
            if row.kind == "body":
                if row.body and (at is None or row.us >= at):
                    at, body = int(row.us), row.body
                continue
            fresh = at is not None and 0 <= row.us - at < BODY_TTL_MS * 1000
            bodies.append((key[0], key[1], row.us, row.seq, body if fresh else None))
        if at != stored:
            self.cache.update((at, body))
            self.handle.registerTimer(at // 1000 + BODY_TTL_MS)
        yield pd.DataFrame(bodies, columns=["method", "uri", "us", "seq", "body"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.cache.exists() and self.cache.get()[0] // 1000 + BODY_TTL_MS <= timerValues.getCurrentWatermarkInMs():
            self.cache.clear()
        yield pd.DataFrame(columns=["method", "uri", "us", "seq", "body"])

    def close(self) -> None:
        pass


def fill_bodies_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """``events`` holds method, uri, ts, us (ts in microseconds), seq, kind and body."""
    return events.withWatermark("ts", lateness).groupBy("method", "uri").transformWithStateInPandas(
        statefulProcessor=BodyCache(), outputStructType=FILLED, outputMode="Append", timeMode="EventTime"
    )


# ---- login bursts ------------------------------------------------------------

LOGINS = "client_ip string, email string, ts timestamp, status int"
LOGIN_RESULT = "key string, us long, seq long, status int, blocked boolean, failures int"


def login_key(ip: Column, email: Column) -> Column:
    """ip, or ip:email when an email was sent."""
    name = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    return F.when(name == "", ip).otherwise(F.concat(ip, F.lit(":"), name))


@dataclass
class Limiter:
    """Failures of one key: a window anchored at the first attempt, and the block it may earn."""

    count: int = 0
    start: int | None = None
    until: int = -1

    def step(self, us: int, status: int, limit: int) -> bool:
        """Take one attempt; True when it is refused."""
        if us < self.until:
            return True
        if self.start is None or us - self.start >= WINDOW_US:
            self.start, self.count = us, 0
        if status == 401:
            self.count += 1
            if self.count >= limit:
                self.until = us + BLOCK_US
        elif 200 <= status < 300:
            self.count, self.start = 0, us
        return False


class LoginBursts(StatefulProcessor):
    def __init__(self, limit: int = MAX_FAILURES):
        self.limit = limit if limit > 0 else MAX_FAILURES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "count int, start long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        batch = (pd.concat(chunks) if len(chunks) > 1 else chunks[0]).sort_values(["us", "seq"])
        state = Limiter(*self.bucket.get()) if self.bucket.exists() else Limiter()
        out = []
        for row in batch.itertuples(index=False):
            refused = state.step(int(row.us), int(row.status), self.limit)
            out.append((key[0], row.us, row.seq, row.status, refused, state.count))
        self.bucket.update((state.count, state.start, state.until))
        yield pd.DataFrame(out, columns=["key", "us", "seq", "status", "blocked", "failures"])

    def close(self) -> None:
        pass


def login_bursts_stream(attempts: DataFrame, limit: int = MAX_FAILURES) -> DataFrame:
    """Attempts (key, us, seq, status) with the limiter's verdict; the status of a refused attempt is not seen."""
    return attempts.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LoginBursts(limit), outputStructType=LOGIN_RESULT, outputMode="Append", timeMode="None"
    )


# ---- service states -----------------------------------------------------------


def service_state(action: Column) -> Column:
    """State an action stands for; null when it says nothing about health."""
    a = F.lower(action)
    down = a.isin("die", "kill", "stop") | a.startswith("health_status: unhealthy")
    starting = a.isin("restart", "start") | a.startswith("health_status: starting")
    return (
        F.when(down, "down").when(starting, "restarting").when(a.startswith("health_status: healthy"), "ok")
    )


def latest_service_state(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Last known state per service; a restarting service shows as degraded. Works on tables and streams."""
    known = events.withColumn("_state", service_state(F.col("action"))).where(F.col("_state").isNotNull())
    last = known.groupBy("service").agg(
        F.max_by(F.struct("_state", "action", "ts"), F.struct("ts", seq)).alias("_l")
    )
    state = F.col("_l._state")
    return last.select(
        "service", state.alias("status"), F.when(state == "restarting", "degraded").otherwise(state).alias("shown"),
        F.col("_l.action").alias("source"), F.col("_l.ts").alias("updated_at"),
    )
