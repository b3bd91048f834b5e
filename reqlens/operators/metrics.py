"""Request rates, counter deltas, latencies and histograms over access rows and metric samples."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reqlens.functions import timestamps as tm

TICK_SECONDS = 10
LATENCY_SAMPLE = 100
#: Size of the quantile sketches; ranges a column is cut into for exact quantiles, and rows that one task sorts.
SKETCH_K, RANGES, SORTED_ROWS = 800, 64, 100_000
EMPTY_SERIES_MINUTES = 60
RETENTION_MINUTES = 24 * 60
DURATION_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
SERIES_COLUMNS = [
    "timestamp", "requests_delta", "errors_delta", "requests_per_minute", "errors_per_minute", "avg_inference_ms",
    "predictions_per_minute",
]


def is_error(status: Column) -> Column:
    return status >= 400


def minute_buckets(access: DataFrame, ts: str = "ts", status: str = "http_status") -> DataFrame:
    """Requests and errors per minute."""
    return access.groupBy(F.window(ts, "1 minute").alias("_w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(is_error(F.col(status))).alias("errors")
    ).select(F.col("_w.start").alias("minute"), "requests", "errors")


def retained(buckets: DataFrame, now: datetime) -> DataFrame:
    return buckets.where(F.col("minute") >= F.lit(now.replace(second=0, microsecond=0) -
                                                  timedelta(minutes=RETENTION_MINUTES)))


def window_totals(buckets: DataFrame, keyword: str, now: datetime) -> DataFrame:
    """Requests, errors and error rate of the minutes in the window, both ends included."""
    first = (now - timedelta(seconds=tm.window_seconds(keyword))).replace(second=0, microsecond=0)
    last = now.replace(second=0, microsecond=0)
    inside = buckets.where(F.col("minute").between(F.lit(first), F.lit(last)))
    return inside.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("window_requests"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("window_errors"),
        F.coalesce(F.try_divide(F.sum("errors").cast("double"), F.sum("requests")), F.lit(0.0)).alias("error_rate"),
    )


def counter_deltas(samples: DataFrame, source: str, ts: str, counters: list[str], seq: str) -> DataFrame:
    """Per-tick growth of running counters and its per-minute rate.

    The last sample of a source in a tick stands for the tick, so what the window orders is one row per
    tick and source. The first tick, a previous value of zero and a counter reset give 0.
    """
    tick = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts)) / TICK_SECONDS) * TICK_SECONDS)
    at = F.struct(ts, seq)
    ticks = samples.groupBy(source, tick.alias("timestamp")).agg(*[F.max_by(c, at).alias(c) for c in counters])
    w = W.partitionBy(source).orderBy("timestamp")
    out = {}
    for c in counters:
        before = F.lag(c).over(w)
        delta = F.when((before > 0) & (F.col(c) >= before), F.col(c) - before).otherwise(0).cast("bigint")
        out[f"{c}_delta"] = delta
        out[f"{c}_per_minute"] = delta * 60.0 / TICK_SECONDS
    return ticks.withColumns(out)


def metric_series(series: DataFrame, keyword: str, now: datetime) -> DataFrame:
    """Series rows of the window in time order; when there are none, one zero row per minute of the last hour."""
    wanted = series.where(F.col("timestamp") >= F.lit(now - timedelta(seconds=tm.window_seconds(keyword))))
    rows = wanted.select(*[F.col(c) for c in SERIES_COLUMNS]).withColumn("_k", F.lit(1))
    minute = F.lit(now) - F.make_dt_interval(mins=F.col("id").cast("int"))
    zeros = series.sparkSession.range(EMPTY_SERIES_MINUTES).select(
        minute.alias("timestamp"),
        F.lit(0.0).alias("requests_per_minute"),
        F.lit(0.0).alias("errors_per_minute"),
        F.lit(1).alias("_k"),
    )
    anything = wanted.limit(1).select(F.lit(1).alias("_k"))
    filler = zeros.join(anything, "_k", "left_anti")
    return rows.unionByName(filler, allowMissingColumns=True).drop("_k").orderBy("timestamp")


def latency_summary(
    rows: DataFrame, latency: str = "latency_ms", ts: str = "ts", seq: str = "seq", sample: int = LATENCY_SAMPLE
) -> DataFrame:
    """Mean over all rows, percentiles over the newest ``sample`` rows, and the rate per minute."""
    total = rows.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.coalesce(F.round(F.avg(latency), 3), F.lit(0.0)).alias("avg_latency_ms"),
        ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 60e6).alias("_minutes"),
        F.lit(1).alias("_k"),
    )
    recent = rows.orderBy(F.desc(ts), F.desc(seq)).limit(sample).select(F.round(latency, 3).alias("_l"))
    cuts = recent.agg(F.percentile("_l", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("_p"),
                      F.lit(1).alias("_k"))
    named = {
        f"p{n}_latency_ms": F.coalesce(F.round(F.col("_p")[i], 3), F.lit(0.0)) for i, n in enumerate((50, 95, 99))
    }
    rate = F.col("total_predictions") / F.greatest(F.coalesce("_minutes", F.lit(0.0)), F.lit(1.0))
    return total.join(cuts, "_k").withColumns(named).withColumn("predictions_per_minute", rate).drop(
        "_k", "_p", "_minutes"
    )


def latency_sketches(rows: DataFrame, latency: str = "latency_ms", ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """(minute, n, sketch): a mergeable quantile sketch of every minute's latencies, for windows chosen later."""
    minute = F.date_trunc("minute", ts)
    return rows.where(F.col(latency).isNotNull()).groupBy(minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(latency).cast("double"), k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, fractions: list[float], k: int = SKETCH_K) -> DataFrame:
    """(n, quantiles) of all minutes of ``sketches`` together; a quantile's rank is off by 2.3 / k^0.9 of n at most."""
    merged = sketches.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("s"))
    found = F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, fractions)))
    return merged.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, found).alias("quantiles"))


def _value_at(values: DataFrame, rank: int, rows: int) -> float:
    """The value at a 0-based rank of a table (v) with so many rows.

    Sketch quantiles cut the values into even ranges; the range that holds the rank is cut again until it is small
    or holds one value, so no task ever sorts more than SORTED_ROWS rows, whatever the ties.
    """
    while rows > SORTED_ROWS:
        cuts = values.agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("v", SKETCH_K), F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])).alias("c")).first().c
        cuts = sorted(set(cuts))
        # Even numbers are the cuts themselves, odd ones the open ranges between them.
        place = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("v"))) * 2 + F.array_contains(F.lit(cuts), F.col("v")).cast("int")
        placed = values.withColumn("at", place)
        for at, n in sorted((r.at, r.n) for r in placed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()):
            if rank < n:
                break
            rank -= n
        if at % 2:
            return cuts[at // 2]
        values, rows = placed.where(F.col("at") == at).select("v"), n
    return values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(
        "v", F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)).alias("upto")).where(F.col("upto") > rank).agg(F.min("v").alias("v")).first().v


def exact_quantiles(rows: DataFrame, column: str, fractions: list[float]) -> list[float | None]:
    """Interpolated quantiles over all rows that have a value."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = values.count()
    if not n:
        return [None] * len(fractions)
    known: dict[int, float] = {}
    out = []
    for f in fractions:
        low = int(f * (n - 1))
        part = f * (n - 1) - low
        for rank in (low, low + 1) if part else (low,):
            if rank not in known:
                known[rank] = _value_at(values, rank, n)
        out.append(known[low] + part * (known[low + 1] - known[low]) if part else known[low])
    return out


def request_counters(access: DataFrame) -> DataFrame:
    return access.groupBy("method", "endpoint", "http_status").agg(F.count(F.lit(1)).alias("requests"))


def duration_histogram(access: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts per duration bound, with total count and sum."""
    upto = [F.count_if(F.col("duration") <= b).alias(f"le_{b}".replace(".", "_")) for b in DURATION_BOUNDS]
    return access.groupBy(*keys).agg(
        *upto, F.count(F.lit(1)).alias("observations"), F.sum("duration").alias("duration_sum")
    )


def attack_outcomes(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Blocked (403, 400 or no status) and passed attempts."""
    blocked = F.col("http_status").isNull() | F.col("http_status").isin(400, 403)
    return attempts.groupBy(*by).agg(
        F.count_if(blocked).alias("blocked"), F.count_if(~blocked).alias("passed")
    )
