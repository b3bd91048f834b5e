"""Rates, deltas, latencies, histograms, body fill and replay matching over access rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.operators import joins, metrics
from reqlens.plans import tables as t

NOW = datetime(2024, 1, 30, 23, 50, 0)
TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def minute_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and errors per minute."""
    b = metrics.minute_buckets(t.access(spark, sf_dir))
    return b.withColumn("minute", F.date_format("minute", TS))


MINUTE_RATES = f"""WITH {t.ACCESS_SQL} SELECT strftime(date_trunc('minute', ts), {TS_SQL}) AS minute, count(*) AS requests,
  count_if(http_status >= 400) AS errors FROM access GROUP BY 1"""


def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and error rate of every window keyword."""
    buckets = metrics.retained(metrics.minute_buckets(t.access(spark, sf_dir)), NOW)
    out = None
    for keyword in ("5m", "15m", "30m", "1h", "6h", "24h"):
        one = metrics.window_totals(buckets, keyword, NOW).withColumn("keyword", F.lit(keyword))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("error_rate", F.round("error_rate", 6))


_WINDOWS = ", ".join(f"('{k}', {s})" for k, s in
                     {"5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "6h": 21600, "24h": 86400}.items())
WINDOW_RATES = f"""WITH {t.ACCESS_SQL}, k(keyword, s) AS (VALUES {_WINDOWS}),
j AS (SELECT keyword, http_status FROM k LEFT JOIN access ON date_trunc('minute', ts) BETWEEN
  TIMESTAMP '{NOW}' - to_seconds(s) AND TIMESTAMP '{NOW}')
SELECT keyword, count(http_status) AS window_requests, coalesce(count_if(http_status >= 400), 0) AS window_errors,
  round(coalesce(count_if(http_status >= 400) / nullif(count(http_status), 0), 0), 6)::DOUBLE AS error_rate FROM j GROUP BY keyword"""


def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-tick growth of two counters that wrap around, per source."""
    a = t.access(spark, sf_dir)
    samples = a.select(
        F.pmod("user_id", F.lit(5)).alias("source"), "ts", "seq",
        F.pmod("seq", F.lit(1000)).alias("requests"), F.pmod("seq", F.lit(700)).alias("errors"),
    )
    d = metrics.counter_deltas(samples, "source", "ts", ["requests", "errors"], "seq")
    return d.withColumn("timestamp", F.date_format("timestamp", TS))


COUNTER_DELTAS = f"""WITH {t.ACCESS_SQL}, s AS (SELECT user_id % 5 AS source, (epoch_us(ts) // 10000000) * 10 AS tick,
  arg_max(seq % 1000, (ts, seq)) AS requests, arg_max(seq % 700, (ts, seq)) AS errors FROM access GROUP BY 1, 2),
l AS (SELECT *, lag(requests) OVER w AS pr, lag(errors) OVER w AS pe FROM s WINDOW w AS (PARTITION BY source ORDER BY tick)),
d AS (SELECT *, CASE WHEN pr > 0 AND requests >= pr THEN requests - pr ELSE 0 END AS requests_delta,
  CASE WHEN pe > 0 AND errors >= pe THEN errors - pe ELSE 0 END AS errors_delta FROM l)
SELECT source, strftime(make_timestamp(tick * 1000000), {TS_SQL}) AS timestamp, requests, errors, requests_delta, errors_delta,
  CAST(requests_delta * 6 AS DOUBLE) AS requests_per_minute, CAST(errors_delta * 6 AS DOUBLE) AS errors_per_minute FROM d"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = metrics.minute_buckets(t.access(spark, sf_dir))
    return b.select(
        F.col("minute").alias("timestamp"), F.col("requests").alias("requests_delta"), F.col("errors").alias("errors_delta"),
        F.col("requests").cast("double").alias("requests_per_minute"), F.col("errors").cast("double").alias("errors_per_minute"),
        F.lit(None).cast("double").alias("avg_inference_ms"), F.lit(None).cast("double").alias("predictions_per_minute"),
    )


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of the last six hours in time order."""
    s = metrics.metric_series(_series(spark, sf_dir), "6h", NOW)
    return s.withColumn("timestamp", F.date_format("timestamp", TS))


METRIC_SERIES = f"""WITH {t.ACCESS_SQL}
SELECT strftime(date_trunc('minute', ts), {TS_SQL}) AS timestamp, count(*) AS requests_delta, count_if(http_status >= 400) AS errors_delta,
  CAST(count(*) AS DOUBLE) AS requests_per_minute, CAST(count_if(http_status >= 400) AS DOUBLE) AS errors_per_minute,
  CAST(NULL AS DOUBLE) AS avg_inference_ms, CAST(NULL AS DOUBLE) AS predictions_per_minute
FROM access WHERE date_trunc('minute', ts) >= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR GROUP BY 1"""


def metric_series_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same past the end of the data: one zero row per minute of the last hour."""
    s = metrics.metric_series(_series(spark, sf_dir), "15m", datetime(2030, 1, 1))
    return s.withColumn("timestamp", F.date_format("timestamp", TS))


METRIC_SERIES_EMPTY = f"""WITH n AS (SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2029-12-31 23:45:00')
SELECT strftime(TIMESTAMP '2030-01-01' - to_minutes(CAST(i AS BIGINT)), {TS_SQL}) AS timestamp, CAST(NULL AS BIGINT) AS requests_delta,
  CAST(NULL AS BIGINT) AS errors_delta, 0.0::DOUBLE AS requests_per_minute, 0.0::DOUBLE AS errors_per_minute,
  CAST(NULL AS DOUBLE) AS avg_inference_ms, CAST(NULL AS DOUBLE) AS predictions_per_minute
FROM range(60) r(i), n WHERE n = 0"""


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean latency over all requests, percentiles over the newest hundred, rate per minute."""
    a = t.access(spark, sf_dir).withColumn("latency_ms", F.col("duration") * 1000)
    s = metrics.latency_summary(a)
    return s.withColumn("predictions_per_minute", F.round("predictions_per_minute", 6))


LATENCY_SUMMARY = f"""WITH {t.ACCESS_SQL}, l AS (SELECT round(duration * 1000, 3) AS l FROM access ORDER BY ts DESC, seq DESC LIMIT 100)
SELECT count(*) AS total_predictions, round(avg(duration * 1000), 3) AS avg_latency_ms,
  (SELECT round(quantile_cont(l, 0.5), 3) FROM l) AS p50_latency_ms, (SELECT round(quantile_cont(l, 0.95), 3) FROM l) AS p95_latency_ms,
  (SELECT round(quantile_cont(l, 0.99), 3) FROM l) AS p99_latency_ms,
  round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 1), 6) AS predictions_per_minute FROM access"""


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles over all requests: exact, and whether those of the merged minute sketches are within their bound."""
    a = t.access(spark, sf_dir).withColumn("latency_ms", F.col("duration") * 1000)
    fractions = [0.5, 0.95, 0.99]
    exact = metrics.exact_quantiles(a, "latency_ms", fractions)
    rough = metrics.sketched_quantiles(metrics.latency_sketches(a), fractions)
    bound = 2.3 / metrics.SKETCH_K**0.9
    near = [
        ((F.count_if(F.col("latency_ms") < F.col("quantiles")[i]) / F.first("n") <= f + bound)
         & (F.count_if(F.col("latency_ms") <= F.col("quantiles")[i]) / F.first("n") >= f - bound)).alias(f"p{round(f * 100)}_near")
        for i, f in enumerate(fractions)
    ]
    shown = [F.lit(v).cast("double").alias(f"p{round(f * 100)}_ms") for f, v in zip(fractions, exact, strict=True)]
    return a.join(F.broadcast(rough)).agg(F.count(F.lit(1)).alias("requests"), *near).select("requests", *[F.round(c, 6).alias(f"p{round(f * 100)}_ms") for f, c in zip(fractions, shown, strict=True)], "p50_near", "p95_near", "p99_near")


LATENCY_QUANTILES = f"""WITH {t.ACCESS_SQL} SELECT count(*) AS requests, {', '.join(
    f"round(quantile_cont(duration * 1000, {f}), 6) AS p{round(f * 100)}_ms, true AS p{round(f * 100)}_near" for f in (0.5, 0.95, 0.99))} FROM access"""


def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by method, endpoint and status."""
    return metrics.request_counters(t.access(spark, sf_dir))


REQUEST_COUNTERS = f"""WITH {t.ACCESS_SQL} SELECT method, endpoint, http_status, count(*) AS requests FROM access GROUP BY ALL"""


def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative duration buckets by method and endpoint."""
    h = metrics.duration_histogram(t.access(spark, sf_dir), ["method", "endpoint"])
    return h.withColumn("duration_sum", F.round("duration_sum", 6))


DURATION_HISTOGRAM = f"""WITH {t.ACCESS_SQL} SELECT method, endpoint, {', '.join(
    f"count_if(duration <= {b}) AS le_{str(b).replace('.', '_')}" for b in metrics.DURATION_BOUNDS)},
  count(*) AS observations, round(sum(duration), 6) AS duration_sum FROM access GROUP BY ALL"""


def attack_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked and passed attempts per endpoint; no status counts as blocked."""
    a = t.access(spark, sf_dir).withColumn("http_status", F.when(F.col("seq") % 10 > 0, F.col("http_status")))
    return metrics.attack_outcomes(a, ["endpoint"])


ATTACK_OUTCOMES = f"""WITH {t.ACCESS_SQL}, a AS (SELECT endpoint, CASE WHEN seq % 10 > 0 THEN http_status END AS s FROM access)
SELECT endpoint, count_if(s IS NULL OR s IN (400, 403)) AS blocked, count_if(s IS NOT NULL AND s NOT IN (400, 403)) AS passed
FROM a GROUP BY endpoint"""


# ---- as-of and interval joins ------------------------------------------------------


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access bodies per method and short URI, every third empty."""
    a = t.access(spark, sf_dir)
    body = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat_ws("-", F.lit("b"), F.col("seq")))
    return a.select(
        "method", F.concat(F.lit("/u/"), F.pmod("user_id", F.lit(4))).alias("uri"), "ts", "seq", body.alias("body")
    )


def body_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with an empty body and the body the access log held for them."""
    a = t.alerts(spark, sf_dir).select(
        "alert_key", "method", F.concat(F.lit("/u/"), F.pmod("user_id", F.lit(4))).alias("uri"), "ts", "body",
        F.octet_length("body").alias("body_length"),
    )
    filled = joins.fill_bodies(a, _bodies(spark, sf_dir), "seq")
    return filled.select("alert_key", "uri", "body", F.col("body_length").cast("bigint").alias("body_length"))


BODY_FILL = f"""WITH {t.ALERTS_SQL}, {t.ACCESS_SQL}, b AS (SELECT method, '/u/' || (user_id % 4) AS uri, ts, seq, 'b-' || seq AS body
  FROM access WHERE seq % 3 <> 0),
a AS (SELECT alert_key, method, '/u/' || (user_id % 4) AS uri, ts, body FROM alerts),
m AS (SELECT a.alert_key, arg_max(b.body, (b.ts, b.seq)) AS found FROM a JOIN b ON a.method = b.method AND a.uri = b.uri
  AND b.ts <= a.ts AND a.ts < b.ts + INTERVAL 5 MINUTE WHERE a.body = '' GROUP BY 1)
SELECT alert_key, uri, coalesce(found, body) AS body, CAST(strlen(coalesce(found, body)) AS BIGINT) AS body_length
FROM a LEFT JOIN m USING (alert_key)"""


def replay_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed requests with the first audit entry within five seconds whose URI contains the request path.

    Some paths lack a slash, some entries hold absolute targets, and every tenth entry has no time.
    """
    a = t.alerts(spark, sf_dir)
    lead = F.when(F.col("seq") % 11 == 0, "").otherwise("/")
    sent = a.select(
        "alert_key", F.concat(lead, F.lit("u/"), F.pmod("user_id", F.lit(7)), F.lit("?q="), F.col("user_id")).alias("uri"),
        F.col("ts").alias("sent_at"),
    )
    home = F.when(F.col("seq") % 5 == 0, "http://shop.example").otherwise("")
    timed = F.col("seq") % 10 != 3
    entries = a.select(
        F.concat(home, F.lit("/app/u/"), F.pmod("user_id", F.lit(20)), F.lit("/x?k=/u/"), F.pmod("user_id", F.lit(3))).alias("entry_uri"),
        F.when(timed, F.col("ts") + F.make_dt_interval(secs=F.pmod("seq", F.lit(9)) - 4.5)).alias("entry_ts"),
        F.col("seq").alias("entry_seq"),
    )
    matched = joins.match_replay(sent, entries, "entry_seq", ["entry_seq", "entry_uri"])
    return matched.select("alert_key", "uri", "entry_seq", "entry_uri", F.col("entry_seq").isNotNull().alias("matched"))


REPLAY_MATCH = f"""WITH {t.ALERTS_SQL}, s AS (SELECT alert_key, CASE WHEN seq % 11 = 0 THEN '' ELSE '/' END || 'u/' || (user_id % 7) AS path,
  path || '?q=' || user_id AS uri, ts AS sent_at FROM alerts),
e0 AS (SELECT CASE WHEN seq % 5 = 0 THEN 'http://shop.example' ELSE '' END || '/app/u/' || (user_id % 20) || '/x?k=/u/' || (user_id % 3) AS entry_uri,
  CASE WHEN seq % 10 <> 3 THEN ts + to_milliseconds(CAST((seq % 9) * 1000 - 4500 AS BIGINT)) END AS own_ts, seq AS entry_seq FROM alerts),
e AS (SELECT *, coalesce(last_value(own_ts IGNORE NULLS) OVER (ORDER BY entry_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  min(own_ts) OVER ()) AS entry_ts FROM e0),
m AS (SELECT alert_key, arg_min(entry_uri, e.entry_seq) AS entry_uri, min(e.entry_seq) AS entry_seq
  FROM s JOIN e ON entry_ts BETWEEN sent_at - INTERVAL 5 SECOND AND sent_at + INTERVAL 5 SECOND AND contains(entry_uri, path) GROUP BY 1)
SELECT alert_key, uri, entry_seq, entry_uri, entry_seq IS NOT NULL AS matched FROM s LEFT JOIN m USING (alert_key)"""


def replay_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the replayed requests that an audit entry was found for, as a labelled data set keeps them."""
    return joins.matched_only(replay_match(spark, sf_dir), "entry_seq").drop("matched")


REPLAY_MATCHED = f"SELECT * EXCLUDE (matched) FROM ({REPLAY_MATCH}) WHERE matched"

QUERIES = {
    "minute_rates": (minute_rates, MINUTE_RATES),
    "window_rates": (window_rates, WINDOW_RATES),
    "counter_deltas": (counter_deltas, COUNTER_DELTAS),
    "metric_series": (metric_series, METRIC_SERIES),
    "metric_series_empty": (metric_series_empty, METRIC_SERIES_EMPTY),
    "latency_summary": (latency_summary, LATENCY_SUMMARY),
    "latency_quantiles": (latency_quantiles, LATENCY_QUANTILES),
    "replay_matched": (replay_matched, REPLAY_MATCHED),
    "request_counters": (request_counters, REQUEST_COUNTERS),
    "duration_histogram": (duration_histogram, DURATION_HISTOGRAM),
    "attack_outcomes": (attack_outcomes, ATTACK_OUTCOMES),
    "body_fill": (body_fill, BODY_FILL),
    "replay_match": (replay_match, REPLAY_MATCH),
}
