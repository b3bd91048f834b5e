"""Structured-streaming queries over the events, run until nothing is left and read from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.functions import parse
from reqlens.operators import registry, rules
from reqlens.plans import tables as t
from reqlens.plans.access_queries import TS, TS_SQL
from reqlens.plans.request_queries import ACCESS_EVENTS, _signature_sql, access_lines, audit_lines
from reqlens.session import scratch_path
from reqlens.sources.store import KeyedStore
from reqlens.streaming import alerts, flows, limiter, state

ALERT_FIELDS = (
    "alert_key string, seq bigint, timestamp_raw string, uri string, method string, anomaly_score double, source string, "
    "coraza_flagged boolean, ai_status string, ai_score double, ai_priority string, matched_signatures array<string>"
)


def _store(spark: SparkSession, name: str, key: str, schema: str) -> KeyedStore:
    return KeyedStore(spark, scratch_path(spark, name), key, schema)


def _score(df: DataFrame) -> DataFrame:
    """Stand-in scorer for the stream queries: a fixed function of the firewall score."""
    return df.withColumns(
        {"ai_status": F.lit("enriched"), "ai_score": F.round(F.col("anomaly_score") / (F.col("anomaly_score") + 5), 4),
         "ai_priority": F.when(F.col("anomaly_score") > 10, "P1").otherwise("P2")}
    )


STORED_ALERT = (
    "alert_key string, seq bigint, timestamp_raw string, client_ip string, uri string, method string, body string, body_length bigint, "
    "anomaly_score double, triggered_rules array<string>, source string, coraza_flagged boolean, status string, ai_status string, ai_score double, "
    "ai_confidence double, ai_confidence_interval struct<low:double,high:double>, ai_entropy double, ai_priority string, "
    f"ai_explanation {registry.CONTRIBUTION}, ai_model_version string"
)
#: Weights and means of the two versions the stream query scores with, and their bootstrap offsets.
SCORER_NAMES = ["anomaly_score", "uri_length", "has_body", "total_rule_count"]
SCORERS = {
    "v1": ([0.0731, -0.0213, 0.417, 0.153], [7.3, 9.1, 0.6, 1.7], -1.07, (-0.0312347, 0.0423451)),
    "v2": ([0.1317, 0.0119, -0.211, 0.2791], [7.3, 9.1, 0.6, 1.7], -2.0317, (-0.0712347, 0.0923451)),
}


def _register(models: registry.ModelRegistry, version: str) -> None:
    weights, means, intercept, offsets = SCORERS[version]
    model = registry.LinearScorer(names=SCORER_NAMES, weights=weights, means=means, intercept=intercept)
    assert models.register(model, "fixed", {"weights": weights}, offsets) == version


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit and access lines streamed to stored alerts: parsed, bodies filled, scored by the version in force, upserted.

    Even lines come while v1 is in force, then v2 is registered and the odd lines come; the same scorer loads it.
    """
    store = _store(spark, "alerts", "alert_key", STORED_ALERT)
    bodies = alerts.body_store(spark, scratch_path(spark, "bodies"))
    models = registry.ModelRegistry(spark, scratch_path(spark, "models"))
    scorer = registry.ModelScorer(models)
    for k, version in enumerate(SCORERS):
        _register(models, version)
        events = t.event_stream(spark, sf_dir)
        lines = alerts.log_lines(audit_lines(events).where(F.col("seq") % 2 == k), access_lines(t.event_stream(spark, sf_dir)))
        flows.run_available(alerts.alerts_into_store(lines, store, bodies, scratch_path(spark, "alerts-checkpoint"), scorer))
    out = store.current().drop("alert_key")
    return out.withColumns({
        "triggered_rules": F.array_join("triggered_rules", ","), "ci_low": F.col("ai_confidence_interval.low"), "ci_high": F.col("ai_confidence_interval.high"),
        "ai_explanation": F.array_join(F.transform("ai_explanation", lambda c: F.concat_ws(":", c["name"], c["grp"], c["direction"])), ","),
    }).drop("ai_confidence_interval")


def _by_version(values) -> str:
    return f"CASE seq % 2 WHEN 0 THEN {values('v1')} ELSE {values('v2')} END"


def _margin_sql(version: str) -> str:
    weights, _, intercept, _ = SCORERS[version]
    return f"{intercept}::DOUBLE + " + " + ".join(f"{w}::DOUBLE * {n}" for w, n in zip(weights, SCORER_NAMES, strict=True))


def _parts_sql(version: str) -> str:
    weights, means, _, _ = SCORERS[version]
    groups = ["anomaly_score", "request_structure", "request_structure", "rule"]
    parts = ", ".join(f"{{'n': '{n}', 'g': '{g}', 'v': {w}::DOUBLE * ({n} - {m}::DOUBLE)}}" for n, g, w, m in zip(SCORER_NAMES, groups, weights, means, strict=True))
    return f"[{parts}]"


ALERT_STREAM = f"""WITH {t.ALERTS_SQL}, lines AS ({ACCESS_EVENTS}),
b AS (SELECT method, uri, strptime(timestamp_raw, '%Y-%m-%dT%H:%M:%SZ') AS ts, seq, body FROM lines WHERE body <> ''),
a AS (SELECT seq, timestamp_raw, client_ip, uri, method, body, anomaly_score, date_trunc('second', ts) AS ts,
  list_filter(triggered_rules, lambda r: r NOT LIKE '%7') AS rules FROM alerts WHERE seq % 97 <> 0 AND anomaly_score > 0),
m AS (SELECT a.seq, arg_max(b.body, (b.ts, b.seq)) AS found FROM a JOIN b ON a.method = b.method AND a.uri = b.uri
  AND b.ts <= a.ts AND a.ts < b.ts + INTERVAL 5 MINUTE WHERE a.body = '' GROUP BY 1),
f AS (SELECT a.* EXCLUDE (body, rules), coalesce(found, body) AS body, rules, length(uri)::DOUBLE AS uri_length,
  CASE WHEN coalesce(found, body) <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_body, len(rules)::DOUBLE AS total_rule_count FROM a LEFT JOIN m USING (seq)),
p AS (SELECT *, round(1 / (1 + exp(-({_by_version(_margin_sql)}))), 6) AS p, {_by_version(lambda v: f"{SCORERS[v][3][0]}::DOUBLE")} AS q0,
  {_by_version(lambda v: f"{SCORERS[v][3][1]}::DOUBLE")} AS q1, {_by_version(_parts_sql)} AS parts FROM f),
c AS (SELECT *, round(greatest(0, p + q0), 4) AS ci_low, round(least(1, p + q1), 4) AS ci_high, greatest(1e-12, least(1 - 1e-12, p)) AS q FROM p),
e AS (SELECT *, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS h, round(ci_high - ci_low, 4) AS width FROM c)
SELECT seq, timestamp_raw, client_ip, uri, method, body, strlen(body)::BIGINT AS body_length, anomaly_score, array_to_string(rules, ',') AS triggered_rules,
  'coraza' AS source, true AS coraza_flagged, 'generated' AS status, 'enriched' AS ai_status, p AS ai_score, round((1 - h) * 100, 2) AS ai_confidence,
  ci_low::DOUBLE AS ci_low, ci_high::DOUBLE AS ci_high, h AS ai_entropy, CASE WHEN p >= 0.9 AND width <= 0.15 THEN 'P1' WHEN p <= 0.1 AND width <= 0.15 THEN 'P3' ELSE 'P2' END AS ai_priority,
  array_to_string(list_transform(list_sort(list_transform(parts, lambda x: {{'k': -abs(x.v), 'n': x.n, 'g': x.g, 'v': x.v}})),
    lambda x: x.n || ':' || x.g || ':' || CASE WHEN x.v >= 0 THEN 'positive' ELSE 'negative' END), ',') AS ai_explanation,
  CASE seq % 2 WHEN 0 THEN 'v1' ELSE 'v2' END AS ai_model_version FROM e"""


def miss_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access lines streamed to stored misses: passed by the firewall although a signature matches."""
    store = _store(spark, "misses", "alert_key", ALERT_FIELDS)
    found = flows.misses(access_lines(t.event_stream(spark, sf_dir)), rules.default_signatures())
    flows.run_available(flows.into_store(found, store, scratch_path(spark, "misses-checkpoint"), _score))
    return store.current().select(
        "seq", "timestamp_raw", "uri", "method", "source", F.array_join("matched_signatures", ",").alias("matched_signatures")
    )


MISS_STREAM = f"""WITH base AS ({ACCESS_EVENTS}), texts AS (SELECT *, method || ' ' || uri || ' ' || body || ' h1' AS txt FROM base WHERE passed),
hits AS (SELECT *, array_to_string(list_filter([{', '.join(_signature_sql(r) for r in rules.RULES)}], lambda h: h IS NOT NULL), ',') AS m FROM texts)
SELECT seq, timestamp_raw, uri, method, 'ml_miss_detector' AS source, m AS matched_signatures FROM hits WHERE m <> ''"""


def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream deduplication by key: each pair of consecutive events shares one."""
    rows = t.event_stream(spark, sf_dir).select(
        F.floor(F.col("event_id") / 2).alias("alert_key"), F.col("ts").cast("timestamp").alias("ts")
    )
    return flows.stream_to_table(flows.first_seen(rows), "first-seen").select("alert_key")


FIRST_SEEN_STREAM = "SELECT DISTINCT event_id // 2 AS alert_key FROM events"


def _windows(size: str, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _store(spark, name, "window_start", "window_start timestamp, requests bigint, errors bigint")
        counted = flows.windowed_requests(t.access_of(t.event_stream(spark, sf_dir)), size)
        flows.windows_to_store(counted, store, scratch_path(spark, f"{name}-checkpoint"))
        return store.current(merge_fields=False).withColumn("window_start", F.date_format("window_start", TS))

    query.__doc__ = f"Requests and errors per tumbling window of {size}, kept current in a store."
    return query


def _windows_sql(seconds: int) -> str:
    return f"""WITH {t.ACCESS_SQL} SELECT strftime(make_timestamp((epoch_us(ts) // {seconds}000000) * {seconds}000000), {TS_SQL}) AS window_start,
  count(*) AS requests, count_if(http_status >= 400) AS errors FROM access GROUP BY 1"""


SERVICE_ACTIONS = [
    "start", "die", "health_status: healthy", "exec_create", "restart", "health_status: unhealthy", "stop",
    "HEALTH_STATUS: starting",
]


def _service_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.pmod("user_id", F.lit(25)).alias("service"),
        t._cycle(F.col("event_id") + F.col("user_id"), SERVICE_ACTIONS).alias("action"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
    )


def _shown(states: DataFrame) -> DataFrame:
    return states.select("service", "status", "shown", "source", F.date_format("updated_at", TS).alias("updated_at"))


def service_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state per service, batch form."""
    return _shown(state.latest_service_state(_service_events(t.table(spark, sf_dir, "events"))))


def service_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream in update mode into a store."""
    store = _store(spark, "services", "service", "service bigint, status string, shown string, source string, updated_at timestamp")
    states = state.latest_service_state(_service_events(t.event_stream(spark, sf_dir)))
    flows.run_available(flows.into_store(states, store, scratch_path(spark, "services-checkpoint"), mode="update"))
    return _shown(store.current(merge_fields=False))


_ACTION_SQL = t._cycle_sql("(event_id + user_id)", SERVICE_ACTIONS)
SERVICE_STATES = f"""WITH x AS (SELECT user_id % 25 AS service, lower({_ACTION_SQL}) AS a, {_ACTION_SQL} AS action, ts, event_id FROM events),
s AS (SELECT *, CASE WHEN a IN ('die', 'kill', 'stop') OR starts_with(a, 'health_status: unhealthy') THEN 'down'
  WHEN a IN ('restart', 'start') OR starts_with(a, 'health_status: starting') THEN 'restarting'
  WHEN starts_with(a, 'health_status: healthy') THEN 'ok' END AS st FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) AS rn FROM s WHERE st IS NOT NULL)
SELECT service, st AS status, CASE WHEN st = 'restarting' THEN 'degraded' ELSE st END AS shown, action AS source,
  strftime(ts, {TS_SQL}) AS updated_at FROM r WHERE rn = 1"""


def _body_events(events: DataFrame) -> DataFrame:
    """Body stores (odd events) and alerts that ask (even events) per method and short URI."""
    a = t.access_of(events)
    asks = F.col("seq") % 2 == 0
    return a.select(
        "method", F.concat(F.lit("/u/"), F.pmod("user_id", F.lit(4))).alias("uri"), "ts", F.unix_micros("ts").alias("us"), "seq",
        F.when(asks, "alert").otherwise("body").alias("kind"),
        F.when(~asks, F.concat(F.lit("b-"), F.col("seq"))).alias("body"),
    )


def body_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body cache as keyed stream state with a time to live."""
    state.use_rocksdb(spark)
    filled = state.fill_bodies_stream(_body_events(t.event_stream(spark, sf_dir)))
    return flows.stream_to_table(filled, "bodies").select("seq", "method", "uri", "body")


BODY_CACHE_STREAM = f"""WITH {t.ACCESS_SQL}, x AS (SELECT method, '/u/' || (user_id % 4) AS uri, ts, seq FROM access),
m AS (SELECT a.seq, arg_max('b-' || b.seq, (b.ts, b.seq)) AS body FROM x a JOIN x b ON a.method = b.method AND a.uri = b.uri
  AND b.seq % 2 = 1 AND b.ts <= a.ts AND a.ts < b.ts + INTERVAL 5 MINUTE WHERE a.seq % 2 = 0 GROUP BY 1)
SELECT x.seq, x.method, x.uri, m.body FROM x LEFT JOIN m USING (seq) WHERE x.seq % 2 = 0"""


def _logins(events: DataFrame) -> DataFrame:
    """Attempts derived from events; time runs a thousand times faster so that bursts occur."""
    ip = F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(9)))
    email = F.when(F.pmod("user_id", F.lit(2)) == 0, F.concat(F.lit(" U"), F.pmod("user_id", F.lit(3)), F.lit("@X ")))
    return events.select(
        state.login_key(ip, email).alias("key"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("us"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", 200).otherwise(401).alias("status"),
    )


def login_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login attempts with the limiter's verdict, batch form."""
    return limiter.login_bursts(_logins(t.table(spark, sf_dir, "events")))


def login_burst_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with keyed stream state."""
    state.use_rocksdb(spark)
    return flows.stream_to_table(state.login_bursts_stream(_logins(t.event_stream(spark, sf_dir))), "logins")


LOGIN_BURSTS = f"""WITH RECURSIVE attempts AS (
  SELECT '10.0.0.' || (user_id % 9) || CASE WHEN user_id % 2 = 0 THEN ':u' || (user_id % 3) || '@x' ELSE '' END AS key,
    epoch_us(ts::TIMESTAMP) // 1000 AS us, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 200 ELSE 401 END AS status FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS rn FROM attempts),
s AS (
  SELECT DISTINCT key, 0::BIGINT AS rn, 0::BIGINT AS us, 0::BIGINT AS seq, 0 AS status, FALSE AS blocked, 0 AS failures,
    NULL::BIGINT AS opened, -1::BIGINT AS until FROM a
  UNION ALL
  SELECT key, rn, us, seq, status, refused,
    CASE WHEN refused THEN failures WHEN status = 401 THEN counted + 1 WHEN status = 200 THEN 0 ELSE counted END,
    CASE WHEN refused THEN opened WHEN status = 200 OR fresh THEN us ELSE opened END,
    CASE WHEN NOT refused AND status = 401 AND counted + 1 >= {state.MAX_FAILURES} THEN us + {state.BLOCK_US} ELSE until END
  FROM (
    SELECT a.key, a.rn, a.us, a.seq, a.status, s.failures, s.opened, s.until, a.us < s.until AS refused,
      coalesce(a.us - s.opened >= {state.WINDOW_US}, TRUE) AS fresh,
      CASE WHEN coalesce(a.us - s.opened >= {state.WINDOW_US}, TRUE) THEN 0 ELSE s.failures END AS counted
    FROM s JOIN a ON a.key = s.key AND a.rn = s.rn + 1))
SELECT key, us, seq, status, blocked, failures FROM s WHERE rn > 0"""


def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines that do not parse."""
    bad = flows.quarantined(audit_lines(t.table(spark, sf_dir, "events")))
    return bad.select(F.length("_bad").cast("bigint").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("lines"))


QUARANTINED_LINES = "SELECT 40::BIGINT AS length, count(*) AS lines FROM events WHERE event_id % 97 = 0"


def access_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cache keys the access log fills, with the latest body."""
    b = flows.bodies(access_lines(t.table(spark, sf_dir, "events")))
    latest = b.groupBy("method", "uri").agg(F.max(F.struct("ts", "body")).alias("l"), F.count(F.lit(1)).alias("stores"))
    return latest.select("method", "uri", F.col("l.body").alias("body"), "stores", parse.is_passed(F.lit(200)).alias("live"))


ACCESS_BODIES = f"""WITH base AS ({ACCESS_EVENTS}) SELECT method, uri, arg_max(body, (timestamp_raw, body)) AS body, count(*) AS stores,
  true AS live FROM base WHERE body <> '' GROUP BY ALL"""

QUERIES = {
    "alert_stream": (alert_stream, ALERT_STREAM),
    "miss_stream": (miss_stream, MISS_STREAM),
    "first_seen_stream": (first_seen_stream, FIRST_SEEN_STREAM),
    "tick_stream": (_windows("10 seconds", "ticks"), _windows_sql(10)),
    "minute_stream": (_windows("1 minute", "minutes"), _windows_sql(60)),
    "service_states": (service_states, SERVICE_STATES),
    "service_stream": (service_stream, SERVICE_STATES),
    "body_cache_stream": (body_cache_stream, BODY_CACHE_STREAM),
    "login_bursts": (login_bursts, LOGIN_BURSTS),
    "login_burst_stream": (login_burst_stream, LOGIN_BURSTS),
    "quarantined_lines": (quarantined_lines, QUARANTINED_LINES),
    "access_bodies": (access_bodies, ACCESS_BODIES),
}
