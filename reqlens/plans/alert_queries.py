"""Analyst views: filters, pages, statistics, trend, vectors, rule catalog, reviews."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.operators import joins, rules, views
from reqlens.plans import tables as t

# The moment the registered queries look back from (the events cover January 2024).
NOW = datetime(2024, 1, 30, 23, 50, 0)
CURSOR = (datetime(2024, 1, 20, 12, 0, 0), "000000006000")


def _listed(df: DataFrame) -> DataFrame:
    """Page columns as plain values."""
    out = df
    if "triggered_rules" in out.columns:
        out = out.withColumn("triggered_rules", F.array_join("triggered_rules", ","))
    for c in ("ts", "next_ts"):
        if c in out.columns:
            out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return out


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.alerts(spark, sf_dir)


def _listing(a: DataFrame) -> DataFrame:
    """Alert rows with the advisory columns the listings show."""
    return a.withColumns(
        {
            "ai_confidence": F.round(F.col("ai_score") * 100, 2),
            "ai_explanation": F.lit(None).cast("string"),
            "ai_model_version": F.when(F.col("ai_score").isNotNull(), "v1"),
            "ai_entropy": F.lit(None).cast("double"),
            "ai_confidence_interval": F.lit(None).cast("double"),
        }
    )


PAGE_SQL = """ai_status, ai_score, round(ai_score * 100, 2) AS ai_confidence, ai_priority,
  CAST(NULL AS VARCHAR) AS ai_explanation, CASE WHEN ai_score IS NOT NULL THEN 'v1' END AS ai_model_version,
  CAST(NULL AS DOUBLE) AS ai_entropy, CAST(NULL AS DOUBLE) AS ai_confidence_interval"""
TS_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of the log: firewall source, two priorities, score not zero."""
    a = _listing(_alerts(spark, sf_dir))
    return _listed(views.log_page(a, 50, source="coraza", priority="p1, P2", exclude_score_0=True))


LOG_PAGE = f"""WITH {t.ALERTS_SQL}, f AS (SELECT * FROM alerts WHERE source = 'coraza' AND ai_priority IN ('P1', 'P2')
  AND anomaly_score IS DISTINCT FROM 0 ORDER BY ts DESC, alert_key DESC LIMIT 51),
n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, alert_key DESC) AS rn, count(*) OVER () > 50 AS more FROM f)
SELECT strftime(ts, {TS_SQL}) AS ts, alert_key, timestamp_raw, client_ip, uri, anomaly_score,
  array_to_string(triggered_rules, ',') AS triggered_rules, {PAGE_SQL}, source, more AS has_more,
  (SELECT strftime(ts, {TS_SQL}) FROM n WHERE rn = 50 AND more) AS next_ts,
  (SELECT alert_key FROM n WHERE rn = 50 AND more) AS next_alert_key
FROM n WHERE rn <= 50"""


def alert_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert page that continues from a cursor."""
    return _listed(views.alert_page(_listing(_alerts(spark, sf_dir)), 10, CURSOR))


ALERT_PAGE_AFTER = f"""WITH {t.ALERTS_SQL}, f AS (SELECT * FROM alerts WHERE (ts, alert_key) <
    (TIMESTAMP '2024-01-20 12:00:00', '000000006000') ORDER BY ts DESC, alert_key DESC LIMIT 11),
n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, alert_key DESC) AS rn, count(*) OVER () > 10 AS more FROM f)
SELECT strftime(ts, {TS_SQL}) AS ts, alert_key, timestamp_raw, client_ip, uri, anomaly_score,
  array_to_string(triggered_rules, ',') AS triggered_rules, {PAGE_SQL}, more AS has_more,
  (SELECT strftime(ts, {TS_SQL}) FROM n WHERE rn = 10 AND more) AS next_ts,
  (SELECT alert_key FROM n WHERE rn = 10 AND more) AS next_alert_key
FROM n WHERE rn <= 10"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review queue page, oldest first, with the total of the whole queue."""
    a = _alerts(spark, sf_dir).select("ts", "alert_key", "status", "ai_priority", "source", "human_label", "client_ip")
    return _listed(views.review_page(a, 1000, CURSOR, status="reviewed", human_label="true_positive", source="coraza"))


REVIEW_QUEUE = f"""WITH {t.ALERTS_SQL}, q AS (SELECT * FROM alerts WHERE status = 'reviewed' AND human_label = 'true_positive'
  AND source = 'coraza'),
f AS (SELECT * FROM q WHERE (ts, alert_key) > (TIMESTAMP '2024-01-20 12:00:00', '000000006000') ORDER BY ts, alert_key LIMIT 51),
n AS (SELECT *, row_number() OVER (ORDER BY ts, alert_key) AS rn, count(*) OVER () > 50 AS more FROM f)
SELECT strftime(ts, {TS_SQL}) AS ts, alert_key, status, ai_priority, source, human_label, client_ip, more AS has_more,
  (SELECT strftime(ts, {TS_SQL}) FROM n WHERE rn = 50 AND more) AS next_ts,
  (SELECT alert_key FROM n WHERE rn = 50 AND more) AS next_alert_key, (SELECT count(*) FROM q) AS total
FROM n WHERE rn <= 50"""


def newest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 100 alerts."""
    a = views.newest(_alerts(spark, sf_dir), 100, "ts", "alert_key")
    return a.select("alert_key", "timestamp_raw", "client_ip", "uri", "anomaly_score")


NEWEST_ALERTS = f"""WITH {t.ALERTS_SQL} SELECT alert_key, timestamp_raw, client_ip, uri, anomaly_score FROM alerts
ORDER BY ts DESC, alert_key DESC LIMIT 100"""


def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that pass each filter of the views."""
    a = _alerts(spark, sf_dir)
    parts = {
        "scored": views.scored(a),
        "not_zero": views.filter_log(a, exclude_score_0=True),
        "review_default": views.filter_review(a),
        "search": views.search(a, " U/1 ", ["client_ip", "uri", "ai_priority"], ["P1", "P2"]),
        "enriched": a.where(views.is_enriched(F.col("ai_status"), F.col("ai_score"))),
        "sqli_rules": a.where(views.has_rule_prefix(F.col("triggered_rules"), "942")),
        "no_rules": a.where(views.has_no_rules(F.col("triggered_rules"))),
        "last_day": views.since(a, "24h", NOW),
        "matched": a.where(F.col("anomaly_score") >= 5),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("filter"), F.count(F.lit(1)).alias("alerts"), F.sum("seq").alias("seq_sum"))
        out = one if out is None else out.unionByName(one)
    return out


FILTERED_COUNTS = f"""WITH {t.ALERTS_SQL}, x AS (
  SELECT 'scored' AS filter, seq FROM alerts WHERE anomaly_score > 0
  UNION ALL SELECT 'not_zero', seq FROM alerts WHERE anomaly_score IS DISTINCT FROM 0
  UNION ALL SELECT 'review_default', seq FROM alerts WHERE status = 'generated'
  UNION ALL SELECT 'search', seq FROM alerts WHERE contains(lower(concat_ws(' ', client_ip, uri, ai_priority)), 'u/1')
    AND ai_priority IN ('P1', 'P2')
  UNION ALL SELECT 'enriched', seq FROM alerts WHERE ai_status = 'enriched' AND ai_score IS NOT NULL
  UNION ALL SELECT 'sqli_rules', seq FROM alerts WHERE len(list_filter(triggered_rules, lambda r: starts_with(r, '942'))) > 0
  UNION ALL SELECT 'no_rules', seq FROM alerts WHERE len(triggered_rules) = 0
  UNION ALL SELECT 'last_day', seq FROM alerts WHERE ts >= TIMESTAMP '2024-01-29 23:50:00'
  UNION ALL SELECT 'matched', seq FROM alerts WHERE anomaly_score >= 5)
SELECT filter, count(*) AS alerts, CAST(sum(seq) AS BIGINT) AS seq_sum FROM x GROUP BY filter"""


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per validation outcome."""
    a = _alerts(spark, sf_dir)
    method = F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("method"))
    uri = F.when(F.col("seq") % 5 == 0, None).otherwise(F.col("uri"))
    errors = views.validation_errors(method, uri, F.col("anomaly_score") - 1, F.pmod("seq", F.lit(3)) - 1.0)
    return a.groupBy(errors.alias("errors")).agg(F.count(F.lit(1)).alias("requests"))


REQUEST_VALIDATION = f"""WITH {t.ALERTS_SQL}, e AS (SELECT concat_ws('; ',
  CASE WHEN seq % 7 = 0 THEN 'Field ''method'' is required and must be a non-empty string.' END,
  CASE WHEN seq % 5 = 0 THEN 'Field ''uri'' is required and must be a non-empty string.' END,
  CASE WHEN anomaly_score < 1 THEN 'Field ''anomaly_score'' must be >= 0, got -1.0.' END,
  CASE WHEN seq % 3 = 0 THEN 'Field ''inbound_threshold'' must be >= 0, got -1.0.' END) AS errors FROM alerts)
SELECT errors, count(*) AS requests FROM e GROUP BY errors"""


# ---- statistics ----------------------------------------------------------------


def alert_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert statistics in one pass."""
    s = views.alert_statistics(_alerts(spark, sf_dir))
    return s.withColumn("blocked_percentage", F.round("blocked_percentage", 6))


ALERT_STATISTICS = f"""WITH {t.ALERTS_SQL}
SELECT count(*) AS total_alerts, count_if(source IN ('coraza', 'waf_blocked')) AS coraza_count,
  count_if(source = 'ml_miss_detector') AS ml_miss_count, count_if(ai_status = 'enriched') AS ai_enriched_count,
  count_if(anomaly_score >= 5) AS blocked_count, round(count_if(anomaly_score >= 5) * 100.0 / count(*), 6)::DOUBLE AS blocked_percentage,
  arg_max(ai_priority, (ts, alert_key)) AS latest_priority FROM alerts"""


def collector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and the last rule of the newest alert."""
    return views.collector_statistics(_alerts(spark, sf_dir))


COLLECTOR_STATISTICS = f"""WITH {t.ALERTS_SQL}, l AS (SELECT triggered_rules AS r FROM alerts ORDER BY ts DESC, alert_key DESC LIMIT 1)
SELECT (SELECT count(*) FROM alerts) AS total_alerts, coalesce(list_extract(r, -1), '—') AS latest_rule, 'protected' AS status FROM l"""


def dataset_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per attack family."""
    return views.dataset_sources(_alerts(spark, sf_dir)).withColumn("share_pct", F.round("share_pct", 6))


DATASET_SOURCES = f"""WITH {t.ALERTS_SQL}, s(key, name, prefix) AS (VALUES {', '.join(
    f"('{k}', '{n}', '{p}')" for k, n, p in views.DATASET_SOURCES)}),
c AS (SELECT s.key, s.name, count_if(CASE WHEN prefix = '' THEN len(triggered_rules) = 0
  ELSE len(list_filter(triggered_rules, lambda r: starts_with(r, prefix))) > 0 END) AS samples, count(*) AS n
  FROM s CROSS JOIN alerts GROUP BY ALL)
SELECT key, name, samples, round(samples * 100.0 / n, 6)::DOUBLE AS share_pct FROM c"""


def review_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending, reviewed, true and false positives."""
    return views.review_statistics(_alerts(spark, sf_dir))


REVIEW_STATISTICS = f"""WITH {t.ALERTS_SQL}
SELECT count_if(status = 'generated') AS pending, count_if(status = 'reviewed') AS reviewed,
  count_if(status = 'reviewed' AND human_label = 'true_positive') AS true_positive,
  count_if(status = 'reviewed' AND human_label = 'false_positive') AS false_positive FROM alerts"""


def _trend(range_type: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.trend(_alerts(spark, sf_dir), range_type, NOW)

    query.__doc__ = f"Alerts per bucket of the last {range_type}, zero filled."
    return query


def _trend_sql(range_type: str) -> str:
    n, size, _ = views.TREND_RANGES[range_type]
    pattern = {"day": "%H:%M", "week": "%a %H:%M", "month": "%d %b %H:%M"}[range_type]
    return f"""WITH s AS (SELECT (epoch(TIMESTAMP '{NOW}')::BIGINT // {size} - {n - 1}) * {size} AS start),
b AS (SELECT unnest(range({n})) AS bucket),
c AS (SELECT CAST(floor((epoch_us(ts) / 1e6 - start) / {size}) AS BIGINT) AS bucket, count(*) AS n FROM events, s
  WHERE epoch_us(ts) >= start * 1000000 AND ts <= TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE GROUP BY 1)
SELECT b.bucket, strftime(make_timestamp(((SELECT start FROM s) + b.bucket * {size}) * 1000000), '{pattern}') AS label,
  coalesce(c.n, 0) AS value FROM b LEFT JOIN c USING (bucket)"""


def alert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant vector of every alert."""
    return views.vector_votes(_alerts(spark, sf_dir)).select("alert_key", "vector_key", "vector")


def _votes_sql() -> str:
    from reqlens.plans.request_queries import VECTOR_SQL

    return f"""WITH {t.ALERTS_SQL}, u AS (SELECT alert_key, unnest(triggered_rules) AS r, generate_subscripts(triggered_rules, 1) AS i
  FROM alerts), v AS (SELECT *, {VECTOR_SQL} AS v FROM u),
g AS (SELECT alert_key, v.k AS k, count(*) AS n, min(i) AS first_i, arg_min(v.l, i) AS l FROM v GROUP BY alert_key, v.k),
w AS (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY n DESC, first_i) AS rn FROM g),
votes AS (SELECT a.alert_key, coalesce(w.k, 'other') AS vector_key, coalesce(w.l, 'Other') AS vector
  FROM alerts a LEFT JOIN w ON a.alert_key = w.alert_key AND w.rn = 1)"""


ALERT_VECTORS = f"{_votes_sql()} SELECT * FROM votes"


def top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most frequent vectors with their share."""
    return views.top_vectors(_alerts(spark, sf_dir))


TOP_VECTORS = f"""{_votes_sql()}, c AS (SELECT vector, count(*) AS alerts FROM votes GROUP BY vector
  ORDER BY alerts DESC, vector LIMIT 5)
SELECT vector, alerts, CAST(greatest(4, floor(alerts * 100.0 / sum(alerts) OVER () + 0.5)) AS BIGINT) AS share_pct FROM c"""


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report table of the newest alerts."""
    return views.report_rows(_alerts(spark, sf_dir))


REPORT_ROWS = f"""{_votes_sql()}, n AS (SELECT * FROM alerts ORDER BY ts DESC, alert_key DESC LIMIT 50)
SELECT strftime(ts, '%H:%M:%S') AS time, client_ip AS ip, vector AS type, coalesce(list_extract(triggered_rules, 1), '-') AS rule,
  coalesce(CAST(CAST(round(ai_score * 100, 1) AS DECIMAL(5, 1)) AS VARCHAR) || '%', '-') AS ai_score
FROM n JOIN votes USING (alert_key)"""


# ---- rule catalog ----------------------------------------------------------------


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    rule = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), F.col("event_id"))).otherwise(
        (F.lit(990001) + F.pmod("user_id", F.lit(60))).cast("string")
    )
    return e.select(rule.alias("id"), (F.col("value") > 20).alias("enabled"), F.col("ts").cast("timestamp").alias("updated_at"))


_OVERRIDES_SQL = """o AS (SELECT CASE WHEN event_id % 9 = 0 THEN 'x' || event_id ELSE CAST(990001 + user_id % 60 AS VARCHAR) END AS id,
  value > 20 AS enabled, ts AS updated_at FROM events)"""
_CATALOG_SQL = "cat(id, category) AS (VALUES " + ", ".join(f"('{r.id}', '{r.category}')" for r in rules.RULES) + ")"


def rule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule catalog with the latest valid override of each rule."""
    catalog = rules.rule_catalog(spark)
    valid = joins.valid_rule_updates(_overrides(spark, sf_dir), catalog)
    state = joins.apply_overrides(catalog, valid)
    return state.select("id", "category", "enabled", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


RULE_STATES = f"""WITH {_OVERRIDES_SQL}, {_CATALOG_SQL},
l AS (SELECT id, arg_max(enabled, updated_at) AS enabled, max(updated_at) AS updated_at FROM o GROUP BY id)
SELECT cat.id, category, coalesce(l.enabled, true) AS enabled, strftime(l.updated_at, {TS_SQL}) AS updated_at
FROM cat LEFT JOIN l USING (id)"""


def rule_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of ten rules with totals."""
    page = views.offset_page(rule_states(spark, sf_dir), ["id"], page=3, limit=10)
    return page.select("id", "enabled", "total_count", "total_pages")


RULE_PAGE = f"""{RULE_STATES.replace('SELECT cat.id', ', st AS (SELECT cat.id', 1)})
SELECT id, enabled, 26::BIGINT AS total_count, 3::BIGINT AS total_pages FROM st ORDER BY id LIMIT 10 OFFSET 20"""


def rejected_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule updates that name no catalog rule, with the reason."""
    bad = joins.rejected_rule_updates(_overrides(spark, sf_dir), rules.rule_catalog(spark))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("updates"), F.countDistinct("id").alias("ids"))


REJECTED_UPDATES = f"""WITH {_OVERRIDES_SQL}, {_CATALOG_SQL}
SELECT CASE WHEN regexp_matches(id, '^[0-9]+$') THEN 'rule not found' ELSE 'invalid rule id format' END AS reason,
  count(*) AS updates, count(DISTINCT id) AS ids FROM o WHERE id NOT IN (SELECT id FROM cat) GROUP BY 1"""


def disabled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directive lines for the rules switched off."""
    return views.disabled_rule_lines(rule_states(spark, sf_dir))


DISABLED_RULES = f"""{RULE_STATES.replace('SELECT cat.id', ', st AS (SELECT cat.id', 1)})
SELECT 'SecRuleRemoveById ' || id AS value FROM st WHERE NOT enabled"""


# ---- merges ------------------------------------------------------------------------


def unseen_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts whose key is not stored as enriched."""
    a = _alerts(spark, sf_dir)
    stored = a.where(F.col("seq") % 2 == 0).select("alert_key", "ai_status")
    return joins.without_enriched(a, stored).select("alert_key", "ai_status")


UNSEEN_ALERTS = f"""WITH {t.ALERTS_SQL} SELECT alert_key, ai_status FROM alerts
WHERE NOT (seq % 2 = 0 AND ai_status = 'enriched')"""


def reviewed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts after a batch of reviews: valid labels only, the latest review wins."""
    a = _alerts(spark, sf_dir).withColumns(
        {"status": F.lit("generated"), "human_label": F.lit(None).cast("string"),
         "reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp")}
    )
    e = t.table(spark, sf_dir, "events")
    reviews = e.select(
        F.lpad(F.floor(F.col("event_id") / 3).cast("string"), 12, "0").alias("alert_key"),
        t._cycle(F.col("event_id"), ["true_positive", "false_positive", "unsure", "true_positive"]).alias("human_label"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id"))).otherwise(" ").alias("email"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
    )
    done = views.apply_reviews(a, reviews)
    return done.select(
        "alert_key", "status", "human_label", "reviewed_by",
        F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reviewed_at"),
    )


REVIEWED_ALERTS = f"""WITH {t.ALERTS_SQL}, r AS (SELECT lpad(CAST(event_id // 3 AS VARCHAR), 12, '0') AS alert_key, ts,
  CASE event_id % 4 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'unsure' ELSE 'true_positive' END AS lab,
  CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'unknown' END AS who FROM events),
l AS (SELECT alert_key, arg_max(lab, ts) AS lab, arg_max(who, ts) AS who, max(ts) AS at FROM r WHERE lab <> 'unsure' GROUP BY 1)
SELECT a.alert_key, CASE WHEN l.at IS NULL THEN 'generated' ELSE 'reviewed' END AS status, l.lab AS human_label,
  l.who AS reviewed_by, strftime(l.at, {TS_SQL}) AS reviewed_at FROM alerts a LEFT JOIN l USING (alert_key)"""


# ---- model history -------------------------------------------------------------------


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training history derived from orders: one run for each order."""
    o = t.table(spark, sf_dir, "orders")
    number = F.concat(F.lit("v"), F.col("o_orderkey"))
    return o.select(
        F.when(F.col("o_orderkey") % 7 == 0, "draft").otherwise(number).alias("version"),
        "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("trained_at"),
        (F.col("o_orderkey") % 5 == 0).alias("active"),
    )


_HISTORY_SQL = """h AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'draft' ELSE 'v' || o_orderkey END AS version, o_orderkey,
  o_totalprice, o_orderdate AS trained_at, o_orderkey % 5 = 0 AS active FROM orders)"""


def model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest fifty training runs with the given one activated, and the next free version."""
    h = views.activate(_history(spark, sf_dir), "v3")
    nxt = views.next_version(h).withColumn("_k", F.lit(1))
    runs = views.newest(h, 50, "trained_at", "o_orderkey").withColumn("_k", F.lit(1))
    return runs.join(nxt, "_k").select("version", "o_orderkey", "active", "next_version")


MODEL_HISTORY = f"""WITH {_HISTORY_SQL} SELECT version, o_orderkey, version = 'v3' AS active,
  (SELECT max(TRY_CAST(substr(version, 2) AS BIGINT)) + 1 FROM h WHERE version LIKE 'v%') AS next_version
FROM h ORDER BY trained_at DESC, o_orderkey DESC LIMIT 50"""


def training_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active version and time of the last run."""
    s = views.training_status(views.activate(_history(spark, sf_dir), "v3"))
    return s.withColumn("last_trained", F.date_format("last_trained", "yyyy-MM-dd"))


TRAINING_STATUS = f"""WITH {_HISTORY_SQL} SELECT coalesce(max(CASE WHEN version = 'v3' THEN version END), 'v0') AS active_version,
  strftime(max(trained_at), '%Y-%m-%d') AS last_trained FROM h"""

QUERIES = {
    "log_page": (log_page, LOG_PAGE),
    "alert_page_after": (alert_page_after, ALERT_PAGE_AFTER),
    "review_queue": (review_queue, REVIEW_QUEUE),
    "newest_alerts": (newest_alerts, NEWEST_ALERTS),
    "filtered_counts": (filtered_counts, FILTERED_COUNTS),
    "request_validation": (request_validation, REQUEST_VALIDATION),
    "alert_statistics": (alert_statistics, ALERT_STATISTICS),
    "collector_statistics": (collector_statistics, COLLECTOR_STATISTICS),
    "dataset_sources": (dataset_sources, DATASET_SOURCES),
    "review_statistics": (review_statistics, REVIEW_STATISTICS),
    "trend_day": (_trend("day"), _trend_sql("day")),
    "trend_week": (_trend("week"), _trend_sql("week")),
    "trend_month": (_trend("month"), _trend_sql("month")),
    "alert_vectors": (alert_vectors, ALERT_VECTORS),
    "top_vectors": (top_vectors, TOP_VECTORS),
    "report_rows": (report_rows, REPORT_ROWS),
    "rule_states": (rule_states, RULE_STATES),
    "rule_page": (rule_page, RULE_PAGE),
    "rejected_updates": (rejected_updates, REJECTED_UPDATES),
    "disabled_rules": (disabled_rules, DISABLED_RULES),
    "unseen_alerts": (unseen_alerts, UNSEEN_ALERTS),
    "reviewed_alerts": (reviewed_alerts, REVIEWED_ALERTS),
    "model_history": (model_history, MODEL_HISTORY),
    "training_status": (training_status, TRAINING_STATUS),
}
