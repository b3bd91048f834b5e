"""Analyst views over the alert table: filters, pages, listings, statistics, trend, vectors."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reqlens.functions import timestamps as tm
from reqlens.functions import vectors
from reqlens.operators.joins import zero_filled

FIREWALL_SOURCES = ["coraza", "waf_blocked"]
MISS_SOURCE = "ml_miss_detector"
BLOCKING_SCORE = 5
NO_VALUE = "—"

# Columns of the two listings.
LOG_COLUMNS = [
    "alert_key", "timestamp_raw", "client_ip", "uri", "anomaly_score", "triggered_rules", "ai_status", "ai_score",
    "ai_confidence", "ai_priority", "ai_explanation", "ai_model_version", "ai_entropy", "ai_confidence_interval",
    "source",
]
ALERT_COLUMNS = [c for c in LOG_COLUMNS if c != "source"]

# Buckets, bucket length in seconds, label format per trend range.
TREND_RANGES = {
    "day": (96, 900, "HH:mm"),
    "week": (84, 7200, "EEE HH:mm"),
    "month": (120, 21600, "dd MMM HH:mm"),
}
# Key, name, rule prefix of the dataset sources.
DATASET_SOURCES = [
    ("sqli", "SQL Injection Samples", "942"),
    ("xss", "XSS Samples", "941"),
    ("cmdi", "Command Injection Samples", "932"),
    ("lfi", "LFI/Traversal Samples", "930"),
    ("rfi", "RFI Samples", "931"),
    ("normal", "Normal Traffic Samples", ""),
]


# ---- filters ---------------------------------------------------------------


def is_scored() -> Column:
    return F.col("anomaly_score") > 0


def scored(df: DataFrame) -> DataFrame:
    """Alerts the firewall gave a positive score."""
    return df.where(is_scored())


def filter_log(
    df: DataFrame, source: str | None = None, priority: str | None = None, exclude_score_0: bool = False
) -> DataFrame:
    """Log filters: source, one priority or a comma list, and score not zero (a missing score stays)."""
    if source and source.strip():
        df = df.where(F.col("source") == source.strip())
    if priority and priority.strip():
        df = df.where(F.col("ai_priority").isin([p.strip().upper() for p in priority.split(",")]))
    if exclude_score_0:
        df = df.where(~F.col("anomaly_score").eqNullSafe(F.lit(0.0)))
    return df


def filter_review(
    df: DataFrame, status: str = "generated", priority: str = "", source: str = "", human_label: str = ""
) -> DataFrame:
    wanted = {"status": status, "ai_priority": priority, "source": source, "human_label": human_label}
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def search(df: DataFrame, text: str, columns: list[str], priorities: list[str] | None = None) -> DataFrame:
    """Rows whose shown text contains the words typed, and whose priority is switched on."""
    shown = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    hit = shown.contains(text.lower().strip())
    if priorities is not None:
        hit = hit & (F.col("ai_priority").isNull() | F.col("ai_priority").isin(priorities))
    return df.where(hit)


def validation_errors(method: Column, uri: Column, score: Column, threshold: Column) -> Column:
    """Reasons a request cannot be scored, joined by ``; ``; empty when it can."""

    def negative(name: str, value: Column) -> Column:
        message = F.concat(F.lit(f"Field '{name}' must be >= 0, got "), value.cast("string"), F.lit("."))
        return F.when(value < 0, message)

    def missing(name: str, value: Column) -> Column:
        return F.when(
            F.coalesce(value, F.lit("")) == "", f"Field '{name}' is required and must be a non-empty string."
        )

    return F.concat_ws(
        "; ",
        missing("method", method),
        missing("uri", uri),
        negative("anomaly_score", score),
        negative("inbound_threshold", threshold),
    )


def is_enriched(status: Column, score: Column) -> Column:
    return F.coalesce((status == "enriched") & score.isNotNull(), F.lit(False))


def has_rule_prefix(rules: Column, prefix: str) -> Column:
    return F.coalesce(F.exists(rules, lambda r: r.startswith(prefix)), F.lit(False))


def has_no_rules(rules: Column) -> Column:
    return F.coalesce(F.size(rules), F.lit(0)) <= 0


def since(df: DataFrame, keyword: str, now: datetime, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= F.lit(now - timedelta(seconds=tm.window_seconds(keyword))))


# ---- pages -----------------------------------------------------------------


def check_limit(limit: int, upper: int = 500) -> int:
    if not 1 <= limit <= upper:
        raise ValueError(f"limit must be between 1 and {upper}")
    return limit


def keyset_page(
    df: DataFrame,
    key: list[str],
    limit: int = 50,
    after: tuple | None = None,
    descending: bool = True,
) -> DataFrame:
    """One page in key order with ``has_more`` and the ``next_*`` key to continue from.

    The cursor is a filter on the sort key and the look-ahead row comes from ``limit + 1``, so the plan
    is a pruned scan and a top-k; only the page itself is numbered in one task.
    """
    check_limit(limit)
    if after is not None:
        past = F.lit(False)
        equal = F.lit(True)
        for name, value in zip(key, after, strict=True):
            c, v = F.col(name), F.lit(value)
            past = past | (equal & ((c < v) if descending else (c > v)))
            equal = equal & (c == v)
        df = df.where(past)
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in key]
    head = df.orderBy(*order).limit(limit + 1)
    numbered = head.withColumn("_n", F.row_number().over(W.orderBy(*order)))
    whole = W.partitionBy()
    more = F.max("_n").over(whole) > limit
    last = {
        f"next_{k}": F.when(more, F.max(F.when(F.col("_n") == limit, F.col(k))).over(whole)) for k in key
    }
    return numbered.withColumns({"has_more": more, **last}).where(F.col("_n") <= limit).drop("_n")


def log_page(df: DataFrame, limit: int = 50, after: tuple | None = None, **filters) -> DataFrame:
    """Newest alerts first, in the log listing's columns."""
    wanted = filter_log(df, **filters).select("ts", *LOG_COLUMNS)
    return keyset_page(wanted, ["ts", "alert_key"], limit, after)


def alert_page(df: DataFrame, limit: int = 50, after: tuple | None = None) -> DataFrame:
    return keyset_page(df.select("ts", *ALERT_COLUMNS), ["ts", "alert_key"], limit, after)


def review_page(df: DataFrame, limit: int = 50, after: tuple | None = None, **filters) -> DataFrame:
    """Oldest first; a limit outside 1 to 100 means 50. ``total`` counts the whole filtered queue."""
    size = limit if 1 <= limit <= 100 else 50
    queue = filter_review(df, **filters)
    total = queue.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    page = keyset_page(queue, ["ts", "alert_key"], size, after, descending=False)
    return page.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")


def offset_page(df: DataFrame, order: list[str], page: int = 1, limit: int = 50) -> DataFrame:
    """Numbered page with the total row and page counts; meant for small catalogs."""
    check_limit(limit)
    if page < 1:
        raise ValueError("invalid pagination parameters")
    n = F.count(F.lit(1)).cast("bigint")
    totals = df.agg(n.alias("total_count"), F.ceil(n / limit).alias("total_pages")).withColumn("_k", F.lit(1))
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return rows.withColumn("_k", F.lit(1)).join(totals, "_k").drop("_k")


def newest(df: DataFrame, n: int, *by: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in by]).limit(n)


# ---- statistics ------------------------------------------------------------


def alert_statistics(df: DataFrame) -> DataFrame:
    """Counts, blocked share and latest priority in one pass."""
    blocked = F.count_if(F.col("anomaly_score") >= BLOCKING_SCORE)
    total = F.count(F.lit(1))
    latest = F.max_by("ai_priority", F.when(F.col("ai_priority").isNotNull(), F.struct("ts", "alert_key")))
    return df.agg(
        total.alias("total_alerts"),
        F.count_if(F.col("source").isin(FIREWALL_SOURCES)).alias("coraza_count"),
        F.count_if(F.col("source") == MISS_SOURCE).alias("ml_miss_count"),
        F.count_if(F.col("ai_status") == "enriched").alias("ai_enriched_count"),
        blocked.alias("blocked_count"),
        F.coalesce(F.try_divide(blocked * 100.0, total), F.lit(0.0)).alias("blocked_percentage"),
        F.coalesce(F.nullif(latest, F.lit("")), F.lit(NO_VALUE)).alias("latest_priority"),
    )


def collector_statistics(df: DataFrame) -> DataFrame:
    """Total and the last rule of the newest alert."""
    rules = F.max_by("triggered_rules", F.struct("ts", "alert_key"))
    return df.agg(F.count(F.lit(1)).alias("total_alerts"), rules.alias("_r")).select(
        "total_alerts",
        F.coalesce(F.try_element_at("_r", F.lit(-1)), F.lit(NO_VALUE)).alias("latest_rule"),
        F.lit("protected").alias("status"),
    )


def dataset_sources(df: DataFrame) -> DataFrame:
    """Sample count and share per attack family, read off rule prefixes; one pass over the alerts."""
    rules = F.col("triggered_rules")
    counts = [
        F.count_if(has_rule_prefix(rules, prefix) if prefix else has_no_rules(rules)).alias(key)
        for key, _, prefix in DATASET_SOURCES
    ]
    once = df.agg(F.count(F.lit(1)).alias("_total"), *counts)
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.col(k).alias("samples"))
            for k, n, _ in DATASET_SOURCES
        ]
    )
    share = F.coalesce(F.try_divide(F.col("s.samples") * 100.0, F.col("_total")), F.lit(0.0))
    return once.select("_total", F.explode(rows).alias("s")).select("s.*", share.alias("share_pct"))


def review_statistics(df: DataFrame) -> DataFrame:
    reviewed = F.col("status") == "reviewed"
    return df.agg(
        F.count_if(F.col("status") == "generated").alias("pending"),
        F.count_if(reviewed).alias("reviewed"),
        F.count_if(reviewed & (F.col("human_label") == "true_positive")).alias("true_positive"),
        F.count_if(reviewed & (F.col("human_label") == "false_positive")).alias("false_positive"),
    )


def trend(df: DataFrame, range_type: str, now: datetime, ts: str = "ts") -> DataFrame:
    """Alerts per bucket of a day, week or month up to ``now``, zero filled."""
    if range_type not in TREND_RANGES:
        raise ValueError("range must be day, week, or month")
    n, size, pattern = TREND_RANGES[range_type]
    epoch = int(now.replace(tzinfo=timezone.utc).timestamp())
    start = epoch // size * size - (n - 1) * size
    seconds = F.unix_micros(F.col(ts)) / 1_000_000
    recent = df.where(
        (F.col(ts) >= F.timestamp_seconds(F.lit(start))) & (F.col(ts) <= F.timestamp_seconds(F.lit(epoch + 60)))
    )
    index = F.floor((seconds - start) / size)
    counts = recent.groupBy(index.alias("bucket")).agg(F.count(F.lit(1)).alias("value")).where(F.col("bucket") < n)
    scaffold = df.sparkSession.range(n).select(F.col("id").alias("bucket"))
    label = F.date_format(F.timestamp_seconds(F.lit(start) + F.col("bucket") * size), pattern)
    return zero_filled(counts, scaffold, "bucket", ["value"]).select("bucket", label.alias("label"), "value")


def vector_votes(df: DataFrame) -> DataFrame:
    """Alerts with the vector most of their rules vote for."""
    v = vectors.dominant_vector(F.col("triggered_rules"))
    return df.withColumn("_v", v).withColumns({"vector_key": F.col("_v.key"), "vector": F.col("_v.label")}).drop("_v")


def top_vectors(df: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent vectors with their share of the listed total, at least 4 percent."""
    counts = vector_votes(df).groupBy("vector").agg(F.count(F.lit(1)).alias("alerts"))
    top = counts.orderBy(F.desc("alerts"), "vector").limit(n)
    share = F.floor(F.col("alerts") * 100.0 / F.sum("alerts").over(W.partitionBy()) + 0.5)
    return top.withColumn("share_pct", F.greatest(F.lit(4).cast("bigint"), share))


def report_rows(df: DataFrame, limit: int = 50) -> DataFrame:
    """Newest alerts as the report shows them: time, ip, type, rule, ai_score."""
    percent = F.round(F.col("ai_score") * 100, 1).cast("decimal(5,1)").cast("string")
    score = F.concat(percent, F.lit("%"))
    shown = vector_votes(newest(df, limit, "ts", "alert_key"))
    return shown.select(
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.col("client_ip").alias("ip"),
        F.col("vector").alias("type"),
        F.coalesce(F.try_element_at("triggered_rules", F.lit(1)), F.lit("-")).alias("rule"),
        F.coalesce(score, F.lit("-")).alias("ai_score"),
    )


def apply_reviews(alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Alerts with the latest valid review: label, status, reviewer and time.

    ``reviews`` holds alert_key, human_label, email and reviewed_at. A hot key is pre-aggregated to
    one row before the join.
    """
    valid = reviews.where(F.col("human_label").isin("true_positive", "false_positive"))
    reviewer = F.when(F.trim(F.coalesce("email", F.lit(""))) != "", F.col("email")).otherwise("unknown")
    latest = (
        valid.groupBy("alert_key")
        .agg(F.max(F.struct("reviewed_at", "human_label", reviewer.alias("reviewed_by"))).alias("_v"))
    )
    done = F.col("_v").isNotNull()
    return (
        alerts.join(latest, "alert_key", "left")
        .withColumns(
            {
                "human_label": F.when(done, F.col("_v.human_label")).otherwise(F.col("human_label")),
                "status": F.when(done, "reviewed").otherwise(F.col("status")),
                "reviewed_by": F.when(done, F.col("_v.reviewed_by")).otherwise(F.col("reviewed_by")),
                "reviewed_at": F.when(done, F.col("_v.reviewed_at")).otherwise(F.col("reviewed_at")),
            }
        )
        .drop("_v")
    )


def disabled_rule_lines(rules: DataFrame) -> DataFrame:
    """Directive lines for the disabled rules, in id order."""
    off = rules.where(~F.col("enabled") & F.trim("id").rlike("^[0-9]+$"))
    return off.select(F.trim("id").alias("id")).orderBy("id").select(
        F.format_string("SecRuleRemoveById %s", F.col("id")).alias("value")
    )


# ---- model history ---------------------------------------------------------


def version_number(version: Column) -> Column:
    """The number of a version ``v`` and digits; null for other names and for numbers past 64 bits."""
    return F.when(version.rlike("^v[0-9]+$"), F.substr(version, F.lit(2)).try_cast("bigint"))


def next_version(registry: DataFrame) -> DataFrame:
    return registry.agg(
        (F.coalesce(F.max(version_number(F.col("version"))), F.lit(0)) + 1).cast("bigint").alias("next_version")
    )


def activate(registry: DataFrame, version: str) -> DataFrame:
    """Exactly the given version active."""
    return registry.withColumn("active", F.col("version") == version)


def training_status(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.coalesce(F.max(F.when(F.col("active"), F.col("version"))), F.lit("v0")).alias("active_version"),
        F.max("trained_at").alias("last_trained"),
    )


