"""Log lines and foreign records to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens import schemas
from reqlens.functions import identity, url
from reqlens.functions import timestamps as tm

NO_STRINGS = "array<string>"
SCORE_TEXT = "Inbound Anomaly Score Exceeded"
BLOCKED_STATUS = [403, 406, 500]


def _nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


# ---- audit events ----------------------------------------------------------


def flatten_variant_headers(headers: Column) -> Column:
    """Text values as they are, lists by their first text, anything else dropped."""

    def kind(v: Column) -> Column:
        return F.schema_of_variant(v)

    def value(v: Column) -> Column:
        first = F.try_variant_get(v, "$[0]", "variant")
        return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(
            kind(v).startswith("ARRAY") & (kind(first) == "STRING"), F.try_variant_get(first, "$", "string")
        )

    flat = F.transform_values(headers, lambda _, v: value(v))
    return F.coalesce(F.map_filter(flat, lambda _, v: v.isNotNull()), F.create_map().cast(schemas.HEADERS))


def _rule_id(v: Column) -> Column:
    """Numeric ids as text without a fraction; a non-numeric id reads as 0."""
    number = F.when(F.schema_of_variant(v) != "STRING", F.try_variant_get(v, "$", "double"))
    return F.coalesce(number.cast("bigint"), F.lit(0)).cast("string")


def audit_rule_details(messages: Column) -> Column:
    """Every message that carries a rule id, repeats included."""
    with_id = F.filter(messages, lambda m: m["data"]["id"].isNotNull())
    details = F.transform(
        with_id,
        lambda m: F.struct(
            _rule_id(m["data"]["id"]).alias("rule_id"),
            F.coalesce(m["data"]["severity"], F.lit("")).alias("severity"),
            F.coalesce(m["message"], F.lit("")).alias("message"),
        ),
    )
    return F.coalesce(
        details, F.array().cast("array<struct<rule_id string, severity string, message string>>")
    )


def triggered_rules(details: Column) -> Column:
    """Distinct rule ids in order of appearance; only rules with a message text count."""
    texted = F.filter(details, lambda d: d["message"] != "")
    return F.array_distinct(F.transform(texted, lambda d: d["rule_id"]))


def score_from_messages(messages: Column) -> Column:
    """Total of the last score message that parses; 0 when none does."""
    totals = F.transform(
        F.filter(messages, lambda m: m["message"].contains(SCORE_TEXT)),
        lambda m: F.rtrim(F.get(F.split(m["message"], "Total Score: "), F.lit(1)), F.lit(")")).try_cast("double"),
    )
    parsed = F.filter(totals, lambda t: t.isNotNull())
    return F.coalesce(F.when(F.size(parsed) > 0, F.element_at(parsed, -1)), F.lit(0.0))


def query_params(uri: Column) -> Column:
    """First value of each query key; an unparsable target has none."""
    pairs = url.first_values(url.strict_pairs(url.query_of(uri)))
    entries = F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    return F.when(url.is_strict_uri(uri), F.map_from_entries(entries)).otherwise(
        F.create_map().cast(schemas.HEADERS)
    )


def parse_audit(lines: DataFrame, raw: str = "value", ingested_at: Column | None = None) -> DataFrame:
    """Audit log lines to alert columns; ``_bad`` keeps the text of unparsable lines."""
    now = ingested_at if ingested_at is not None else F.current_timestamp()
    event = F.from_json(raw, schemas.AUDIT_EVENT, {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("_e", event)
    tx, request = F.col("_e.transaction"), F.col("_e.transaction.request")
    body = F.coalesce(request["body"], F.lit(""))
    uri = F.coalesce(request["uri"], F.lit(""))
    parsed = parsed.withColumns(
        {
            "timestamp_raw": tm.normalise_audit_time(tx["timestamp"], now),
            "client_ip": F.coalesce(tx["client_ip"], F.lit("")),
            "uri": uri,
            "method": F.coalesce(request["method"], F.lit("")),
            "body": body,
            "body_length": F.octet_length(body),
            "headers": flatten_variant_headers(request["headers"]),
            "header_count": F.coalesce(F.size(F.map_keys(request["headers"])), F.lit(0)),
            "query_params": query_params(uri),
            "rule_details": audit_rule_details(F.col("_e.messages")),
            "anomaly_score": score_from_messages(F.col("_e.messages")),
            "status": F.lit("generated"),
            "ai_status": F.lit("unavailable"),
            "raw_log": F.col(raw),
            "_bad": F.col("_e._bad"),
        }
    ).drop("_e")
    return parsed.withColumns(
        {
            "ts": tm.parse_timestamp(F.col("timestamp_raw")),
            "time_bucket": tm.minute_bucket(F.col("timestamp_raw"), now),
            "triggered_rules": triggered_rules(F.col("rule_details")),
            "request_fingerprint_version": F.lit(identity.FINGERPRINT_VERSION),
            "request_fingerprint": identity.fingerprint(
                *[F.col(c) for c in ("method", "uri", "body", "headers", "client_ip")]
            ),
        }
    ).withColumn("alert_key", alert_key_of_row())


def alert_key_of_row() -> Column:
    """Alert key over the parsed columns of a row."""
    names = ("method", "uri", "body", "client_ip", "timestamp_raw", "triggered_rules", "headers")
    return identity.alert_key(*[F.col(c) for c in names])


# ---- access events ---------------------------------------------------------


def first_header_values(headers: Column) -> Column:
    first = F.transform_values(headers, lambda _, v: F.get(v, F.lit(0)))
    return F.coalesce(F.map_filter(first, lambda _, v: v.isNotNull()), F.create_map().cast(schemas.HEADERS))


def parse_access(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Access log lines to request columns; the body is the captured one, else the request body,
    else the raw query of a GET or HEAD."""
    event = F.from_json(raw, schemas.ACCESS_EVENT, {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("_e", event)
    request = F.col("_e.request")
    method = F.coalesce(request["method"], F.lit(""))
    uri = F.coalesce(request["uri"], F.lit(""))
    captured = F.coalesce(_nonempty(F.col("_e.captured_body")), F.col("_e.request_body"), F.lit(""))
    fallback = F.when(method.isin("GET", "HEAD"), url.query_of(uri)).otherwise("")
    seconds = F.coalesce(F.col("_e.ts"), F.lit(0.0)).cast("bigint")
    parsed = parsed.withColumns(
        {
            "ts": F.timestamp_seconds(seconds),
            "timestamp_raw": F.date_format(F.timestamp_seconds(seconds), tm.ISO_SECONDS),
            "client_ip": F.coalesce(request["client_ip"], F.lit("")),
            "method": method,
            "uri": uri,
            "headers": first_header_values(request["headers"]),
            "http_status": F.coalesce(F.col("_e.status"), F.lit(0)),
            "duration": F.col("_e.duration"),
            "body": F.coalesce(_nonempty(captured), fallback),
            "body_length": F.octet_length(captured),
            "triggered_rules": F.array().cast(NO_STRINGS),
            "anomaly_score": F.lit(0.0),
            "ai_status": F.lit("pending"),
            "source": F.lit("unknown"),
            "_bad": F.col("_e._bad"),
        }
    ).drop("_e")
    return parsed.withColumn("alert_key", alert_key_of_row())


def is_blocked(status: Column) -> Column:
    return status.isin(BLOCKED_STATUS)


def is_passed(status: Column) -> Column:
    return status.between(200, 399)


# ---- replay entries --------------------------------------------------------


def audit_outcome(entry: Column) -> dict[str, Column]:
    """Rule ids, severities, messages and score of a replay audit entry.

    Each value is the first one present and not empty over its possible places; an entry
    without a transaction is its own transaction.
    """
    tx = entry["transaction"]

    def tx_field(name: str) -> Column:
        return F.when(tx.isNull(), entry[name]).otherwise(tx[name])

    def nonempty_array(a: Column) -> Column:
        return F.when(F.size(a) > 0, a)

    rules = F.coalesce(
        nonempty_array(tx_field("messages")),
        nonempty_array(tx_field("matched_rules")),
        nonempty_array(entry["messages"]),
    )
    rules = F.filter(rules, lambda r: r.isNotNull())
    ids = F.transform(
        rules, lambda r: F.coalesce(_nonzero(r["rule_id"]), _nonzero(r["id"]), r["rule"]["id"])
    )
    severities = F.transform(
        rules, lambda r: F.coalesce(_nonempty(r["severity"]), _nonempty(r["rule"]["severity"]), F.lit(""))
    )
    messages = F.transform(
        rules,
        lambda r: F.coalesce(
            _nonempty(r["message"]), _nonempty(r["msg"]), _nonempty(r["rule"]["msg"]), F.lit("")
        ),
    )
    score = F.coalesce(
        _nonzero(tx_field("producer")["anomaly_score"]),
        _nonzero(tx_field("anomaly_score")),
        _nonzero(entry["anomaly_score"]),
        F.lit(0),
    )
    return {
        "coraza_fired_rule_ids": F.coalesce(F.array_compact(ids), F.array().cast("array<int>")),
        "coraza_rule_severities": F.coalesce(severities, F.array().cast(NO_STRINGS)),
        "coraza_rule_messages": F.coalesce(messages, F.array().cast(NO_STRINGS)),
        "coraza_anomaly_score": score,
        "coraza_matched": F.lit(True),
    }


def audit_entry_uri(entry: Column) -> Column:
    tx = entry["transaction"]
    request_uri = F.when(tx.isNull(), entry["request"]["uri"]).otherwise(tx["request"]["uri"])
    tx_uri = F.when(tx.isNull(), entry["uri"]).otherwise(tx["uri"])
    return F.coalesce(_nonempty(request_uri), _nonempty(tx_uri), _nonempty(entry["uri"]), F.lit(""))


def inferred_outcome(status: Column) -> dict[str, Column]:
    """Outcome read off the response when the audit log has no entry."""
    fired = status == 403
    return {
        "coraza_fired_rule_ids": F.array().cast("array<int>"),
        "coraza_rule_severities": F.array().cast(NO_STRINGS),
        "coraza_rule_messages": F.array(F.when(fired, "inferred from HTTP 403").otherwise("")),
        "coraza_anomaly_score": F.when(fired, 100).otherwise(0),
        "coraza_matched": F.coalesce(fired, F.lit(False)),
    }


def empty_outcome() -> dict[str, Column]:
    return {
        "coraza_fired_rule_ids": F.array().cast("array<int>"),
        "coraza_rule_severities": F.array().cast(NO_STRINGS),
        "coraza_rule_messages": F.array().cast(NO_STRINGS),
        "coraza_anomaly_score": F.lit(0),
        "coraza_matched": F.lit(False),
    }


# Names the feature step expects instead of the firewall-prefixed ones.
FEATURE_NAMES = {
    "coraza_fired_rule_ids": "fired_rule_ids",
    "coraza_rule_severities": "rule_severities",
    "coraza_rule_messages": "rule_messages",
    "coraza_anomaly_score": "anomaly_score",
    "coraza_inbound_threshold": "inbound_threshold",
}


def rename_for_features(df: DataFrame) -> DataFrame:
    """Firewall-prefixed evidence columns under the names the feature step expects."""
    return df.withColumnsRenamed(FEATURE_NAMES)


def is_attack(label: Column) -> Column:
    return F.coalesce((label == "attack").cast("int"), F.lit(0))
