"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

HEADERS = "map<string,string>"

LABELLED_REQUEST = (
    "request_id string, method string, uri string, headers map<string,string>, body string, "
    "label string, attack_family string"
)

ENRICHED_REQUEST = LABELLED_REQUEST + (
    ", coraza_fired_rule_ids array<int>, coraza_rule_severities array<string>, "
    "coraza_rule_messages array<string>, coraza_anomaly_score int"
)

REQUIRED_FIELDS = [piece.strip().split(" ")[0] for piece in ENRICHED_REQUEST.replace("<string,string>", "").split(",")]

# Header values and message ids arrive as text, number or list, hence VARIANT.
AUDIT_EVENT = (
    "transaction struct<timestamp string, client_ip string, request struct<uri string, method string, "
    "body string, headers map<string,variant>>>, "
    "messages array<struct<message string, data struct<id variant, severity string>>>, _bad string"
)

_REPLAY_RULE = (
    "struct<rule_id int, id int, severity string, message string, msg string, "
    "rule struct<id int, severity string, msg string>>"
)
REPLAY_ENTRY = (
    f"transaction struct<uri string, timestamp string, request struct<uri string>, "
    f"messages array<{_REPLAY_RULE}>, matched_rules array<{_REPLAY_RULE}>, "
    "producer struct<anomaly_score int>, anomaly_score int>, "
    f"uri string, timestamp string, request struct<uri string>, messages array<{_REPLAY_RULE}>, "
    f"matched_rules array<{_REPLAY_RULE}>, producer struct<anomaly_score int>, anomaly_score int, _bad string"
)

ACCESS_EVENT = (
    "level string, ts double, logger string, msg string, "
    "request struct<remote_ip string, remote_port string, client_ip string, proto string, method string, "
    "host string, uri string, headers map<string,array<string>>>, "
    "bytes_read int, duration double, size int, status int, resp_headers map<string,array<string>>, "
    "request_body string, captured_body string, _bad string"
)

SIGNATURE = (
    "id string, name string, category string, severity string, patterns array<string>, description string"
)

RULE_OVERRIDE = "id string, enabled boolean, updated_at timestamp"

EXPLANATION = "array<struct<name string, grp string, value double, direction string>>"

# The alert table (one row per alert_key). ``coraza_flagged`` marks rows that came from the firewall.
ALERT = (
    "alert_key string, timestamp_raw string, ts timestamp, time_bucket timestamp, client_ip string, uri string, "
    "method string, body string, body_length int, headers map<string,string>, header_count int, "
    "query_params map<string,string>, triggered_rules array<string>, "
    "rule_details array<struct<rule_id string, severity string, message string>>, anomaly_score double, "
    "status string, http_status int, source string, request_fingerprint string, "
    "request_fingerprint_version string, human_label string, reviewed_by string, reviewed_at timestamp, "
    f"ai_status string, ai_score double, ai_confidence double, ai_priority string, ai_explanation {EXPLANATION}, "
    "ai_model_version string, ai_confidence_interval struct<low double, high double>, ai_entropy double, "
    "raw_log string, coraza_flagged boolean, matched_signatures array<string>"
)


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """Top-level (name, type) pairs of a DDL string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append((name, kind.strip()))
            start = i + 1
    return out
