"""Request fingerprint, alert keys and body-cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqlens.functions import url

FINGERPRINT_VERSION = "rfp-v1"
WHITESPACE = r"(?U)\s+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalise_path(path: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.trim(path)), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def normalise_query_keys(query: Column) -> Column:
    """Distinct decoded keys, lower-cased, sorted; a query a strict parser rejects gives nothing."""
    keys = F.array_distinct(F.transform(url.param_pairs(query), lambda p: p["k"]))
    joined = F.array_join(F.array_sort(F.transform(keys, lambda k: F.lower(F.trim(k)))), "&")
    return F.when(url.is_strict_query(query), joined).otherwise("")


def normalise_body(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, WHITESPACE, " "))


def header_value(headers: Column, name: str) -> Column:
    """Case-insensitive header lookup, lower-cased and trimmed; empty when absent."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(F.trim(e["key"])) == name)
    return F.coalesce(F.when(F.size(hits) > 0, F.lower(F.trim(F.element_at(hits, 1)["value"]))), F.lit(""))


def agent_family(headers: Column) -> Column:
    """User agent up to the first slash; the whole text when the slash leads or is missing."""
    agent = header_value(headers, "user-agent")
    family = F.substring_index(agent, "/", 1)
    return F.when(family == "", agent).otherwise(family)


def ipv4_bucket(ip: Column) -> Column:
    parts = F.split(F.trim(_text(ip)), r"\.")
    network = F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".0/24"))
    return F.when(F.size(parts) == 4, network).otherwise("")


def fingerprint(method: Column, uri: Column, body: Column, headers: Column, ip: Column) -> Column:
    u = F.when(url.is_strict_uri(_text(uri)), _text(uri)).otherwise("")
    parts = [
        F.upper(F.trim(_text(method))),
        normalise_path(url.decode_path(url.path_of(u, drop_params=False))),
        normalise_query_keys(url.query_of(u)),
        F.sha2(normalise_body(_text(body)), 256),
        header_value(headers, "content-type"),
        agent_family(headers),
        ipv4_bucket(ip),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def header_hash(headers: Column) -> Column:
    lines = F.transform(
        F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n"))
    )
    return F.substring(F.sha2(F.coalesce(F.array_join(lines, ""), F.lit("")), 256), 1, 16)


def alert_key(
    method: Column, uri: Column, body: Column, ip: Column, timestamp: Column, rules: Column, headers: Column
) -> Column:
    """Stable 16-digit identity of an alert or a miss."""
    ordered = F.coalesce(F.array_join(F.array_sort(rules), ","), F.lit(""))
    parts = [_text(method), _text(uri), _text(body), _text(ip), _text(timestamp), ordered, header_hash(headers)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def body_key(method: Column, uri: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", _text(method), _text(uri)), 256), 1, 16)
