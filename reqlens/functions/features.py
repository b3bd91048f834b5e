"""Request features as native column expressions.

Every function maps columns to a column, so a feature table is one projection
over the scan. Only the characters of a text are counted outside the JVM, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.functions import url
from reqlens.functions.binding import let

# Codes and weights of the feature contract.
METHOD_CODES = {"GET": 0, "POST": 1, "PUT": 2, "DELETE": 3, "PATCH": 4, "HEAD": 5, "OPTIONS": 6}
CONTENT_TYPE_CODES = {
    "application/json": 0,
    "application/x-www-form-urlencoded": 1,
    "multipart/form-data": 2,
    "text/plain": 3,
    "text/html": 4,
}
SEVERITY_WEIGHTS = {"CRITICAL": 3, "WARNING": 2, "NOTICE": 1}
RULE_FAMILIES = {"sqli": "942", "xss": "941", "lfi": "930", "rce": "932"}
SPECIAL_CHARS = "%'\"<>{}"
ENCODING_ARTIFACT = r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}"

LONG_TEXT = 256
#: Short texts whose characters are counted together at most; bits that hold any character, and any place in a short text.
SHORT_TEXTS, CODE_BITS, PLACE_BITS = 4096, 21, 9
#: Characters below this number are counted in an array of that size, others by sorting.
COUNTED = 1 << 14


def _lookup(codes: dict[str, int], key: Column, default: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.lit(default)).cast("double")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


# ---- rules -----------------------------------------------------------------


def rule_details(ids: Column, severities: Column, messages: Column) -> Column:
    """Align parallel arrays by rule id.

    A list shorter than the ids leaves the tail without a value; for a repeated
    id the last value wins, as in a dictionary built from the zipped lists.
    """
    none = F.array().cast("array<string>")

    def aligned(lists: Column) -> Column:
        rules = lists["ids"]

        def last_value(values: Column, rid: Column) -> Column:
            n = F.least(F.size(rules), F.size(values))
            hits = F.filter(F.slice(F.arrays_zip(rules.alias("i"), values.alias("v")), 1, n), lambda z: z["i"] == rid)
            return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])

        def details(value: Callable[[str, Column, Column], Column]) -> Column:
            return F.transform(
                rules,
                lambda rid, i: F.struct(
                    rid.alias("rule_id"),
                    F.coalesce(value("severities", rid, i), F.lit("")).alias("severity"),
                    F.coalesce(value("messages", rid, i), F.lit("")).alias("message"),
                ),
            )

        # Ids that do not repeat, the usual case, stand where their values stand and need no search.
        single = F.size(F.array_distinct(rules)) == F.size(rules)
        return F.when(single, details(lambda name, rid, i: F.when(rid.isNotNull(), F.get(lists[name], i)))).otherwise(
            details(lambda name, rid, _: last_value(lists[name], rid))
        )

    return let(
        F.struct(
            F.transform(F.coalesce(ids, none), lambda r: r.cast("string")).alias("ids"),
            F.coalesce(severities, none).alias("severities"),
            F.coalesce(messages, none).alias("messages"),
        ),
        aligned,
    )


def rule_texts(details: Column) -> Column:
    """Id and message of each rule as one lower-case text, for ``rule_family_count``."""
    return F.transform(details, lambda d: F.lower(F.concat(d["rule_id"], F.lit("\n"), d["message"])))


def rule_family_count(texts: Column, family: str) -> Column:
    """Rules whose id or message names the family or its number range."""
    number = RULE_FAMILIES[family]
    return F.size(F.filter(texts, lambda both: both.contains(family) | both.contains(number))).cast("double")


def severity_weighted_sum(details: Column) -> Column:
    return F.aggregate(
        details,
        F.lit(0.0),
        lambda acc, d: acc + _lookup(SEVERITY_WEIGHTS, F.upper(d["severity"]), 0),
    )


def rule_columns(details: Column, texts: Column | None = None) -> dict[str, Column]:
    """Rule features of ``details``; ``texts`` is ``rule_texts`` of them where it is a column already."""
    texts = rule_texts(details) if texts is None else texts
    out = {f"num_{f}_rules": rule_family_count(texts, f) for f in RULE_FAMILIES}
    out["severity_weighted_sum"] = severity_weighted_sum(details)
    out["total_rule_count"] = F.size(details).cast("double")
    return out


def score_columns(score: Column, threshold: Column) -> dict[str, Column]:
    s = F.coalesce(score.cast("double"), F.lit(0.0))
    t = F.coalesce(threshold.cast("double"), F.lit(0.0))
    return {
        "anomaly_score": s,
        "anomaly_score_normalized": F.when(t > 0, s / t).otherwise(0.0),
        "is_above_threshold": _flag(s > t),
    }


def rule_indicator(ids: Column, rule_id: str) -> Column:
    return _flag(F.array_contains(ids.cast("array<string>"), rule_id))


# ---- request structure -----------------------------------------------------


def uri_depth(uri: Column) -> Column:
    uri = url.cleaned(uri)
    segments = F.filter(F.split(url.path_of(uri), "/"), lambda s: s != "")
    return F.when(_splittable(uri), F.size(segments)).otherwise(0).cast("double")


def _splittable(uri: Column) -> Column:
    """False for an authority with one unbalanced square bracket, which has no parts."""
    authority = url.authority_of(uri)
    return authority.contains("[") == authority.contains("]")


def query_param_count(uri: Column) -> Column:
    uri = url.cleaned(uri)
    keys = F.transform(url.pieces_of(url.query_of(uri)), url.key_of)
    return F.when(_splittable(uri), F.size(F.array_distinct(keys))).otherwise(0).cast("double")


def content_type_code(headers: Column) -> Column:
    """Code of the media type in a header map; -2 when absent, -1 when unknown."""
    value = F.when(
        F.map_contains_key(headers, "Content-Type"), F.element_at(headers, "Content-Type")
    ).otherwise(F.element_at(headers, "content-type"))
    return _media_type_code(value)


def _media_type_code(value: Column) -> Column:
    base = F.lower(F.trim(F.substring_index(value, ";", 1)))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(-2.0)).otherwise(
        _lookup(CONTENT_TYPE_CODES, base, -1)
    )


def content_type_code_raw(headers: Column) -> Column:
    """The same for a raw header block: the first ``content-type`` line counts."""
    value = F.regexp_extract(headers, r"(?im)^[ \t]*content-type[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    return _media_type_code(value)


def header_count(headers: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(headers)), F.lit(0)).cast("double")


def header_count_raw(headers: Column) -> Column:
    lines = F.split(text(headers), r"\r\n|\n|\r")
    return F.size(F.filter(lines, lambda line: line.contains(":"))).cast("double")


def structure_columns(method: Column, uri: Column, headers: Column, body: Column) -> dict[str, Column]:
    u, b = text(uri), text(body)
    return {
        "method_int": _lookup(METHOD_CODES, F.upper(text(method)), -1),
        "uri_length": F.char_length(u).cast("double"),
        "uri_depth": uri_depth(u),
        "query_param_count": query_param_count(u),
        "body_length": F.char_length(b).cast("double"),
        "has_body": _flag(b != ""),
        "content_type_int": content_type_code(headers),
        "header_count": header_count(headers),
    }


# ---- payload statistics ----------------------------------------------------


def special_char_ratio(t: Column) -> Column:
    return F.when(t == "", F.lit(0.0)).otherwise(F.regexp_count(t, F.lit(f"[{SPECIAL_CHARS}]")) / F.char_length(t))


def _entropy_of(value: str | None) -> float | None:
    if value is None:
        return None
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if codes.size == 0:
        return 0.0
    if codes.max() < COUNTED:  # no sort; the same counts in the same order
        counts = np.bincount(codes)
        counts = counts[counts > 0]
    else:
        counts = np.unique(codes, return_counts=True)[1]
    p = counts / codes.size
    return float(-(p * np.log2(p)).sum())


def _short_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each character of a short text occurs, by first appearance, and how many differ in each text.

    The characters of all texts are sorted and counted together, not text by text.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    rows = np.repeat(np.arange(len(texts)), lengths)
    places = np.arange(codes.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = np.sort((((rows << CODE_BITS) | codes) << PLACE_BITS) | places)
    starts = np.flatnonzero(np.diff(keys >> PLACE_BITS, prepend=-1))
    rows, first = keys[starts] >> (CODE_BITS + PLACE_BITS), keys[starts] & ((1 << PLACE_BITS) - 1)
    order = np.argsort((rows << PLACE_BITS) | first)
    return np.diff(starts, append=keys.size)[order], np.bincount(rows, minlength=len(texts))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _counts_arrow(values: pa.Array) -> pa.Array:
    texts = [v or "" for v in values.to_pylist()]
    parts = [_short_counts(texts[i : i + SHORT_TEXTS]) for i in range(0, len(texts), SHORT_TEXTS)]
    counts, sizes = (np.concatenate([np.zeros(1, dtype=np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(1), np.zeros(1))
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(counts[1:].astype(np.int32)), mask=values.is_null())


@F.pandas_udf(T.DoubleType())
def _entropy_arrow(values: pd.Series) -> pd.Series:
    return values.map(_entropy_of).astype("float64")


def shannon_entropy(t: Column) -> Column:
    """Bits per character; characters are counted in Python as Arrow batches, those of short texts many texts at a time."""
    is_long = F.char_length(t) > LONG_TEXT
    counted = F.struct(_counts_arrow(F.when(~is_long, t)).alias("counts"), F.char_length(t).alias("n"))

    def short(s: Column) -> Column:
        shares = F.transform(s["counts"], lambda k: k / s["n"])
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.when(is_long, _entropy_arrow(F.when(is_long, t))).otherwise(let(counted, short))


def max_param_value_length(uri: Column, body: Column) -> Column:
    """Longest decoded value over the query and the form body."""

    def longest(source: Column) -> Column:
        lengths = F.transform(url.pieces_of(source), lambda p: F.char_length(url.value_of(p)))
        return F.coalesce(F.array_max(lengths), F.lit(0))

    uri = url.cleaned(uri)
    in_query = F.when(_splittable(uri), longest(url.query_of(uri))).otherwise(0)
    # A body without "=" holds only blank values, whose length is zero.
    in_body = F.when(body.contains("="), longest(body)).otherwise(0)
    return F.greatest(in_query, in_body).cast("double")


def non_printable_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"[\x00-\x1f\x7f]")).cast("double")


def payload_columns(uri: Column, body: Column) -> dict[str, Column]:
    u, b = text(uri), text(body)
    both = F.concat(u, b)
    return {
        "special_char_ratio": special_char_ratio(both),
        "shannon_entropy": shannon_entropy(both),
        "max_param_value_length": max_param_value_length(u, b),
        "has_encoding_artifacts": _flag(both.rlike(ENCODING_ARTIFACT)),
        "non_printable_count": non_printable_count(both),
    }


def with_features(
    df: DataFrame,
    ids: str = "fired_rule_ids",
    severities: str = "rule_severities",
    messages: str = "rule_messages",
    score: str = "anomaly_score",
    threshold: str | None = None,
) -> DataFrame:
    """Add all contract features to an enriched request table."""
    limit = F.col(threshold) if threshold else F.lit(0.0)
    details = rule_details(F.col(ids), F.col(severities), F.col(messages))
    request = [F.col(c) for c in ("method", "uri", "headers", "body")]
    columns = rule_columns(F.col("_details"), F.col("_texts"))
    columns |= score_columns(F.col(score), limit)
    columns |= structure_columns(*request)
    columns |= payload_columns(request[1], request[3])
    described = df.withColumn("_details", details).withColumn("_texts", rule_texts(F.col("_details")))
    return described.withColumns(columns).drop("_details", "_texts")


# ---- shape features for requests without rule evidence ------------------------

# Token lists of the shape features.
SHAPE_METHODS = ["get", "post", "put", "delete", "patch", "head"]
SCRIPT_EXTENSIONS = [".php", ".jsp", ".asp", ".py", ".sh"]
SENSITIVE_KEYS = ["id", "page", "file", "path", "url", "redirect"]
BODY_TOKENS = {
    "body_xss": ["<script", "javascript:", "onerror", "onload"],
    "body_sql": ["select", "union", "insert", "delete", "drop", "--", "' or '", "1=1"],
    "body_php": ["<?php", "system(", "exec("],
    "body_xxe": ["<!entity", "<!doctype", "file:///"],
    "body_jndi": ["${jndi:"],
    "body_template": ["{{", "${"],
    "body_prototype": ["__proto__", "constructor.prototype"],
    "body_nosql": ["$gt", "$lt", "$ne", "$where", "$regex"],
}
SCANNER_AGENTS = ["nikto", "sqlmap", "dirbuster", "gobuster", "nmap"]
TOOL_AGENTS = ["powershell", "curl", "wget"]
URI_SPECIALS = "'<>`\"|;$&"
SEQUENCE_LENGTH = 256


def _any_of(t: Column, tokens: list[str]) -> Column:
    found = t.contains(tokens[0])
    for token in tokens[1:]:
        found = found | t.contains(token)
    return _flag(found)


def method_one_hot(method: Column) -> dict[str, Column]:
    return {f"method_{m}": _flag(F.lower(text(method)) == m) for m in SHAPE_METHODS}


def path_shape(uri: Column) -> dict[str, Column]:
    path = F.lower(url.path_of(text(uri)))
    return {
        "path_length": F.char_length(path).cast("double"),
        "path_slashes": (F.char_length(path) - F.char_length(F.translate(path, "/", ""))).cast("double"),
        "path_traversal": _any_of(path, ["..", "%2e%2e"]),
        "path_script": _any_of(path, SCRIPT_EXTENSIONS),
        "path_login": _any_of(path, ["admin", "login", "auth"]),
        "path_api": _any_of(path, ["api"]),
        "path_rest": _any_of(path, ["rest"]),
        "path_digits": _flag(path.rlike(r"\d")),
    }


def query_shape(uri: Column) -> dict[str, Column]:
    pairs = url.first_values(url.param_pairs(url.query_of(text(uri)), keep_blank=False))
    shape = let(
        pairs,
        lambda ps: F.struct(
            F.size(ps).cast("double").alias("n"),
            F.aggregate(ps, F.lit(0), lambda acc, p: acc + F.char_length(p["v"])).cast("double").alias("length"),
            _flag(F.exists(ps, lambda p: F.lower(p["k"]).isin(SENSITIVE_KEYS))).alias("sensitive"),
        ),
    )
    return {"query_keys": shape["n"], "query_value_length": shape["length"], "query_sensitive": shape["sensitive"]}


def body_shape(body: Column) -> dict[str, Column]:
    b = text(body)
    low = F.lower(b)
    out = {"shape_body_length": F.char_length(b).cast("double")}
    for name, tokens in BODY_TOKENS.items():
        out[name] = _any_of(b if name == "body_template" else low, tokens)
    return out


def header_shape(headers: Column) -> dict[str, Column]:
    agent = F.lower(text(F.element_at(headers, "user-agent")))
    media = F.lower(text(F.element_at(headers, "content-type")))
    return {
        "agent_scanner": _any_of(agent, SCANNER_AGENTS),
        "agent_tool": _any_of(agent, TOOL_AGENTS),
        "type_xml": _any_of(media, ["xml"]),
        "type_json": _any_of(media, ["json"]),
    }


def uri_specials(uri: Column) -> dict[str, Column]:
    u = text(uri)
    n = F.char_length(u) - F.char_length(F.translate(u, URI_SPECIALS, ""))
    return {"uri_specials": n.cast("double"), "uri_many_specials": _flag(n > 3)}


def char_codes(uri: Column, body: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Code points of the first characters of URI and body, zero padded to a fixed length."""
    head = F.substring(F.concat(text(uri), text(body)), 1, length)
    codes = F.when(
        head != "", F.transform(F.split(head, ""), lambda c: F.ascii(c))
    ).otherwise(F.array().cast("array<int>"))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), length)), 1, length)
