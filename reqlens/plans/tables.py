"""Tables the queries read, and the request, alert, access and score views over them.

Each view exists twice: as a DataFrame and as the SQL common table expression the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.operators.rules import scan_rules
from reqlens.session import prepare, spread
from reqlens.sources.logs import follow_table

#: Documents or pages that a task gets at most, as a text of some thousand characters costs as much as many events.
TEXTS_A_TASK = 4_000
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(key: Column, values: list[str | None]) -> Column:
    """Value by key modulo; null entries stand for absent."""
    out = F
    for i, v in enumerate(values):
        out = out.when(F.pmod(key, F.lit(len(values))) == i, F.lit(v).cast("string"))
    return out.otherwise(F.lit(None).cast("string"))


def _cycle_sql(key: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}"
        for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {arms} END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; the pattern matches the one file."""
    return follow_table(prepare(spark), f"{sf_dir}/events.parque[t]", EVENTS_SCHEMA)


# ---- requests ----------------------------------------------------------------

TYPES = [
    "application/json", "application/x-www-form-urlencoded; charset=UTF-8", "multipart/form-data", "text/plain",
    "application/xml", None, "TEXT/HTML",
]
AGENTS = ["sqlmap/1.7", "curl/8.0", None, "Mozilla/5.0 (X11)", "${jndi:ldap://x}", "Browser"]
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE"]
EVENT_PREFIXES = [
    "/u/{u}?k={k}&q=%3Cb%3E+x&k={e}",
    "/admin/../etc/passwd?file=..%2F..%2Fetc%2Fpasswd&id={u}",
    "/api/v{u}//Items/?a=&b&=c&page={k}#frag",
    "/login.php?u=%27%20OR%20%271%27=%271&p=%zz%4&r=union+select",
    "http://h.example/rest/{u};s=1?redirect=http://localhost/x&%24where=1&t={{7}}",
]
EVENT_BODIES = [
    "data={p}&x=%7B%7B7*7%7D%7D",
    "<script>alert({e})</script>",
    "q=select+*+from+t&r=${jndi:ldap://x}&u=http://127.0.0.1/",
    "",
    "a=1|whoami&b=x\tonload=1&c=\\u0041\\x41",
]


def _fill(template: str) -> Column:
    holes = {"{u}": "user_id", "{k}": "_k", "{e}": "event_id", "{p}": "props"}
    out = F.lit(template)
    for hole, name in holes.items():
        if hole in template:
            out = F.replace(out, F.lit(hole), F.col(name).cast("string"))
    return out


def _fill_sql(template: str) -> str:
    quoted = "'" + template.replace("'", "''") + "'"
    holes = {"{u}": "user_id", "{k}": "regexp_extract(props, '[0-9]+', 0)", "{e}": "event_id", "{p}": "props"}
    for hole, expr in holes.items():
        if hole in template:
            quoted = f"replace({quoted}, '{hole}', CAST({expr} AS VARCHAR))"
    return quoted


def _choose(key: Column, cols: list[Column]) -> Column:
    out = F
    for i, c in enumerate(cols):
        out = out.when(F.pmod(key, F.lit(len(cols))) == i, c)
    return out.otherwise(F.lit(None).cast("string"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages fetched and submitted, documents submitted, and event traffic, as requests."""
    pages, docs = (spread(table(spark, sf_dir, n), TEXTS_A_TASK) for n in ("pages", "documents"))
    clicks = events(spark, sf_dir)
    target = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    none = F.lit(None).cast("string")

    def shape(df: DataFrame, rid: Column, method: Column, uri: Column, body: Column, media: Column, agent: Column,
              host: Column, attack: Column, family: Column) -> DataFrame:
        headers = F.map_filter(
            F.create_map(F.lit("Content-Type"), media, F.lit("user-agent"), agent, F.lit("Host"), host),
            lambda _, v: v.isNotNull(),
        )
        return df.select(
            rid.alias("request_id"), method.alias("method"), uri.alias("uri"), headers.alias("headers"),
            body.alias("body"), attack.alias("label"), family.alias("attack_family"),
        )

    def label(bad: Column) -> Column:
        return F.when(bad, "attack").otherwise("benign")

    pid, did, eid = F.col("page_id"), F.col("doc_id"), F.col("event_id")
    fetched = shape(pages, F.concat(F.lit("p"), pid), F.lit("GET"), target, F.lit(""), none,
                    F.concat(F.lit("Browser/"), F.pmod(pid, F.lit(9))), host, F.lit("benign"), F.lit("benign"))
    sent = shape(pages, F.concat(F.lit("h"), pid), F.lit("PUT"), target, F.col("html"), F.lit("text/html"), none, host,
                 label(F.pmod(pid, F.lit(4)) == 0), F.lit("page"))
    posted = shape(docs, F.concat(F.lit("d"), did), F.lit("POST"), F.lit("/submit"), F.col("text"),
                   _cycle(did, TYPES), _cycle(did, AGENTS), none, label(F.pmod(did, F.lit(5)) == 0), F.col("lang"))
    numbered = clicks.withColumn("_k", F.regexp_extract("props", "[0-9]+", 0))
    traffic = shape(numbered, F.concat(F.lit("e"), eid), _cycle(eid, METHODS),
                    _choose(eid, [_fill(t) for t in EVENT_PREFIXES]),
                    F.when(F.pmod(eid, F.lit(8)).isin(1, 2, 4), _choose(eid, [_fill(b) for b in EVENT_BODIES]))
                    .otherwise(F.lit("")),
                    _cycle(eid, TYPES), _cycle(eid, AGENTS), none, label(F.pmod(eid, F.lit(5)) > 0),
                    F.col("event_type"))
    return fetched.unionByName(sent).unionByName(posted).unionByName(traffic)


def _case_sql(key: str, exprs: list[str]) -> str:
    return f"CASE {key} % {len(exprs)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs)) + " END"


_TARGET = r"regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', '')"
_HOST = r"regexp_extract(url, '://([^/?#]*)', 1)"
REQUESTS_SQL = f"""requests AS (
  SELECT 'p' || page_id AS request_id, 'GET' AS method, {_TARGET} AS uri, '' AS body,
    CAST(NULL AS VARCHAR) AS media, 'Browser/' || (page_id % 9) AS agent, {_HOST} AS host,
    'benign' AS label, 'benign' AS attack_family FROM pages
  UNION ALL SELECT 'h' || page_id, 'PUT', {_TARGET}, html, 'text/html', NULL, {_HOST},
    CASE WHEN page_id % 4 = 0 THEN 'attack' ELSE 'benign' END, 'page' FROM pages
  UNION ALL SELECT 'd' || doc_id, 'POST', '/submit', text, {_cycle_sql('doc_id', TYPES)},
    {_cycle_sql('doc_id', AGENTS)}, NULL, CASE WHEN doc_id % 5 = 0 THEN 'attack' ELSE 'benign' END, lang FROM documents
  UNION ALL SELECT 'e' || event_id, {_cycle_sql('event_id', METHODS)},
    {_case_sql('event_id', [_fill_sql(t) for t in EVENT_PREFIXES])},
    CASE WHEN event_id % 8 IN (1, 2, 4) THEN {_case_sql('event_id', [_fill_sql(b) for b in EVENT_BODIES])} ELSE '' END,
    {_cycle_sql('event_id', TYPES)}, {_cycle_sql('event_id', AGENTS)}, NULL,
    CASE WHEN event_id % 5 > 0 THEN 'attack' ELSE 'benign' END, event_type FROM events)"""

# Parts of a request target, as the engine splits them.
_REST = r"regexp_replace(uri, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?', '')"
PARTS_SQL = REQUESTS_SQL + rf""",
parts AS (SELECT *, regexp_replace(regexp_extract({_REST}, '^[^?#]*', 0), ';[^/]*$', '') AS path,
    regexp_extract({_REST}, '^[^?#]*\?([^#]*)', 1) AS query FROM requests)"""


def decode_sql(x: str) -> str:
    """Percent-decoding twin; the oracle's own decoder keeps malformed escapes and plus signs."""
    return f"url_decode(replace({x}, '+', ' '))"


def pairs_sql(query: str) -> str:
    """List of (k, v) structs of a query text."""
    k, v = decode_sql("split_part(x, '=', 1)"), decode_sql("regexp_replace(x, '^[^=]*(=|$)', '')")
    return (
        f"list_transform(list_filter(string_split({query}, '&'), lambda x: x <> ''), "
        f"lambda x: {{'k': {k}, 'v': {v}}})"
    )


# ---- alerts ------------------------------------------------------------------


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(events(spark, sf_dir))


def alerts_of(e: DataFrame) -> DataFrame:
    """Alert rows derived from events; also applies to a stream of events."""
    eid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")

    def rule(base: int, m: int) -> Column:
        return (F.lit(base) + F.pmod(eid, F.lit(m))).cast("string")

    every = F.array(rule(942000, 50), rule(941000, 30), rule(930000, 11), rule(990001, 26))
    rules = F.filter(every, lambda r, i: F.pmod(eid, i + 2) == 0)
    label = F.when(F.pmod(eid, F.lit(3)) == 0, "true_positive").when(F.pmod(eid, F.lit(3)) == 1, "false_positive")
    get = F.pmod(uid, F.lit(2)) == 0
    key = F.regexp_extract("props", "[0-9]+", 0)
    severity = ["CRITICAL", "warning", "NOTICE", "DEBUG"]
    texts = ["SQLi libinjection", "xss filter", "path LFI and rce", ""]
    return e.select(
        eid.alias("seq"),
        F.lpad(eid.cast("string"), 12, "0").alias("alert_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_raw"),
        F.concat(F.lit("10.0."), F.floor(uid / 256), F.lit("."), F.pmod(uid, F.lit(256))).alias("client_ip"),
        F.concat(F.lit("/u/"), uid, F.lit("?k="), key).alias("uri"),
        F.when(get, "GET").otherwise("POST").alias("method"),
        F.when(F.pmod(eid, F.lit(3)) == 0, "").otherwise(F.col("props")).alias("body"),
        F.floor(F.col("value") / 10).cast("double").alias("anomaly_score"),
        F.when(kind.isin("error", "purchase"), "coraza").when(kind == "signup", "ml_miss_detector")
        .otherwise("unknown").alias("source"),
        rules.alias("triggered_rules"),
        F.transform(rules, lambda r: F.element_at(F.array(*map(F.lit, severity)),
                                                  (F.pmod(r.cast("bigint"), F.lit(4)) + 1).cast("int"))
                    ).alias("rule_severities"),
        F.transform(rules, lambda r: F.element_at(F.array(*map(F.lit, texts)),
                                                  (F.pmod(r.cast("bigint"), F.lit(4)) + 1).cast("int"))
                    ).alias("rule_messages"),
        F.when(F.col("value") > 100, "P1").when(F.col("value") > 20, "P2").otherwise("P3").alias("ai_priority"),
        F.when(kind == "view", "unavailable").otherwise("enriched").alias("ai_status"),
        F.when(kind != "view", F.round(F.col("value") / (F.col("value") + 50), 4)).alias("ai_score"),
        label.alias("human_label"),
        F.when(label.isNotNull(), "reviewed").otherwise("generated").alias("status"),
        kind.alias("event_type"), uid.alias("user_id"), F.col("value"),
    )


ALERTS_SQL = """alerts AS (
  SELECT event_id AS seq, lpad(CAST(event_id AS VARCHAR), 12, '0') AS alert_key, ts,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_raw,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client_ip,
    '/u/' || user_id || '?k=' || regexp_extract(props, '[0-9]+', 0) AS uri,
    CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS body,
    CAST(floor(value / 10) AS DOUBLE) AS anomaly_score,
    CASE WHEN event_type IN ('error', 'purchase') THEN 'coraza' WHEN event_type = 'signup' THEN 'ml_miss_detector'
      ELSE 'unknown' END AS source,
    list_filter([CAST(942000 + event_id % 50 AS VARCHAR), CAST(941000 + event_id % 30 AS VARCHAR),
      CAST(930000 + event_id % 11 AS VARCHAR), CAST(990001 + event_id % 26 AS VARCHAR)],
      lambda r, i: event_id % (i + 1) = 0) AS triggered_rules,
    CASE WHEN value > 100 THEN 'P1' WHEN value > 20 THEN 'P2' ELSE 'P3' END AS ai_priority,
    CASE WHEN event_type = 'view' THEN 'unavailable' ELSE 'enriched' END AS ai_status,
    CASE WHEN event_type <> 'view' THEN round(value / (value + 50), 4) END AS ai_score,
    CASE event_id % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' END AS human_label,
    CASE WHEN event_id % 3 < 2 THEN 'reviewed' ELSE 'generated' END AS status,
    event_type, user_id, value, props FROM events)"""


# ---- access ------------------------------------------------------------------

STATUS_OF = {"view": 200, "click": 302, "purchase": 403, "signup": 404, "error": 500}


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_of(events(spark, sf_dir))


def access_of(rows: DataFrame) -> DataFrame:
    """Access-log rows derived from events; also applies to a stream of events."""
    status = F
    for kind, code in STATUS_OF.items():
        status = status.when(F.col("event_type") == kind, code)
    get = F.pmod("user_id", F.lit(2)) == 0
    return rows.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(get, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/u/"), F.col("user_id"), F.lit("?k="), F.regexp_extract("props", "[0-9]+", 0)).alias("uri"),
        F.concat(F.lit("/u/"), F.pmod("user_id", F.lit(10))).alias("endpoint"),
        F.col("props").alias("body"),
        status.cast("int").alias("http_status"),
        (F.col("value") / 1000).alias("duration"),
        F.col("user_id"),
    )


_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATUS_OF.items()) + " END"
ACCESS_SQL = f"""access AS (
  SELECT event_id AS seq, ts, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
    '/u/' || user_id || '?k=' || regexp_extract(props, '[0-9]+', 0) AS uri, '/u/' || (user_id % 10) AS endpoint,
    props AS body, {_STATUS_SQL} AS http_status, value / 1000 AS duration, user_id FROM events)"""


# ---- scores ------------------------------------------------------------------

MODELS = {"m1": 7919, "m2": 6101, "m3": 5003, "m4": 3001}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a quasi-random probability per model."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    per_model = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                (F.pmod(F.col("n_chars") * k + F.col("doc_id") * 104729, F.lit(1000)) / 1000.0).alias("p"),
            )
            for m, k in MODELS.items()
        ]
    )
    rows = docs.join(labels, "doc_id").withColumn("s", F.explode(per_model))
    return rows.select(
        "s.model", F.col("doc_id").alias("id"), F.col("lang").alias("family"), F.col("toxic").alias("y"), "s.p"
    )


_MODELS_SQL = ", ".join(f"('{m}', {k})" for m, k in MODELS.items())
SCORED_SQL = f"""scored AS (
  SELECT m.model, d.doc_id AS id, d.lang AS family, l.toxic AS y,
    ((d.n_chars * m.k + d.doc_id * 104729) % 1000) / 1000.0 AS p
  FROM documents d JOIN labels l USING (doc_id) CROSS JOIN (VALUES {_MODELS_SQL}) m(model, k))"""


# ---- labelled requests with rule evidence ----------------------------------------------


def enriched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the evidence of the custom rule scan, named as the feature step expects."""
    hits = scan_rules(requests(spark, sf_dir))
    return hits.select(
        "request_id", "method", "uri", "headers", "body", "label", "attack_family",
        F.col("rule_hits").alias("fired_rule_ids"),
        F.transform("rule_hits", lambda _: F.lit("CRITICAL")).alias("rule_severities"),
        F.transform("rule_hits", lambda r: F.concat(F.lit("custom "), r)).alias("rule_messages"),
        F.col("rule_score").alias("anomaly_score"),
    )
