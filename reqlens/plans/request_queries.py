"""Request parsing, features, rule and signature scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.functions import curate, features, identity, parse, url, vectors
from reqlens.functions import timestamps as tm
from reqlens.operators import joins, rules, signature_scan, training
from reqlens.plans import tables as t
from reqlens.session import where_once


def _r6(df: DataFrame, keys: list[str], columns: dict) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(n) for n, c in columns.items()])


# ---- structure and payload ---------------------------------------------------


def request_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method, URI, body and header features of every request."""
    r = t.requests(spark, sf_dir)
    return _r6(r, ["request_id"], features.structure_columns(*[F.col(c) for c in ("method", "uri", "headers", "body")]))


REQUEST_STRUCTURE = f"""WITH {t.PARTS_SQL}
SELECT request_id,
  CAST(CASE upper(method) WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3
    WHEN 'PATCH' THEN 4 WHEN 'HEAD' THEN 5 WHEN 'OPTIONS' THEN 6 ELSE -1 END AS DOUBLE) AS method_int,
  CAST(length(uri) AS DOUBLE) AS uri_length,
  CAST(len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS DOUBLE) AS uri_depth,
  CAST(len(list_distinct(list_transform({t.pairs_sql('query')}, lambda p: p.k))) AS DOUBLE) AS query_param_count,
  CAST(length(body) AS DOUBLE) AS body_length,
  CASE WHEN body <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_body,
  CAST(CASE WHEN coalesce(media, '') = '' THEN -2 ELSE CASE lower(trim(split_part(media, ';', 1)))
    WHEN 'application/json' THEN 0 WHEN 'application/x-www-form-urlencoded' THEN 1 WHEN 'multipart/form-data' THEN 2
    WHEN 'text/plain' THEN 3 WHEN 'text/html' THEN 4 ELSE -1 END END AS DOUBLE) AS content_type_int,
  CAST((media IS NOT NULL)::INT + (agent IS NOT NULL)::INT + (host IS NOT NULL)::INT AS DOUBLE) AS header_count
FROM parts"""


def payload_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character statistics of URI and body of every request, whole texts included."""
    r = t.requests(spark, sf_dir)
    return _r6(r, ["request_id"], features.payload_columns(F.col("uri"), F.col("body")))


PAYLOAD_STATISTICS = f"""WITH {t.PARTS_SQL},
texts AS (SELECT *, uri || body AS txt FROM parts),
chars AS (SELECT request_id, unnest(string_split(txt, '')) AS ch FROM texts WHERE txt <> ''),
freq AS (SELECT request_id, ch, count(*) AS n FROM chars GROUP BY ALL),
entropy AS (SELECT request_id, -sum((n / tot) * log2(n / tot)) AS h
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY request_id) AS DOUBLE) AS tot FROM freq) GROUP BY request_id)
SELECT x.request_id,
  round(CASE WHEN txt = '' THEN 0 ELSE (length(txt) - length(translate(txt, '%''"<>{{}}', ''))) / CAST(length(txt) AS DOUBLE)
    END, 6) AS special_char_ratio,
  round(coalesce(h, 0), 6) AS shannon_entropy,
  CAST(greatest(coalesce(list_max(list_transform({t.pairs_sql('query')}, lambda p: length(p.v))), 0),
    coalesce(list_max(list_transform({t.pairs_sql('body')}, lambda p: length(p.v))), 0)) AS DOUBLE) AS max_param_value_length,
  CASE WHEN regexp_matches(txt, '%[0-9A-Fa-f]{{2}}|\\\\u[0-9A-Fa-f]{{4}}|\\\\x[0-9A-Fa-f]{{2}}') THEN 1.0::DOUBLE
    ELSE 0.0::DOUBLE END AS has_encoding_artifacts,
  CAST(length(txt) - length(regexp_replace(txt, '[\\x00-\\x1f\\x7f]', '', 'g')) AS DOUBLE) AS non_printable_count
FROM texts x LEFT JOIN entropy USING (request_id)"""


def request_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape features of method, path, query and special characters."""
    r = t.requests(spark, sf_dir)
    m, u = F.col("method"), F.col("uri")
    return _r6(
        r, ["request_id"],
        features.method_one_hot(m) | features.path_shape(u) | features.query_shape(u) | features.uri_specials(u),
    )


def _flag_sql(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {name}"


def _any_sql(x: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{tok.replace(chr(39), chr(39) * 2)}')" for tok in tokens) + ")"


_SPECIALS = "translate(uri, '''<>`\"|;$&', '')"
REQUEST_SHAPE = f"""WITH {t.PARTS_SQL},
low AS (SELECT *, lower(path) AS lp, list_filter({t.pairs_sql('query')}, lambda p: true) AS pairs_all,
  list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '(?s)^[^=]*=.')),
    lambda x: {{'k': {t.decode_sql("split_part(x, '=', 1)")},
      'v': {t.decode_sql("regexp_replace(x, '^[^=]*=', '')")}}}) AS nb FROM parts),
firsts AS (SELECT *, list_filter(nb, lambda p, i: list_position(list_transform(nb, lambda q: q.k), p.k) = i) AS fp FROM low)
SELECT request_id,
  {', '.join(_flag_sql(f"lower(method) = '{m}'", f"method_{m}") for m in features.SHAPE_METHODS)},
  CAST(length(lp) AS DOUBLE) AS path_length,
  CAST(length(lp) - length(replace(lp, '/', '')) AS DOUBLE) AS path_slashes,
  {_flag_sql(_any_sql('lp', ['..', '%2e%2e']), 'path_traversal')},
  {_flag_sql(_any_sql('lp', features.SCRIPT_EXTENSIONS), 'path_script')},
  {_flag_sql(_any_sql('lp', ['admin', 'login', 'auth']), 'path_login')},
  {_flag_sql(_any_sql('lp', ['api']), 'path_api')},
  {_flag_sql(_any_sql('lp', ['rest']), 'path_rest')},
  {_flag_sql("regexp_matches(lp, '[0-9]')", 'path_digits')},
  CAST(len(fp) AS DOUBLE) AS query_keys,
  CAST(coalesce(list_sum(list_transform(fp, lambda p: length(p.v))), 0) AS DOUBLE) AS query_value_length,
  {_flag_sql("len(list_filter(fp, lambda p: lower(p.k) IN ('id', 'page', 'file', 'path', 'url', 'redirect'))) > 0",
             'query_sensitive')},
  CAST(length(uri) - length({_SPECIALS}) AS DOUBLE) AS uri_specials,
  {_flag_sql(f"length(uri) - length({_SPECIALS}) > 3", 'uri_many_specials')}
FROM firsts"""


def body_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token flags of body and headers."""
    r = t.requests(spark, sf_dir)
    return _r6(
        r, ["request_id"], features.body_shape(F.col("body")) | features.header_shape(F.col("headers"))
    )


BODY_SHAPE = f"""WITH {t.REQUESTS_SQL}, low AS (SELECT *, lower(body) AS lb, lower(coalesce(agent, '')) AS ua FROM requests)
SELECT request_id, CAST(length(body) AS DOUBLE) AS shape_body_length,
  {', '.join(_flag_sql(_any_sql('body' if n == 'body_template' else 'lb', toks), n)
             for n, toks in features.BODY_TOKENS.items())},
  {_flag_sql(_any_sql('ua', features.SCANNER_AGENTS), 'agent_scanner')},
  {_flag_sql(_any_sql('ua', features.TOOL_AGENTS), 'agent_tool')},
  0.0::DOUBLE AS type_xml, 0.0::DOUBLE AS type_json
FROM low"""


def char_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 256 character codes of every request, as text."""
    r = t.requests(spark, sf_dir)
    codes = features.char_codes(F.col("uri"), F.col("body"))
    return r.select("request_id", F.array_join(codes.cast("array<string>"), ",").alias("codes"))


CHAR_CODES = f"""WITH {t.REQUESTS_SQL}
SELECT request_id, array_to_string(list_transform(range(1, 257), lambda i:
  CASE WHEN i <= length(uri || body) THEN unicode(substr(uri || body, i, 1)) ELSE 0 END), ',') AS codes FROM requests"""


# ---- rule features -----------------------------------------------------------


def rule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule family counts, severity sum and score features of every alert (threshold 5)."""
    a = t.alerts(spark, sf_dir)
    details = features.rule_details(*[F.col(c) for c in ("triggered_rules", "rule_severities", "rule_messages")])
    columns = features.rule_columns(F.col("d")) | features.score_columns(F.col("anomaly_score"), F.lit(5.0))
    return _r6(a.withColumn("d", details), ["alert_key"], columns)


_DETAILS = """, details AS (SELECT *, list_transform(triggered_rules, lambda r: {'id': r,
  'sev': ['CRITICAL', 'warning', 'NOTICE', 'DEBUG'][1 + r::BIGINT % 4],
  'msg': lower(['SQLi libinjection', 'xss filter', 'path LFI and rce', ''][1 + r::BIGINT % 4])}) AS d FROM alerts)"""


def _family_sql(family: str, number: str) -> str:
    test = " OR ".join(f"contains({x}, '{v}')" for x in ("r.id", "r.msg") for v in (family, number))
    return f"CAST(len(list_filter(d, lambda r: {test})) AS DOUBLE) AS num_{family}_rules"


RULE_FEATURES = f"""WITH {t.ALERTS_SQL}{_DETAILS}
SELECT alert_key, {', '.join(_family_sql(f, n) for f, n in features.RULE_FAMILIES.items())},
  CAST(coalesce(list_sum(list_transform(d, lambda r: CASE upper(r.sev) WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2
    WHEN 'NOTICE' THEN 1 ELSE 0 END)), 0) AS DOUBLE) AS severity_weighted_sum,
  CAST(len(d) AS DOUBLE) AS total_rule_count,
  anomaly_score, round(anomaly_score / 5.0, 6) AS anomaly_score_normalized,
  CASE WHEN anomaly_score > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_above_threshold
FROM details"""


def rule_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rule ids in text order."""
    return training.rule_vocabulary(t.alerts(spark, sf_dir), "triggered_rules")


RULE_VOCABULARY = f"WITH {t.ALERTS_SQL} SELECT DISTINCT unnest(triggered_rules) AS rule_id FROM alerts"


def rule_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator columns of single rules."""
    a = t.alerts(spark, sf_dir)
    return a.select(
        "alert_key",
        *[features.rule_indicator(F.col("triggered_rules"), r).alias(f"rule_{r}") for r in ("942000", "941002", "930004")],
    )


RULE_INDICATORS = f"""WITH {t.ALERTS_SQL} SELECT alert_key, {', '.join(
    _flag_sql(f"list_contains(triggered_rules, '{r}')", f"rule_{r}") for r in ('942000', '941002', '930004'))} FROM alerts"""


def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and message the scorer sees for the last rule of every alert."""
    a = t.alerts(spark, sf_dir)
    details = features.rule_details(*[F.col(c) for c in ("triggered_rules", "rule_severities", "rule_messages")])
    rule = F.try_element_at(F.col("triggered_rules"), F.lit(-1))
    return a.withColumn("d", details).select(
        "alert_key", rule.alias("rule_id"),
        joins.rule_value(F.col("d"), rule, "severity").alias("severity"),
        joins.rule_value(F.col("d"), rule, "message").alias("message"),
    )


RULE_LOOKUP = f"""WITH {t.ALERTS_SQL}, r AS (SELECT alert_key, list_extract(triggered_rules, -1) AS rule_id FROM alerts)
SELECT alert_key, rule_id, ['CRITICAL', 'warning', 'NOTICE', 'DEBUG'][1 + rule_id::BIGINT % 4] AS severity,
  ['SQLi libinjection', 'xss filter', 'path LFI and rce', ''][1 + rule_id::BIGINT % 4] AS message FROM r"""


def rule_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts per vector label of every triggered rule, malformed ids included."""
    a = t.alerts(spark, sf_dir)
    rule = F.explode(F.concat(F.col("triggered_rules"), F.array(F.col("event_type"))))
    return (
        a.select(rule.alias("rule")).select(vectors.vector_of(F.col("rule")).alias("v"))
        .groupBy(F.col("v.key").alias("vector_key"), F.col("v.label").alias("vector"))
        .agg(F.count(F.lit(1)).alias("rules"))
    )


VECTOR_SQL = "CASE TRY_CAST(r AS BIGINT) // 1000 " + " ".join(
    f"WHEN {first // 1000} THEN {{'k': '{key}', 'l': '{label}'}}" for first, key, label in vectors.VECTOR_RANGES
) + " ELSE {'k': 'other', 'l': 'Other'} END"
RULE_VECTORS = f"""WITH {t.ALERTS_SQL}, x AS (SELECT unnest(list_append(triggered_rules, event_type)) AS r FROM alerts),
v AS (SELECT {VECTOR_SQL} AS v FROM x) SELECT v.k AS vector_key, v.l AS vector, count(*) AS rules FROM v GROUP BY ALL"""


# ---- scans -------------------------------------------------------------------


def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom rule hits and score of every request."""
    scanned = rules.scan_rules(t.requests(spark, sf_dir))
    return scanned.select("request_id", F.array_join("rule_hits", ",").alias("rule_hits"), "rule_score")


def _rule_sql(rule: rules.Rule) -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def one(target: str) -> str:
        if target in (rules.ARGS, rules.NAMES):
            item = "p.v" if target == rules.ARGS else "p.k"
            if rule.literal:
                return f"len(list_filter(pairs, lambda p: contains({item}, {quoted(rule.pattern)}))) > 0"
            return f"len(list_filter(pairs, lambda p: regexp_matches({item}, {quoted(rule.pattern)}))) > 0"
        column = {rules.URI: "uri", rules.BODY: "body", rules.AGENT: "coalesce(agent, '')",
                  rules.TYPE: "coalesce(media, '')"}[target]
        fn = "contains" if rule.literal else "regexp_matches"
        return f"{fn}({column}, {quoted(rule.pattern)})"

    return f"CASE WHEN {' OR '.join(one(x) for x in rule.targets)} THEN '{rule.id}' END"


RULE_SCAN = f"""WITH {t.PARTS_SQL},
args AS (SELECT *, list_concat({t.pairs_sql('query')}, {t.pairs_sql(
    "CASE WHEN contains(lower(coalesce(media, '')), 'application/x-www-form-urlencoded') THEN body ELSE '' END")}) AS pairs FROM parts),
hits AS (SELECT request_id, list_filter([{', '.join(_rule_sql(r) for r in rules.RULES)}], lambda h: h IS NOT NULL) AS h FROM args)
SELECT request_id, array_to_string(h, ',') AS rule_hits, CAST(len(h) * 5 AS DOUBLE) AS rule_score FROM hits"""


def signature_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures matching the text of every request, in catalog order."""
    r = rules.prefilter(t.requests(spark, sf_dir), rules.default_signatures())
    return r.select("request_id", F.array_join("matched_signatures", ",").alias("matched_signatures"))


def _signature_sql(rule: rules.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"CASE WHEN {'contains' if rule.literal else 'regexp_matches'}(txt, '{p}') THEN '{rule.id}' END"


SIGNATURE_PREFILTER = f"""WITH {t.REQUESTS_SQL},
texts AS (SELECT request_id, method || ' ' || uri || ' ' || body || coalesce(' ' || media, '') || coalesce(' ' || host, '')
  AS txt FROM requests)
SELECT request_id, array_to_string(list_filter([{', '.join(_signature_sql(r) for r in rules.RULES)}],
  lambda h: h IS NOT NULL), ',') AS matched_signatures FROM texts"""


def signature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with a signature for every known page path and for two forms in which a known user is addressed."""
    users = t.table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("n")).distinct()
    own = users.select(
        F.lit(0).alias("kind"), "n", F.concat(F.lit("user-"), "n").alias("id"),
        F.array(F.concat(F.lit("/u/"), "n", F.lit(r"\?k=\d+&")), F.concat(F.lit("(?i)/REST/"), "n", F.lit(r";S=\d"))).alias("patterns"))
    path = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    pages = t.table(spark, sf_dir, "pages").select(
        F.lit(1).alias("kind"), F.col("page_id").alias("n"), F.concat(F.lit("page-"), "page_id").alias("id"),
        F.array(F.concat(F.lit("(?i)"), F.regexp_replace(path, r"([^A-Za-z0-9/_])", r"\\$1"))).alias("patterns"))
    none = F.lit("").alias
    return own.unionByName(pages).orderBy("kind", "n").select(
        "id", none("name"), none("category"), none("severity"), "patterns", none("description"))


def signature_scan_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of a catalog that grows with pages and users, found in the text of every request by one automaton."""
    r = signature_scan.scan_catalog(t.requests(spark, sf_dir), signature_catalog(spark, sf_dir))
    return r.select("request_id", F.array_join("matched_signatures", ",").alias("matched_signatures"))


SIGNATURE_SCAN_MANY = f"""WITH {t.REQUESTS_SQL},
texts AS (SELECT request_id, method || ' ' || uri || ' ' || body || coalesce(' ' || media, '') || coalesce(' ' || host, '')
  AS txt FROM requests),
named AS (
  SELECT request_id, CAST(unnest(regexp_extract_all(txt, '/u/([0-9]+)\\?k=[0-9]+&', 1)) AS BIGINT) AS n FROM texts
  UNION SELECT request_id, CAST(unnest(regexp_extract_all(txt, '(?i)/rest/([0-9]+);s=[0-9]', 1)) AS BIGINT) FROM texts),
hits AS (
  SELECT DISTINCT request_id, 0 AS kind, n, 'user-' || n AS id FROM named WHERE n IN (SELECT user_id FROM events)
  UNION ALL
  SELECT request_id, 1, page_id, 'page-' || page_id FROM texts
  JOIN (SELECT page_id, lower({t._TARGET}) AS path FROM pages) ON contains(lower(txt), path))
SELECT request_id, coalesce(string_agg(id, ',' ORDER BY kind, n), '') AS matched_signatures
FROM texts LEFT JOIN hits USING (request_id) GROUP BY request_id"""


# ---- parsing -----------------------------------------------------------------


def query_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value of every query key of every request."""
    r = t.requests(spark, sf_dir).select("request_id", F.explode(parse.query_params(F.col("uri"))))
    return r.select("request_id", F.col("key").alias("name"), "value")


_BAD = "%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)"
QUERY_PARAMETERS = f"""WITH {t.PARTS_SQL},
ok AS (SELECT request_id, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT contains(x, ';')
    AND NOT regexp_matches(x, '{_BAD}')) AS xs FROM parts
  WHERE NOT regexp_matches(uri, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(path, '{_BAD}')),
p AS (SELECT request_id, list_transform(xs, lambda x: {{'k': {t.decode_sql("split_part(x, '=', 1)")},
  'v': {t.decode_sql("regexp_replace(x, '^[^=]*(=|$)', '')")}}}) AS ps FROM ok),
f AS (SELECT request_id, unnest(list_filter(ps, lambda q, i: list_position(list_transform(ps, lambda z: z.k), q.k) = i)) AS q
  FROM p)
SELECT request_id, q.k AS name, q.v AS value FROM f"""


def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and body-cache key of every request, and how many requests share the fingerprint's path."""
    r = t.requests(spark, sf_dir)
    ip = F.concat(F.lit("10."), F.length("uri") % 7, F.lit(".1."), F.length("body") % 200)
    path = identity.normalise_path(url.decode_path(url.path_of(F.col("uri"), drop_params=False)))
    return r.select(
        "request_id",
        path.alias("path"),
        identity.fingerprint(F.col("method"), F.col("uri"), F.col("body"), F.col("headers"), ip).alias("fingerprint"),
        identity.body_key(F.col("method"), F.col("uri")).alias("body_key"),
    )


_RAWPATH = rf"regexp_extract({t._REST}, '^[^?#]*', 0)"
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+"
REQUEST_FINGERPRINTS = f"""WITH {t.PARTS_SQL},
n AS (SELECT *, '/' || array_to_string(list_filter(string_split(lower(trim(url_decode({_RAWPATH}))), '/'),
    lambda s: s <> ''), '/') AS np,
  NOT regexp_matches(uri, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches({_RAWPATH}, '{_BAD}') AS ok FROM parts),
f AS (SELECT *, CASE WHEN ok THEN np ELSE '/' END AS fp,
  CASE WHEN ok AND NOT contains(query, ';') AND NOT regexp_matches(query, '{_BAD}') THEN
    array_to_string(list_sort(list_transform(list_distinct(list_transform({t.pairs_sql('query')}, lambda p: p.k)),
      lambda k: lower(trim(k)))), '&') ELSE '' END AS keys,
  trim(regexp_replace(body, '{_SPACE}', ' ', 'g')) AS nb, lower(trim(coalesce(agent, ''))) AS ua FROM n)
SELECT request_id, np AS path, sha256(upper(method) || '|' || fp || '|' || keys || '|' || sha256(nb) || '|' ||
    lower(trim(coalesce(media, ''))) || '|' || CASE WHEN strpos(ua, '/') > 1 THEN split_part(ua, '/', 1) ELSE ua END ||
    '|10.' || (length(uri) % 7) || '.1.0/24') AS fingerprint,
  substr(sha256(method || '|' || uri), 1, 16) AS body_key
FROM f"""


def alert_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-based key of every alert."""
    a = t.alerts(spark, sf_dir)
    headers = F.create_map(F.lit("X-B"), F.col("event_type"), F.lit("Host"), F.col("client_ip"))
    key = identity.alert_key(
        *[F.col(c) for c in ("method", "uri", "body", "client_ip", "timestamp_raw", "triggered_rules")], headers
    )
    return a.select("seq", key.alias("content_key"))


ALERT_IDENTITIES = f"""WITH {t.ALERTS_SQL}
SELECT seq, substr(sha256(method || '|' || uri || '|' || body || '|' || client_ip || '|' || timestamp_raw || '|' ||
  array_to_string(list_sort(triggered_rules), ',') || '|' ||
  substr(sha256('Host=' || client_ip || chr(10) || 'X-B=' || event_type || chr(10)), 1, 16)), 1, 16) AS content_key
FROM alerts"""


def audit_lines(events: DataFrame) -> DataFrame:
    """Audit log lines written from alert rows (also of a stream); every 97th is cut off."""
    a = t.alerts_of(events)
    seq = F.col("seq")
    stamp = F.when(seq % 2 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.col("timestamp_raw"))
    header = F.when(seq % 2 == 0, F.lit('"text/html"')).when(seq % 3 == 0, F.lit('["a/b", "c"]')).otherwise(F.lit("7"))
    hits = F.transform(
        F.concat("triggered_rules", F.slice("triggered_rules", 1, 1)),
        lambda r: F.concat(
            F.lit('{"message": "'), F.when(r.endswith("7"), "").otherwise(F.concat(F.lit("hit "), r)),
            F.lit('", "data": {"id": '), r, F.lit(', "severity": "CRITICAL"}}'),
        ),
    )
    total = F.concat(
        F.lit('{"message": "Inbound Anomaly Score Exceeded (Total Score: '),
        F.col("anomaly_score").cast("int").cast("string"), F.lit(')"}'),
    )
    messages = F.array_join(F.concat(F.array(total), hits), ", ")
    line = F.concat(
        F.lit('{"transaction": {"timestamp": "'), stamp, F.lit('", "client_ip": "'), F.col("client_ip"),
        F.lit('", "request": {"uri": "'), F.col("uri"), F.lit('", "method": "'), F.col("method"),
        F.lit('", "body": '), F.to_json(F.struct(F.col("body").alias("b"))).substr(F.lit(6), F.length("body") + 100),
        F.lit(', "headers": {"Content-Type": '), header, F.lit("}}}, \"messages\": ["), messages, F.lit("]}"),
    )
    body_json = F.regexp_replace(line, r'(?<="body": )("(?:[^"\\]|\\.)*")\}', "$1")
    return a.select("seq", F.when(seq % 97 == 0, F.substring(body_json, 1, 40)).otherwise(body_json).alias("value"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines parsed to alert fields; cut-off lines are marked."""
    p = parse.parse_audit(audit_lines(t.events(spark, sf_dir)), ingested_at=F.timestamp_seconds(F.lit(0)))
    good = F.col("_bad").isNull()

    def shown(c, name: str):
        return F.when(good, c).alias(name)

    return p.select(
        "seq", good.alias("good"),
        shown(F.col("timestamp_raw"), "timestamp_raw"),
        shown(F.date_format("time_bucket", tm.ISO_SECONDS), "time_bucket"),
        shown(F.col("client_ip"), "client_ip"),
        shown(F.col("uri"), "uri"),
        shown(F.col("method"), "method"),
        shown(F.col("body_length").cast("bigint"), "body_length"),
        shown(F.col("header_count").cast("bigint"), "header_count"),
        shown(F.element_at("headers", "Content-Type"), "media"),
        shown(F.element_at("query_params", "k"), "k"),
        shown(F.array_join("triggered_rules", ","), "triggered_rules"),
        shown(F.size("rule_details").cast("bigint"), "rule_details"),
        shown(F.col("anomaly_score"), "anomaly_score"),
    )


AUDIT_EVENTS = f"""WITH {t.ALERTS_SQL}, g AS (SELECT *, seq % 97 <> 0 AS good FROM alerts)
SELECT seq, good,
  CASE WHEN good THEN timestamp_raw END AS timestamp_raw,
  CASE WHEN good THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') END AS time_bucket,
  CASE WHEN good THEN client_ip END AS client_ip, CASE WHEN good THEN uri END AS uri, CASE WHEN good THEN method END AS method,
  CASE WHEN good THEN CAST(strlen(body) AS BIGINT) END AS body_length, CASE WHEN good THEN 1::BIGINT END AS header_count,
  CASE WHEN good AND seq % 2 = 0 THEN 'text/html' WHEN good AND seq % 3 = 0 THEN 'a/b' END AS media,
  CASE WHEN good THEN regexp_extract(uri, 'k=([0-9]+)', 1) END AS k,
  CASE WHEN good THEN array_to_string(list_filter(triggered_rules, lambda r: NOT suffix(r, '7')), ',') END AS triggered_rules,
  CASE WHEN good THEN CAST(len(triggered_rules) + least(len(triggered_rules), 1) AS BIGINT) END AS rule_details,
  CASE WHEN good THEN anomaly_score END AS anomaly_score
FROM g"""


def access_lines(events: DataFrame) -> DataFrame:
    """Access log lines written from access rows (also of a stream); every 89th is cut off."""
    a = t.access_of(events)
    none = F.lit(None).cast("string")
    event = F.struct(
        F.lit("info").alias("level"),
        (F.unix_micros("ts") / 1e6).alias("ts"),
        F.struct(
            F.lit("10.0.0.1").alias("client_ip"), F.col("method"), F.col("uri"),
            F.create_map(F.lit("Host"), F.array(F.lit("h1"), F.lit("h2"))).alias("headers"),
        ).alias("request"),
        F.col("duration"), F.col("http_status").alias("status"),
        F.when(F.col("seq") % 3 == 0, F.col("body")).otherwise(none).alias("request_body"),
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit("cap <script> "), F.col("body"))).otherwise(none).alias("captured_body"),
    )
    line = F.to_json(event)
    return a.select(
        "seq", F.when(F.col("seq") % 89 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value")
    )


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access lines parsed to request fields with outcome flags."""
    p = parse.parse_access(access_lines(t.events(spark, sf_dir)))
    return where_once(p, F.col("_bad").isNull()).select(
        "seq", "timestamp_raw", "method", "uri", "body", F.col("body_length").cast("bigint").alias("body_length"),
        F.element_at("headers", "Host").alias("host"), F.col("http_status").cast("bigint").alias("http_status"),
        parse.is_blocked(F.col("http_status")).alias("blocked"), parse.is_passed(F.col("http_status")).alias("passed"),
    )


ACCESS_EVENTS = f"""WITH {t.ACCESS_SQL}, c AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'cap <script> ' || body
  WHEN seq % 3 = 0 THEN body ELSE '' END AS cap FROM access WHERE seq % 89 <> 0)
SELECT seq, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_raw, method, uri,
  CASE WHEN cap <> '' THEN cap WHEN method = 'GET' THEN regexp_extract(uri, '[?](.*)', 1) ELSE '' END AS body,
  CAST(strlen(cap) AS BIGINT) AS body_length, 'h1' AS host, CAST(http_status AS BIGINT) AS http_status,
  http_status IN (403, 406, 500) AS blocked, http_status BETWEEN 200 AND 399 AS passed FROM c"""


def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit fields of replay entries in their alternative places, and outcomes read off the status."""
    from reqlens.schemas import REPLAY_ENTRY

    a = t.alerts(spark, sf_dir).join(t.access(spark, sf_dir).select("seq", "http_status"), "seq")
    seq = F.col("seq")
    rule = F.coalesce(F.try_element_at("triggered_rules", F.lit(1)), F.lit("0"))
    place = F.pmod(seq, F.lit(3))
    hit = (
        F.when(place == 0, F.concat(F.lit('{"rule_id": '), rule, F.lit(', "severity": "CRITICAL", "message": "m"}')))
        .when(place == 1, F.concat(F.lit('{"id": '), rule, F.lit(', "msg": "g"}')))
        .otherwise(F.concat(F.lit('{"rule": {"id": '), rule, F.lit(', "severity": "NOTICE", "msg": "n"}}')))
    )
    score = F.col("anomaly_score").cast("int").cast("string")
    line = (
        F.when(place == 0, F.concat(F.lit('{"transaction": {"uri": "/x", "messages": ['), hit,
                                    F.lit('], "producer": {"anomaly_score": '), score, F.lit("}}}")))
        .when(place == 1, F.concat(F.lit('{"transaction": {"messages": [], "matched_rules": ['), hit,
                                   F.lit('], "anomaly_score": '), score, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"uri": "/y", "messages": ['), hit, F.lit('], "anomaly_score": '), score, F.lit("}")))
    )
    entry = F.from_json(line, REPLAY_ENTRY, {"columnNameOfCorruptRecord": "_bad"})
    out = parse.audit_outcome(F.col("entry"))
    inferred = parse.inferred_outcome(F.col("http_status"))
    return a.withColumn("entry", entry).select(
        "seq",
        F.array_join(out["coraza_fired_rule_ids"].cast("array<string>"), ",").alias("rule_ids"),
        F.array_join(out["coraza_rule_severities"], ",").alias("severities"),
        F.array_join(out["coraza_rule_messages"], ",").alias("messages"),
        out["coraza_anomaly_score"].cast("bigint").alias("score"),
        parse.audit_entry_uri(F.col("entry")).alias("entry_uri"),
        inferred["coraza_matched"].alias("inferred_matched"),
        inferred["coraza_anomaly_score"].cast("bigint").alias("inferred_score"),
    )


REPLAY_OUTCOMES = f"""WITH {t.ALERTS_SQL}, x AS (SELECT seq, seq % 3 AS place, event_type,
  coalesce(list_extract(triggered_rules, 1), '0') AS rule, CAST(anomaly_score AS BIGINT) AS score FROM alerts)
SELECT seq, CASE WHEN rule = '0' AND place < 2 THEN '' ELSE rule END AS rule_ids,
  CASE place WHEN 0 THEN 'CRITICAL' WHEN 1 THEN '' ELSE 'NOTICE' END AS severities,
  CASE place WHEN 0 THEN 'm' WHEN 1 THEN 'g' ELSE 'n' END AS messages, score,
  CASE place WHEN 0 THEN '/x' WHEN 1 THEN '' ELSE '/y' END AS entry_uri,
  event_type = 'purchase' AS inferred_matched, CASE WHEN event_type = 'purchase' THEN 100 ELSE 0 END::BIGINT AS inferred_score
FROM x"""


def timestamp_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in every accepted form and a few others, parsed back; minute buckets besides."""
    e = t.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    form = F.pmod("event_id", F.lit(8))
    patterns = [
        "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
        "dd/MMM/yyyy:HH:mm:ss Z", "EEE, dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "dd.MM.yyyy",
    ]
    raw = F
    for i, p in enumerate(patterns):
        raw = raw.when(form == i, F.date_format("ts", p))
    e = e.withColumn("raw", raw)
    return e.select(
        "event_id", F.date_format(tm.parse_timestamp(F.col("raw")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"),
        tm.normalise_audit_time(F.col("raw"), F.col("ts")).alias("normalised"),
        F.date_format(tm.minute_bucket(F.col("raw"), F.timestamp_seconds(F.lit(0))), tm.ISO_SECONDS).alias("bucket"),
    )


TIMESTAMP_FORMS = """WITH e AS (SELECT event_id, event_id % 8 AS form, ts, date_trunc('second', ts) AS sec FROM events),
p AS (SELECT *, CASE form WHEN 1 THEN ts WHEN 6 THEN sec - INTERVAL 2 HOUR WHEN 7 THEN NULL ELSE sec END AS parsed,
  CASE form WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 4 THEN strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') WHEN 5 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000')
    WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') ELSE strftime(ts, '%d.%m.%Y') END AS normalised FROM e)
SELECT event_id, strftime(parsed, '%Y-%m-%d %H:%M:%S.%f') AS parsed, normalised,
  strftime(CASE WHEN form IN (0, 1, 6) THEN date_trunc('minute', parsed) ELSE TIMESTAMP '1970-01-01' END,
    '%Y-%m-%dT%H:%M:%SZ') AS bucket FROM p"""


# ---- curation ----------------------------------------------------------------

FLOW_NAMES = [
    "BENIGN", "DDoS", "DoS Hulk", "DoS slowloris", "Heartbleed", "PortScan", "Bot", "FTP-Patator", "SSH-Patator",
    "Web Attack � Brute Force", "Web Attack � Sql Injection", "Web Attack � XSS", "Infiltration", "Novel", " ",
]


def _h32_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT"


def flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network-flow rows read as labelled requests."""
    from reqlens.sources.files import flow_requests

    e = t.events(spark, sf_dir)
    rows = e.select(
        F.col("event_id").cast("string").alias("rid"), t._cycle(F.col("event_id"), FLOW_NAMES).alias(" Label"),
        (F.col("user_id") * 3).cast("string").alias(" Destination Port"),
        (F.col("value") * 10).cast("int").cast("string").alias("Max Packet Length"),
    )
    good, _ = flow_requests(rows, F.col("rid"))
    return good.select(
        "request_id", "method", "uri", "body", "label", "attack_family",
        F.element_at("headers", "Content-Type").alias("media"),
        F.length(F.element_at("headers", "Accept")).cast("bigint").alias("accept_length"),
        F.size("headers").cast("bigint").alias("headers"),
    )


_WRAP = _h32_sql("rid", 42) + " % 3"
_EP = "[" + ", ".join(f"{{'m': '{m}', 'u': '{u}'}}" for m, u in curate.REST_ENDPOINTS) + "]"
_UAS = "[" + ", ".join(f"'{x}'" for x in curate.FLOOD_URIS) + "]"
_BOTS = "[" + ", ".join(f"'{x}'" for x in curate.BOT_PAYLOADS) + "]"
FLOW_RECORDS = f"""WITH f AS (SELECT CAST(event_id AS VARCHAR) AS rid, event_id % 15 AS i, user_id * 3 AS port,
    CAST(trunc(round(value * 10, 6)) AS INTEGER) AS pkt FROM events WHERE event_id % 15 <> 14),
e AS (SELECT *, {_EP}[1 + {_h32_sql('rid', 44)} % 14] AS ep, CAST(1 + {_h32_sql('rid', 45)} % 199 AS VARCHAR) AS num,
  CASE i WHEN 10 THEN ''' OR ''1''=''1' ELSE '<script>alert(1)</script>' END AS pay, {_WRAP} AS w FROM f)
SELECT rid AS request_id,
  CASE WHEN i = 0 THEN ep.m WHEN i IN (1, 2, 4, 5, 13) THEN 'GET' WHEN i IN (10, 11) THEN CASE WHEN w = 1 THEN 'POST' ELSE 'GET' END
    ELSE 'POST' END AS method,
  CASE WHEN i = 0 THEN replace(ep.u, '{{id}}', num) WHEN i IN (1, 2, 13) THEN {_UAS}[1 + {_h32_sql('rid', 46)} % 5]
    WHEN i IN (3, 4) THEN '/' WHEN i = 5 THEN '/port-' || CASE port WHEN 0 THEN 80 ELSE port END WHEN i = 6 THEN '/api/exec'
    WHEN i = 7 THEN '/ftp/login' WHEN i = 8 THEN '/ssh/login' WHEN i = 9 THEN '/login' WHEN i = 12 THEN '/upload'
    ELSE CASE w WHEN 0 THEN '/search?q=' || pay WHEN 1 THEN '/submit' ELSE '/api/resource' END END AS uri,
  CASE WHEN i = 0 THEN CASE WHEN ep.m IN ('POST', 'PUT') THEN 'name=test&value=123' ELSE '' END
    WHEN i = 6 THEN {_BOTS}[1 + {_h32_sql('rid', 47)} % 5] WHEN i = 7 THEN 'username=admin&password=password123'
    WHEN i = 8 THEN 'username=root&password=toor' WHEN i = 9 THEN 'username=admin&password=admin'
    WHEN i = 12 THEN repeat('\\x00\\x01\\x02\\x03', 16) WHEN i IN (10, 11) AND w = 1 THEN 'data=' || pay ELSE '' END AS body,
  CASE WHEN i = 0 THEN 'benign' ELSE 'attack' END AS label,
  ['benign', 'ddos', 'dos', 'dos', 'heartbleed', 'portscan', 'bot', 'brute_force', 'brute_force', 'brute_force', 'sqli', 'xss',
    'infiltration', 'unknown_attack'][1 + i] AS attack_family,
  CASE WHEN i = 0 AND ep.m IN ('POST', 'PUT') THEN 'application/json' WHEN i IN (6, 7, 8, 9) OR (i IN (10, 11) AND w = 1)
    THEN 'application/x-www-form-urlencoded' WHEN i = 12 THEN 'application/octet-stream' END AS media,
  CAST(CASE WHEN i = 4 THEN least(CASE pkt WHEN 0 THEN 512 ELSE pkt END, 2048) ELSE 35 END AS BIGINT) AS accept_length,
  CAST(CASE WHEN i = 0 THEN CASE WHEN ep.m IN ('POST', 'PUT') THEN 4 ELSE 3 END WHEN i = 3 THEN 5
    WHEN i IN (6, 7, 8, 9, 12) THEN 4 WHEN i IN (10, 11) THEN CASE WHEN w = 0 THEN 3 ELSE 4 END ELSE 3 END AS BIGINT) AS headers
FROM e"""


def sentence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sentence rows with well-formed and malformed labels, wrapped as requests."""
    from reqlens.sources.files import sentence_requests

    d = t.table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("doc_id").cast("string").alias("rid"), F.col("text").alias("Sentence"),
        t._cycle(F.col("doc_id"), ["1", "0", " 1.0 ", "0.9", "x", "2", None, "nan"]).alias("Label"),
    )
    good, skipped = sentence_requests(rows, "sqli", F.col("rid"))
    kept = good.select(
        "request_id", F.lit("kept").alias("outcome"), "method", F.sha2("uri", 256).alias("uri_hash"),
        F.sha2("body", 256).alias("body_hash"), "label", "attack_family", F.element_at("headers", "User-Agent").alias("agent"),
        F.sha2(F.element_at("headers", "X-Custom-Input"), 256).alias("custom_hash"),
    )
    none = F.lit(None).cast("string")
    lost = skipped.select(
        F.col("rid").alias("request_id"), F.col("skip_reason").alias("outcome"),
        *[none.alias(c) for c in kept.columns[2:]],
    )
    return kept.unionByName(lost)


_AGENTS_SQL = "[" + ", ".join(f"'{x}'" for x in curate.USER_AGENTS) + "]"
SENTENCE_RECORDS = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS rid, trim(text, ' ') AS s, text, doc_id % 8 AS i,
  {_h32_sql('CAST(doc_id AS VARCHAR)', 42)} % 3 AS w, {_AGENTS_SQL}[1 + {_h32_sql('CAST(doc_id AS VARCHAR)', 43)} % 3] AS ua
  FROM documents),
k AS (SELECT *, CASE WHEN trim(s, ' ') = '' OR lower(trim(s, ' ')) = 'nan' THEN 'empty or null sentence'
  WHEN i IN (4, 6, 7) THEN 'malformed label' WHEN i = 5 THEN 'unexpected label' ELSE 'kept' END AS outcome FROM d)
SELECT rid AS request_id, outcome,
  CASE WHEN outcome = 'kept' THEN CASE w WHEN 1 THEN 'POST' ELSE 'GET' END END AS method,
  CASE WHEN outcome = 'kept' THEN sha256(CASE w WHEN 0 THEN '/search?q=' || s WHEN 1 THEN '/submit' ELSE '/api/resource' END) END
    AS uri_hash,
  CASE WHEN outcome = 'kept' THEN sha256(CASE w WHEN 1 THEN 'data=' || s ELSE '' END) END AS body_hash,
  CASE WHEN outcome = 'kept' THEN CASE WHEN i IN (0, 2) THEN 'attack' ELSE 'benign' END END AS label,
  CASE WHEN outcome = 'kept' THEN CASE WHEN i IN (0, 2) THEN 'sqli' ELSE 'benign' END END AS attack_family,
  CASE WHEN outcome = 'kept' THEN ua END AS agent,
  CASE WHEN outcome = 'kept' AND w = 2 THEN sha256(s) END AS custom_hash
FROM k"""


def full_request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as full-request rows with missing values here and there."""
    from reqlens.sources.files import full_requests

    p = t.table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    rows = p.select(
        F.concat(F.lit("p"), pid).alias("rid"),
        F.when(pid % 11 == 0, " ").otherwise("GET").alias("Method"),
        F.concat(F.col("url"), F.when(pid % 2 == 0, " HTTP/1.1").otherwise("")).alias("URL"),
        F.when(pid % 3 == 0, "Normal").when(pid % 13 == 0, None).otherwise("Anomalous").alias("classification"),
        F.when(pid % 4 == 0, "nan").otherwise("agent/1").alias("User-Agent"),
        F.when(pid % 5 == 0, None).otherwise(" sid=1 ").alias("cookie"),
        F.when(pid % 7 == 0, "a=1").alias("content"),
    )
    good, skipped = full_requests(rows, F.col("rid"))
    kept = good.select(
        "request_id", F.lit("kept").alias("outcome"), "method", "uri", "body", "label", "attack_family",
        F.element_at("headers", "User-Agent").alias("agent"), F.element_at("headers", "Cookie").alias("cookie"),
    )
    none = F.lit(None).cast("string")
    return kept.unionByName(
        skipped.select(F.col("rid").alias("request_id"), F.col("skip_reason").alias("outcome"),
                       *[none.alias(c) for c in kept.columns[2:]])
    )


FULL_REQUEST_RECORDS = """WITH x AS (SELECT *, 'p' || page_id AS rid,
  regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^[^?#]*', 0) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q,
  CASE WHEN page_id % 11 = 0 THEN 'missing Method' WHEN page_id % 3 <> 0 AND page_id % 13 = 0 THEN 'missing classification'
    ELSE 'kept' END AS outcome FROM pages)
SELECT rid AS request_id, outcome, CASE WHEN outcome = 'kept' THEN 'GET' END AS method,
  CASE WHEN outcome = 'kept' THEN CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS uri,
  CASE WHEN outcome = 'kept' THEN CASE WHEN page_id % 7 = 0 THEN 'a=1' ELSE '' END END AS body,
  CASE WHEN outcome = 'kept' THEN CASE WHEN page_id % 3 = 0 THEN 'benign' ELSE 'attack' END END AS label,
  CASE WHEN outcome = 'kept' THEN CASE WHEN page_id % 3 = 0 THEN 'benign' ELSE 'unknown_attack' END END AS attack_family,
  CASE WHEN outcome = 'kept' AND page_id % 4 <> 0 THEN 'agent/1' END AS agent,
  CASE WHEN outcome = 'kept' AND page_id % 5 <> 0 THEN 'sid=1' END AS cookie
FROM x"""

QUERIES = {
    "request_structure": (request_structure, REQUEST_STRUCTURE),
    "payload_statistics": (payload_statistics, PAYLOAD_STATISTICS),
    "request_shape": (request_shape, REQUEST_SHAPE),
    "body_shape": (body_shape, BODY_SHAPE),
    "char_codes": (char_codes, CHAR_CODES),
    "rule_features": (rule_features, RULE_FEATURES),
    "rule_vocabulary": (rule_vocabulary, RULE_VOCABULARY),
    "rule_indicators": (rule_indicators, RULE_INDICATORS),
    "rule_lookup": (rule_lookup, RULE_LOOKUP),
    "rule_vectors": (rule_vectors, RULE_VECTORS),
    "rule_scan": (rule_scan, RULE_SCAN),
    "signature_prefilter": (signature_prefilter, SIGNATURE_PREFILTER),
    "signature_scan_many": (signature_scan_many, SIGNATURE_SCAN_MANY),
    "query_parameters": (query_parameters, QUERY_PARAMETERS),
    "request_fingerprints": (request_fingerprints, REQUEST_FINGERPRINTS),
    "alert_identities": (alert_identities, ALERT_IDENTITIES),
    "audit_events": (audit_events, AUDIT_EVENTS),
    "access_events": (access_events, ACCESS_EVENTS),
    "replay_outcomes": (replay_outcomes, REPLAY_OUTCOMES),
    "timestamp_forms": (timestamp_forms, TIMESTAMP_FORMS),
    "flow_records": (flow_records, FLOW_RECORDS),
    "sentence_records": (sentence_records, SENTENCE_RECORDS),
    "full_request_records": (full_request_records, FULL_REQUEST_RECORDS),
}
