"""Dataset gates, split, sampling, manifest, union, contract comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.contract import CONTRACT_VERSION, FEATURE_GROUPS
from reqlens.functions import features, parse
from reqlens.operators import joins, quality
from reqlens.plans import tables as t

FIELDS = ["request_id", "method", "uri", "headers", "body", "label", "attack_family"]


def _flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with missing fields, shared ids and conflicting labels."""
    r = t.requests(spark, sf_dir)
    n = F.length("uri") + F.length("body")
    shared = F.when(n % 50 == 0, F.concat(F.lit("shared-"), n % 7)).otherwise(F.col("request_id"))
    return r.withColumns(
        {"request_id": shared, "uri": F.when(n % 9 > 0, F.col("uri")), "label": F.when(n % 31 > 0, F.col("label"))}
    )


_FLAWED_SQL = f"""{t.REQUESTS_SQL}, x AS (SELECT *, length(uri) + length(body) AS n FROM requests),
flawed AS (SELECT CASE WHEN n % 50 = 0 THEN 'shared-' || (n % 7) ELSE request_id END AS request_id, method,
  CASE WHEN n % 9 > 0 THEN uri END AS uri, body, CASE WHEN n % 31 > 0 THEN label END AS label, attack_family, n FROM x)"""


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dataset gates count."""
    return quality.gate_counts(_flawed(spark, sf_dir), FIELDS)


GATE_COUNTS = f"""WITH {_FLAWED_SQL}, g AS (SELECT request_id, count(*) AS n, count(DISTINCT label) AS labels FROM flawed GROUP BY 1)
SELECT (SELECT count(*) FROM flawed) AS total, (SELECT count_if(uri IS NULL OR label IS NULL) FROM flawed) AS missing,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicates, count_if(labels > 1) AS conflicts FROM g"""


def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed gates with their messages."""
    return quality.run_gates(_flawed(spark, sf_dir), FIELDS)


GATE_FAILURES = f"""WITH {_FLAWED_SQL}, g AS (SELECT request_id, count(*) AS n, count(DISTINCT label) AS labels FROM flawed GROUP BY 1),
c AS ({GATE_COUNTS.split('GROUP BY 1)', 1)[1]}),
d AS (SELECT string_agg(request_id, ''', ''' ORDER BY request_id) AS s FROM (SELECT request_id FROM g WHERE n > 1 ORDER BY 1 LIMIT 10)),
k AS (SELECT string_agg(request_id, ''', ''' ORDER BY request_id) AS s FROM (SELECT request_id FROM g WHERE labels > 1 ORDER BY 1 LIMIT 10))
SELECT 'MISSING_FIELDS' AS gate, missing AS affected, printf('MISSING_FIELDS: %d/%d rows (%.1f%%) are missing required fields — threshold is 5%%',
  missing, total, missing / total * 100) AS message FROM c WHERE missing / total > 0.05
UNION ALL SELECT 'DUPLICATE_IDS', duplicates, printf('DUPLICATE_IDS: %d rows share duplicate request_id values (sample: [''%s''])', duplicates,
  (SELECT s FROM d)) FROM c WHERE duplicates > 0
UNION ALL SELECT 'LABEL_CONFLICTS', conflicts, printf('LABEL_CONFLICTS: %d request_id(s) have conflicting labels (sample: [''%s''])', conflicts,
  (SELECT s FROM k)) FROM c WHERE conflicts > 0"""


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids several rows share, and whether their labels differ."""
    d = quality.duplicate_ids(_flawed(spark, sf_dir))
    c = quality.label_conflicts(_flawed(spark, sf_dir)).select("request_id", F.lit(True).alias("conflict"))
    return d.join(c, "request_id", "left").na.fill(False, ["conflict"])


DUPLICATE_IDS = f"""WITH {_FLAWED_SQL} SELECT request_id, count(*) AS rows, count(DISTINCT label) > 1 AS conflict FROM flawed
GROUP BY 1 HAVING count(*) > 1"""


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of complete rows."""
    return quality.completeness(_flawed(spark, sf_dir), FIELDS)


COMPLETENESS = f"""WITH {_FLAWED_SQL} SELECT round(avg(CASE WHEN uri IS NULL OR label IS NULL THEN 0.0 ELSE 1.0 END) * 100, 4)
  AS feature_completeness_pct FROM flawed"""


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a few families of one or two rows."""
    r = t.requests(spark, sf_dir)
    rare = F.regexp_extract("request_id", "^d([0-9])$", 1)
    return r.withColumn(
        "attack_family", F.when(rare != "", F.concat(F.lit("rare-"), (rare.cast("int") / 2).cast("int"))).otherwise(F.col("attack_family"))
    )


_FAMILIES_SQL = f"""{t.REQUESTS_SQL}, fam AS (SELECT request_id, label, CASE WHEN regexp_matches(request_id, '^d[0-9]$')
  THEN 'rare-' || (CAST(substr(request_id, 2) AS INT) // 2) ELSE attack_family END AS attack_family FROM requests)"""


def small_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families below three rows."""
    return quality.small_families(_families(spark, sf_dir))


SMALL_FAMILIES = f"WITH {_FAMILIES_SQL} SELECT attack_family, count(*) AS rows FROM fam GROUP BY 1 HAVING count(*) < 3"


def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of every request, stratified by family."""
    return quality.stratified_split(_families(spark, sf_dir)).select("request_id", "attack_family", "split")


_SPLIT_SQL = f"""{_FAMILIES_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY attack_family) AS size FROM fam),
st AS (SELECT *, CASE WHEN size < 3 THEN 's' ELSE 'f' || attack_family END AS stratum, md5(request_id || '|42') AS h FROM sized),
rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, request_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM st),
ho AS (SELECT *, CASE WHEN n < 3 THEN n - 1 ELSE greatest((n * 3 + 9) // 10, 2) END AS held FROM rk),
split AS (SELECT *, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - CASE WHEN held < 2 THEN 0 ELSE (held + 1) // 2 END
  THEN 'validation' ELSE 'test' END AS split FROM ho)"""
DATASET_SPLIT = f"WITH {_SPLIT_SQL} SELECT request_id, attack_family, split FROM split"


def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split and label with subtotals."""
    return quality.split_distribution(quality.stratified_split(_families(spark, sf_dir)))


SPLIT_DISTRIBUTION = f"WITH {_SPLIT_SQL} SELECT split, label, count(*) AS rows FROM split GROUP BY ROLLUP (split, label)"


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest counts of the split dataset."""
    m = quality.manifest(quality.stratified_split(_families(spark, sf_dir)), FIELDS)
    return m.drop("content_hash", "created_at")


DATASET_MANIFEST = f"""WITH {_SPLIT_SQL} SELECT count(*) AS total_rows, {', '.join(
    f"count_if(split = '{s}') AS {s}_rows" for s in ('train', 'validation', 'test'))}, {', '.join(
    f"count_if(split = '{s}' AND label = '{v}') AS {s}_{v}" for s in ('train', 'validation', 'test') for v in ('attack', 'benign'))},
  round(100.0::DOUBLE, 4) AS feature_completeness_pct FROM split"""


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free content hash of the split dataset; row order and partitioning do not matter."""
    split = quality.stratified_split(_families(spark, sf_dir))
    return split.agg(quality.content_hash(split).cast("string").alias("content_hash"))


def family_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred purchases in seeded random order."""
    return quality.sample_per_family(t.requests(spark, sf_dir), "purchase", 300).select("request_id", "attack_family")


FAMILY_SAMPLE = f"""WITH {t.REQUESTS_SQL} SELECT request_id, attack_family FROM requests WHERE attack_family = 'purchase'
ORDER BY md5(request_id || '|42'), request_id LIMIT 300"""


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of all corpora: rows per family and label, labels as numbers."""
    from reqlens.plans.request_queries import FLOW_NAMES
    from reqlens.sources.files import flow_requests, sentence_requests, union_sources

    d = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("rid"), F.col("text").alias("Sentence"), (F.col("doc_id") % 2).alias("Label")
    )
    e = t.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("rid"), t._cycle(F.col("event_id"), FLOW_NAMES).alias("Label")
    )
    sentences, _ = sentence_requests(d, "xss", F.col("rid"))
    flows, _ = flow_requests(e, F.col("rid"))
    everything = union_sources([sentences, flows, t.requests(spark, sf_dir)])
    return everything.groupBy("attack_family", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(parse.is_attack(F.col("label"))).alias("attacks")
    )


SOURCE_COUNTS = f"""WITH {t.REQUESTS_SQL}, u AS (
  SELECT CASE WHEN doc_id % 2 = 1 THEN 'xss' ELSE 'benign' END AS attack_family, CASE WHEN doc_id % 2 = 1 THEN 'attack' ELSE 'benign' END
    AS label FROM documents WHERE trim(text) <> '' AND lower(trim(text)) <> 'nan'
  UNION ALL SELECT ['benign', 'ddos', 'dos', 'dos', 'heartbleed', 'portscan', 'bot', 'brute_force', 'brute_force', 'brute_force', 'sqli',
    'xss', 'infiltration', 'unknown_attack'][1 + event_id % 15], CASE WHEN event_id % 15 = 0 THEN 'benign' ELSE 'attack' END
    FROM events WHERE event_id % 15 < 14
  UNION ALL SELECT attack_family, label FROM requests)
SELECT attack_family, label, count(*) AS rows, count_if(label = 'attack') AS attacks FROM u GROUP BY ALL"""


# ---- contract ------------------------------------------------------------------------


def _observed(df: DataFrame, names: list[str], version: str) -> DataFrame:
    """Contract a feature table actually shows: observed ranges of its features."""
    columns = features.structure_columns(*[F.col(c) for c in ("method", "uri", "headers", "body")])
    ranges = [f(columns[n]).alias(f"{n}|{k}") for n in names for f, k in ((F.min, "lo"), (F.max, "hi"))]
    row = df.agg(*ranges)
    entries = F.array(
        *[
            F.struct(
                F.lit(version).alias("version"), F.lit(n).alias("feature"), F.lit("float64").alias("type"),
                F.lit(FEATURE_GROUPS[n]).alias("grp"), F.col(f"{n}|lo").alias("range_min"), F.col(f"{n}|hi").alias("range_max"),
            )
            for n in names
        ]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*")


def contract_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the contracts observed on documents and on event traffic."""
    r = t.requests(spark, sf_dir)
    train = _observed(r.where(F.col("request_id").startswith("d")), ["method_int", "uri_length", "has_body", "body_length"], CONTRACT_VERSION)
    serve = _observed(r.where(F.col("request_id").startswith("e")), ["method_int", "uri_length", "has_body", "uri_depth"], "1.0.1")
    return joins.contract_differences(train, serve).select("feature", "kind", "message")


CONTRACT_DIFFERENCES = f"""WITH {t.REQUESTS_SQL}, q AS (SELECT substr(request_id, 1, 1) AS o,
  CAST(CASE upper(method) WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'PATCH' THEN 4
    WHEN 'HEAD' THEN 5 WHEN 'OPTIONS' THEN 6 ELSE -1 END AS DOUBLE) AS m, CAST(length(uri) AS DOUBLE) AS u,
  CASE WHEN body <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM requests WHERE substr(request_id, 1, 1) IN ('d', 'e')),
c AS (SELECT o, min(m) AS m0, max(m) AS m1, min(u) AS u0, max(u) AS u1, min(b) AS b0, max(b) AS b1 FROM q GROUP BY o),
l AS (SELECT o, unnest([{{'f': 'method_int', 'a': m0, 'z': m1}}, {{'f': 'uri_length', 'a': u0, 'z': u1}}, {{'f': 'has_body', 'a': b0, 'z': b1}}]) AS s FROM c),
p AS (SELECT d.s.f AS f, d.s.a AS a1, d.s.z AS z1, e.s.a AS a2, e.s.z AS z2 FROM l d JOIN l e ON d.s.f = e.s.f AND d.o = 'd' AND e.o = 'e')
SELECT f AS feature, 'range' AS kind, 'Feature ''' || f || ''' range mismatch: training=[' || a1 || ', ' || z1 || '], serving=[' ||
  a2 || ', ' || z2 || '].' AS message FROM p WHERE a1 <> a2 OR z1 <> z2
UNION ALL SELECT f, 'version', 'Feature ''' || f || ''' version mismatch: training=1.0.0, serving=1.0.1.' FROM p
UNION ALL SELECT 'body_length', 'missing_in_serving', 'Feature ''body_length'' present in training schema but missing from serving schema.'
UNION ALL SELECT 'uri_depth', 'missing_in_training', 'Feature ''uri_depth'' present in serving schema but missing from training schema.'"""


def feature_name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules seen only on firewall alerts, only on others, and on both."""
    a = t.alerts(spark, sf_dir).select("event_type", F.explode("triggered_rules").alias("rule_id"))
    return joins.name_sets(a.where(F.col("event_type") == "error"), a.where(F.col("event_type") == "view"), "rule_id")


FEATURE_NAME_SETS = f"""WITH {t.ALERTS_SQL},
h AS (SELECT DISTINCT unnest(triggered_rules) AS r FROM alerts WHERE event_type = 'error'),
o AS (SELECT DISTINCT unnest(triggered_rules) AS r FROM alerts WHERE event_type = 'view')
SELECT r AS rule_id, 'training' AS side FROM h WHERE r NOT IN (SELECT r FROM o)
UNION ALL SELECT r, 'serving' FROM o WHERE r NOT IN (SELECT r FROM h)
UNION ALL SELECT r, 'both' FROM h WHERE r IN (SELECT r FROM o)"""

QUERIES = {
    "gate_counts": (gate_counts, GATE_COUNTS),
    "gate_failures": (gate_failures, GATE_FAILURES),
    "duplicate_ids": (duplicate_ids, DUPLICATE_IDS),
    "completeness": (completeness, COMPLETENESS),
    "small_families": (small_families, SMALL_FAMILIES),
    "dataset_split": (dataset_split, DATASET_SPLIT),
    "split_distribution": (split_distribution, SPLIT_DISTRIBUTION),
    "dataset_manifest": (dataset_manifest, DATASET_MANIFEST),
    "content_hash": (content_hash, None),
    "family_sample": (family_sample, FAMILY_SAMPLE),
    "source_counts": (source_counts, SOURCE_COUNTS),
    "contract_differences": (contract_differences, CONTRACT_DIFFERENCES),
    "feature_name_sets": (feature_name_sets, FEATURE_NAME_SETS),
}
