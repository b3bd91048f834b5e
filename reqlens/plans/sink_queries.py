"""Scans and sinks: tables written out by Spark in each format and read back through the sources."""

from __future__ import annotations

import os
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.operators import joins, quality, rules, views
from reqlens.plans import alert_queries as aq
from reqlens.plans import dataset_queries as dq
from reqlens.plans import request_queries as rq
from reqlens.plans import tables as t
from reqlens.schemas import SIGNATURE
from reqlens.session import scratch_path
from reqlens.sources import files, follow
from reqlens.sources.signatures import load_signatures
from reqlens.sources.store import KeyedStore
from reqlens.streaming import flows


def json_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank and malformed ones: good rows per type, and what was kept apart."""
    e = t.table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "event_type", "user_id"))
    cut = F.when(F.col("event_id") % 13 == 0, F.substring(line, 1, 20)).when(F.col("event_id") % 17 == 0, "  ").otherwise(line)
    path = scratch_path(spark, "json-lines")
    files.write_lines(e.select(cut.alias("value")), path)
    good, bad = files.read_json_lines(spark, path, "event_id bigint, event_type string, user_id bigint")
    counted = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("id_sum"))
    apart = bad.agg(F.lit("(malformed)").alias("event_type"), F.count(F.lit(1)).alias("rows"),
                    F.lit(None).cast("bigint").alias("id_sum"))
    return counted.unionByName(apart)


JSON_LINE_SCAN = """SELECT event_type, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events
WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1
UNION ALL SELECT '(malformed)', count(*), NULL FROM events WHERE event_id % 13 = 0"""


def sentence_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a Sentence, Label file and read as labelled requests."""
    d = t.table(spark, sf_dir, "documents")
    path = scratch_path(spark, "sentences")
    label = t._cycle(F.col("doc_id"), ["1", "0", "x", "2"])
    d.select(F.col("text").alias("Sentence"), label.alias("Label")).write.options(header=True, escape='"').csv(path)
    good, skipped = files.sentence_requests(files.read_csv(spark, path), "sqli")
    kept = good.groupBy(F.col("label").alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
    lost = skipped.groupBy(F.col("skip_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
    return kept.unionByName(lost)


SENTENCE_CSV_SCAN = """WITH o AS (SELECT CASE WHEN trim(text) = '' OR lower(trim(text)) = 'nan' THEN 'empty or null sentence' ELSE
  ['attack', 'benign', 'malformed label', 'unexpected label'][1 + doc_id % 4] END AS outcome FROM documents)
SELECT outcome, count(*) AS rows FROM o GROUP BY 1"""


def flow_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records written as CSV with blank-led headers and read as labelled requests."""
    e = t.table(spark, sf_dir, "events")
    path = scratch_path(spark, "flows")
    e.select(
        t._cycle(F.col("event_id"), rq.FLOW_NAMES).alias(" Label"), (F.col("user_id") * 3).alias(" Destination Port"),
        F.lit("7").alias("Max Packet Length"),
    ).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    good, skipped = files.flow_requests(files.read_csv(spark, path))
    kept = good.groupBy("label", "attack_family").agg(F.count(F.lit(1)).alias("rows"))
    lost = skipped.agg(F.lit("skipped").alias("label"), F.lit("").alias("attack_family"), F.count(F.lit(1)).alias("rows"))
    return kept.unionByName(lost)


FLOW_CSV_SCAN = """WITH f AS (SELECT CASE WHEN event_id % 15 = 0 THEN 'benign' WHEN event_id % 15 = 14 THEN 'skipped' ELSE 'attack' END AS label,
  ['benign', 'ddos', 'dos', 'dos', 'heartbleed', 'portscan', 'bot', 'brute_force', 'brute_force', 'brute_force', 'sqli', 'xss', 'infiltration',
   'unknown_attack', ''][1 + event_id % 15] AS attack_family FROM events)
SELECT label, attack_family, count(*) AS rows FROM f GROUP BY ALL"""


def full_request_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as full-request CSV and read back."""
    p = t.table(spark, sf_dir, "pages")
    path = scratch_path(spark, "full")
    p.select(
        F.lit("GET").alias("Method"), F.concat("url", F.lit(" HTTP/1.1")).alias("URL"),
        F.when(F.col("page_id") % 3 == 0, "Normal").otherwise("Anomalous").alias("classification"),
        F.col("html").alias("content"),
    ).write.options(header=True, escape='"').csv(path)
    good, _ = files.full_requests(files.read_csv(spark, path))
    return good.groupBy("label", "attack_family").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("uri").alias("uris"))


FULL_REQUEST_CSV_SCAN = """SELECT CASE WHEN page_id % 3 = 0 THEN 'benign' ELSE 'attack' END AS label,
  CASE WHEN page_id % 3 = 0 THEN 'benign' ELSE 'unknown_attack' END AS attack_family, count(*) AS rows,
  count(DISTINCT regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^[^#]*', 0)) AS uris FROM pages GROUP BY ALL"""


def labelled_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled requests written as JSON per label and read back."""
    path = scratch_path(spark, "labelled")
    files.write_labelled(t.requests(spark, sf_dir), path)
    back = files.read_labelled(spark, path)
    return back.groupBy("label", "attack_family").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("uri")).alias("uri_chars"), F.sum(F.length("body")).alias("body_chars")
    )


LABELLED_JSON = f"""WITH {t.REQUESTS_SQL} SELECT label, attack_family, count(*) AS rows, CAST(sum(length(uri)) AS BIGINT) AS uri_chars,
  CAST(sum(length(body)) AS BIGINT) AS body_chars FROM requests GROUP BY ALL"""


def split_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split dataset written as Parquet per split; the test split read back alone."""
    path = scratch_path(spark, "splits")
    files.write_splits(quality.stratified_split(dq._families(spark, sf_dir)), path)
    return files.read_split(spark, path, "test").groupBy("split", "attack_family", "label").agg(F.count(F.lit(1)).alias("rows"))


SPLIT_PARQUET = f"WITH {dq._SPLIT_SQL} SELECT split, attack_family, label, count(*) AS rows FROM split WHERE split = 'test' GROUP BY ALL"


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows written as fully quoted CSV and read back."""
    path = scratch_path(spark, "report")
    files.write_report_csv(views.report_rows(t.alerts(spark, sf_dir)), path)
    return files.read_csv(spark, path)


def override_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disabled-rule directives written as text and read back."""
    path = scratch_path(spark, "overrides")
    files.write_lines(views.disabled_rule_lines(aq.rule_states(spark, sf_dir)), path)
    return spark.read.text(path)


def signature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests matched by a signature file, broken patterns dropped."""
    path = scratch_path(spark, "signatures")
    rows = [
        (s.id, s.name, s.category, s.severity, [*map(re.escape if s.literal else str, s.patterns), "(broken"], s.description)
        for s in rules.default_signatures()
    ]
    rows.append(("none", "", "", "", ["[z-a]"], ""))
    catalog = spark.createDataFrame(rows, SIGNATURE)
    array = catalog.agg(F.to_json(F.collect_list(F.struct(*catalog.columns))).alias("value"))
    files.write_lines(array, path)
    hit = rules.prefilter(t.requests(spark, sf_dir), load_signatures(spark, path))
    # A plain explode has the optimiser test the list's size below the scan's projections, which repeats the scan there.
    found = hit.select(F.explode_outer("matched_signatures").alias("id")).where(F.col("id").isNotNull())
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("requests"))


def alert_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts inserted, partly updated in a second batch, compacted, and updated once more."""
    fields = "alert_key string, source string, ai_status string, ai_score double, human_label string"
    store = KeyedStore(spark, scratch_path(spark, "upserts"), "alert_key", fields)
    a = t.alerts(spark, sf_dir)
    first = a.select("alert_key", "source", F.lit("unavailable").alias("ai_status"), F.lit(None).cast("double").alias("ai_score"),
                     F.lit(None).cast("string").alias("human_label"))
    scored = a.where(F.col("seq") % 2 == 0).select("alert_key", F.lit("enriched").alias("ai_status"), "ai_score")
    reviewed = a.where(F.col("seq") % 3 == 0).select("alert_key", F.lit("true_positive").alias("human_label"))
    store.upsert(first, 0)
    store.upsert(scored, 1)
    store.upsert(scored, 1)
    store.compact()
    store.upsert(reviewed)
    return store.current()


ALERT_UPSERTS = f"""WITH {t.ALERTS_SQL} SELECT alert_key, source, CASE WHEN seq % 2 = 0 THEN 'enriched' ELSE 'unavailable' END AS ai_status,
  CASE WHEN seq % 2 = 0 THEN ai_score END AS ai_score, CASE WHEN seq % 3 = 0 THEN 'true_positive' END AS human_label FROM alerts"""


def alert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts stored in batches of which one dies after its write, one is replayed, and a compaction runs in between.

    Four streams' worth of batches: every seventh alert comes twice, in two batches. ``tries`` counts how often a key
    was scored.
    """
    fields = "alert_key string, source string, ai_status string, ai_score double, tries int"
    store = KeyedStore(spark, scratch_path(spark, "replay"), "alert_key", fields)
    rows = t.alerts(spark, sf_dir).select("alert_key", "seq", "source", "ai_score").persist()

    def batch(k: int) -> DataFrame:
        return rows.where((F.col("seq") % 4 == k) | ((F.col("seq") % 7 == 0) & (F.col("seq") % 4 == (k + 3) % 4)))

    def scored(fresh: DataFrame) -> DataFrame:
        return fresh.withColumns({"ai_status": F.lit("enriched"), "tries": F.lit(1)})

    def take(k: int, writer: str) -> None:
        if not store.applied(k, writer):
            store.upsert(flows.enrich_batch(batch(k), store, scored), k, writer=writer)

    take(0, "audit")
    store.write_attempt(scored(batch(1)))  # dies before its commit
    take(1, "audit")
    take(1, "audit")
    store.compact()
    take(1, "audit")
    take(0, "audit")
    take(2, "audit")
    store.compact()
    take(0, "other")  # a stream of its own begins at batch 0 again
    store.upsert(flows.enrich_batch(batch(3), store, scored), 1, writer="other")
    rows.unpersist()
    return store.current()


ALERT_REPLAY = f"""WITH {t.ALERTS_SQL} SELECT alert_key, source, 'enriched' AS ai_status, ai_score, 1 AS tries FROM alerts"""


def cleared_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts cleared from a store: how many went, how many are left, how many come back with the next batch."""
    store = KeyedStore(spark, scratch_path(spark, "cleared"), "alert_key", "alert_key string, source string")
    a = t.alerts(spark, sf_dir).select("alert_key", "source")
    store.upsert(a)
    deleted = store.clear()
    left = store.current().count()
    store.upsert(a.where("source = 'coraza'"))
    return store.current().agg(F.lit(deleted).cast("bigint").alias("deleted"), F.lit(left).cast("bigint").alias("left_over"),
                               F.count(F.lit(1)).alias("rows"))


CLEARED_ALERTS = f"WITH {t.ALERTS_SQL} SELECT count(*) AS deleted, 0::BIGINT AS left_over, count_if(source = 'coraza') AS rows FROM alerts"


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows replaced as a whole by tick; the later batch wins even where it holds nulls."""
    fields = "timestamp bigint, requests bigint, errors bigint"
    store = KeyedStore(spark, scratch_path(spark, "metric-rows"), "timestamp", fields)
    a = t.access(spark, sf_dir).withColumn("timestamp", F.floor(F.unix_seconds("ts") / 10) * 10)
    tick = a.groupBy("timestamp").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("http_status") >= 400).alias("errors"))
    store.upsert(tick)
    store.upsert(tick.where("timestamp % 60 = 0").withColumns({"requests": F.col("requests") + 1, "errors": F.lit(None).cast("bigint")}))
    return store.current(merge_fields=False)


METRIC_ROWS = f"""WITH {t.ACCESS_SQL}, k AS (SELECT (epoch_us(ts) // 10000000) * 10 AS timestamp, count(*) AS requests, count_if(http_status >= 400) AS errors
  FROM access GROUP BY 1)
SELECT timestamp, requests + CASE WHEN timestamp % 60 = 0 THEN 1 ELSE 0 END AS requests, CASE WHEN timestamp % 60 = 0 THEN NULL ELSE errors END AS errors FROM k"""


def rule_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule overrides upserted by id; of several in one batch the latest wins."""
    catalog = rules.rule_catalog(spark)
    store = KeyedStore(spark, scratch_path(spark, "switches"), "id", "id string, enabled boolean, updated_at timestamp")
    valid = joins.valid_rule_updates(aq._overrides(spark, sf_dir), catalog)
    store.upsert(valid, order="updated_at")
    return joins.apply_overrides(catalog, store.current()).select("id", "enabled")


RULE_SWITCHES = aq.RULE_STATES.replace("SELECT cat.id, category,", "SELECT cat.id,").replace(
    f", strftime(l.updated_at, {aq.TS_SQL}) AS updated_at\nFROM cat", "\nFROM cat"
)


def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets sampled per attack type and registered; newest first."""
    fields = "name string, type string, samples bigint, attack_pct double, created_at bigint, status string"
    store = KeyedStore(spark, scratch_path(spark, "registry"), "name", fields)
    r = t.requests(spark, sf_dir)
    for i, (family, n) in enumerate((("purchase", 200), ("view", 150), (None, 500))):
        sample = quality.sample_per_family(r, family, n)
        name = family or "all"
        store.upsert(
            sample.agg(
                F.lit(f"{name}_{n}").alias("name"), F.lit(name).alias("type"), F.count(F.lit(1)).alias("samples"),
                F.round(F.avg((F.col("label") == "attack").cast("double")) * 100, 6).alias("attack_pct"),
                F.lit(i).cast("bigint").alias("created_at"), F.lit("ready").alias("status"),
            )
        )
    return views.newest(store.current(), 50, "created_at")


_SAMPLE = """(SELECT '{name}_{n}' AS name, '{name}' AS type, count(*) AS samples,
  round(avg(CASE WHEN label = 'attack' THEN 1.0 ELSE 0.0 END) * 100, 6)::DOUBLE AS attack_pct, {i}::BIGINT AS created_at, 'ready' AS status
  FROM (SELECT label FROM requests {where} ORDER BY md5(request_id || '|42'), request_id LIMIT {n}))"""
DATASET_REGISTRY = f"WITH {t.REQUESTS_SQL} " + " UNION ALL ".join(
    _SAMPLE.format(name=name, n=n, i=i, where="" if name == "all" else f"WHERE attack_family = '{name}'")
    for i, (name, n) in enumerate((("purchase", 200), ("view", 150), ("all", 500)))
)
SIGNATURE_FILE = rq.SIGNATURE_PREFILTER.replace("SELECT request_id, array_to_string(list_filter(", "SELECT id, count(*) AS requests FROM (SELECT unnest(list_filter(").replace(
    "lambda h: h IS NOT NULL), ',') AS matched_signatures FROM texts", "lambda h: h IS NOT NULL)) AS id FROM texts) GROUP BY id"
)

def followed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines in a log that is followed while it grows and is rotated: how many came of each type, and how often.

    The rows are written as text once per third; each third is appended to the live file, which is rotated in between.
    A stream takes what is there after every step, from its checkpoint.
    """
    e = t.table(spark, sf_dir, "events")
    home = scratch_path(spark, "followed").removeprefix("file:").replace("///", "/")
    log, out, mark = f"{home}/log/events.json", f"{home}/out", f"{home}/mark"
    Path(log).parent.mkdir(parents=True)
    Path(log).write_text("a line from before the stream\n")

    def take() -> None:
        lines = follow.follow_file(spark, log).select("value", "file", "position")
        flows.run_once(lines.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{mark}"))

    take()
    for k in range(3):
        part = f"{home}/third-{k}"
        e.where(F.col("event_id") % 3 == k).select(F.to_json(F.struct("event_id", "event_type"))).write.text(f"file://{part}")
        with open(log, "ab") as live:
            for piece in sorted(Path(part).glob("part-*")):
                with open(piece, "rb") as f:
                    shutil.copyfileobj(f, live)
        if k == 1:
            os.rename(log, f"{log}.1")  # rotated before it was read to its end
        else:
            take()
    rows = spark.read.parquet(f"file://{out}").withColumn("e", F.from_json("value", "event_id bigint, event_type string"))
    return rows.groupBy("e.event_type").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("e.event_id").alias("events"), F.countDistinct("file", "position").alias("places"))


FOLLOWED_LOG = "SELECT event_type, count(*) AS lines, count(DISTINCT event_id) AS events, count(*) AS places FROM events GROUP BY 1"


QUERIES = {
    "json_line_scan": (json_line_scan, JSON_LINE_SCAN),
    "sentence_csv_scan": (sentence_csv_scan, SENTENCE_CSV_SCAN),
    "flow_csv_scan": (flow_csv_scan, FLOW_CSV_SCAN),
    "full_request_csv_scan": (full_request_csv_scan, FULL_REQUEST_CSV_SCAN),
    "labelled_json": (labelled_json, LABELLED_JSON),
    "split_parquet": (split_parquet, SPLIT_PARQUET),
    "report_csv": (report_csv, aq.REPORT_ROWS),
    "override_lines": (override_lines, aq.DISABLED_RULES),
    "signature_file": (signature_file, SIGNATURE_FILE),
    "followed_log": (followed_log, FOLLOWED_LOG),
    "alert_upserts": (alert_upserts, ALERT_UPSERTS),
    "alert_replay": (alert_replay, ALERT_REPLAY),
    "cleared_alerts": (cleared_alerts, CLEARED_ALERTS),
    "metric_rows": (metric_rows, METRIC_ROWS),
    "rule_switches": (rule_switches, RULE_SWITCHES),
    "dataset_registry": (dataset_registry, DATASET_REGISTRY),
}
