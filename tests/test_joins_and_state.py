"""As-of joins against brute force on a skewed key, login limiter, store and parsers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reqlens import schemas
from reqlens.functions import parse
from reqlens.operators import joins
from reqlens.sources import files
from reqlens.sources.signatures import load_signatures
from reqlens.sources.store import KeyedStore
from reqlens.streaming import limiter, state

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_matches_brute_force(spark, direction):
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice("abc")
    left = [(i, key(), T0 + timedelta(seconds=rng.randrange(4000))) for i in range(300)]
    right = [(i, key(), T0 + timedelta(seconds=rng.randrange(4000)), f"v{i}") for i in range(300)]
    tolerance = 120
    got = joins.asof_join(
        spark.createDataFrame(left, "id int, k string, lt timestamp"),
        spark.createDataFrame(right, "seq int, k string, rt timestamp, v string"),
        ["k"], "lt", "rt", "seq", ["v"], tolerance * 1_000_000, direction, slice_seconds=30,
    )
    got = {r.id: r.v for r in got.collect()}
    sign = 1 if direction == "backward" else -1
    for i, k, ts in left:
        near = [(sign * r[2].timestamp(), sign * r[0], r[3]) for r in right
                if r[1] == k and 0 <= sign * (ts - r[2]).total_seconds() <= tolerance]
        assert got[i] == (max(near)[2] if near else None)


def test_body_age_limit(spark):
    alerts = spark.createDataFrame(
        [(1, "GET", "/a", T0 + timedelta(seconds=299), ""), (2, "GET", "/a", T0 + timedelta(seconds=300), ""),
         (3, "GET", "/a", T0, "own")], "id int, method string, uri string, ts timestamp, body string")
    bodies = spark.createDataFrame([("GET", "/a", T0, 1, "cached")], "method string, uri string, ts timestamp, seq int, body string")
    got = {r.id: r.body for r in joins.fill_bodies(alerts, bodies, "seq").collect()}
    assert got == {1: "cached", 2: "", 3: "own"}


def attempts(spark, rows):
    return spark.createDataFrame([(k, s * 1_000_000, i, st) for i, (k, s, st) in enumerate(rows)],
                                 "key string, us long, seq long, status int")


def blocked(df):
    return [r.blocked for r in df.orderBy("seq").collect()]


def test_third_attempt_blocked_and_success_resets(spark):
    assert blocked(limiter.login_bursts(attempts(spark, [("a", 0, 401), ("a", 1, 401), ("a", 2, 401)]), 2)) == [False, False, True]
    rows = [("a", 0, 401), ("a", 1, 200), ("a", 2, 401), ("a", 3, 401)]
    assert blocked(limiter.login_bursts(attempts(spark, rows), 2)) == [False] * 4


def test_limiter_pieces_equal_one_run(spark):
    rng = random.Random(3)
    second, rows = 0, []
    for _ in range(600):
        second += rng.choice([1, 1, 2, 5, 40, 90, 200])
        rows.append(("hot", second, rng.choice([401, 401, 401, 200])))
    whole, expected = state.Limiter(), []
    for _, s, status in rows:
        expected.append(whole.step(s * 1_000_000, status, 3))
    assert blocked(limiter.login_bursts(attempts(spark, rows), 3)) == expected


def test_audit_line_cases(spark):
    lines = [
        '{"transaction": {"timestamp": "2024/01/02 03:04:05", "request": {"uri": "/a?x=1&x=2&y=%41", "method": "GET", "headers":'
        ' {"A": "t", "B": ["l", "m"], "C": 5, "D": []}}}, "messages": ['
        '{"message": "Inbound Anomaly Score Exceeded (Total Score: 5)"}, {"message": "hit", "data": {"id": 942100, "severity": "CRITICAL"}},'
        '{"message": "hit", "data": {"id": 942100}}, {"message": "", "data": {"id": 7}},'
        '{"message": "Inbound Anomaly Score Exceeded (Total Score: 15)"}]}',
        '{"messages": []}', "not json",
    ]
    rows = parse.parse_audit(spark.createDataFrame([(x,) for x in lines], "value string"),
                             ingested_at=F.timestamp_seconds(F.lit(60))).collect()
    a, b, c = rows
    assert a.timestamp_raw == "2024-01-02T03:04:05Z" and a.headers == {"A": "t", "B": "l"} and a.header_count == 4
    assert a.query_params == {"x": "1", "y": "A"} and a.triggered_rules == ["942100"] and len(a.rule_details) == 3
    assert a.anomaly_score == 15.0 and a.status == "generated" and a.request_fingerprint_version == "rfp-v1"
    assert b.timestamp_raw == "1970-01-01T00:01:00Z" and b.anomaly_score == 0.0 and b._bad is None
    assert c._bad == "not json"


def test_store_merges_fields_and_survives_replay(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", "k", "k string, a int, b string")
    store.upsert(spark.createDataFrame([("x", 1, None), ("y", 2, "q")], "k string, a int, b string"), 0)
    for _ in range(2):
        store.upsert(spark.createDataFrame([("x", None, "r")], "k string, a int, b string"), 1)
    assert sorted(map(tuple, store.current().collect())) == [("x", 1, "r"), ("y", 2, "q")]
    store.compact()
    store.upsert(spark.createDataFrame([("y", 9)], "k string, a int"))
    assert sorted(map(tuple, store.current().collect())) == [("x", 1, "r"), ("y", 9, "q")]
    assert store.clear() == 2 and store.current().count() == 0


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "latin-1"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = tmp_path / "s.csv"
    path.write_bytes('Sentence,Label\n"caf\xe9, \'1\'",1\nplain,0\n,1\nbad,x\nfar,2\n1,2,3,4\n'.encode(encoding))
    good, skipped = files.sentence_requests(files.read_csv(spark, str(path)), "sqli")
    rows = good.collect()
    assert sorted(r.label for r in rows) == ["attack", "benign"]
    assert any("café" in (r.uri + r.body + str(r.headers)) for r in rows)
    assert skipped.count() == 3


def test_full_request_file_without_columns_is_refused(spark):
    assert files.full_requests(spark.createDataFrame([("GET",)], "Method string")) is None


def test_broken_signatures_are_dropped(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "a", "patterns": ["x+", "(y"]}, {"id": "b", "patterns": ["[z-a]"]}]')
    got = load_signatures(spark, str(tmp_path / "c.json"))
    assert [(s.id, s.patterns) for s in got] == [("a", ("x+",)), ("b", ())]


def test_replay_fields_take_first_value_present(spark):
    line = '{"transaction": {"messages": [{"rule_id": 0, "id": 5, "rule": {"severity": "S", "msg": "n"}}], "producer": {"anomaly_score": 0}}, "anomaly_score": 4}'
    entry = F.from_json("value", schemas.REPLAY_ENTRY)
    df = spark.createDataFrame([(line,)], "value string").withColumn("e", entry)
    row = df.select(*[c.alias(n) for n, c in parse.audit_outcome(F.col("e")).items()]).first()
    assert tuple(row) == ([5], ["S"], ["n"], 4, True)
