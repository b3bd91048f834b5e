import random
from datetime import datetime, timedelta

from reqlens.operators import joins

START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def brute(requests, entries):
    timed, last = [], None
    first = min((e[1] for e in entries if e[1] is not None), default=None)
    for uri, ts, seq in sorted(entries, key=lambda e: e[2]):
        last = ts if ts is not None else last
        timed.append((uri, last if last is not None else first, seq))
    out = []
    for key, uri, sent in requests:
        path = uri.split("?")[0]
        out.append((key, next((seq for u, ts, seq in timed if ts is not None and path in u and abs(ts - sent) <= 5), None)))
    return sorted(out)


def matched(spark, requests, entries):
    sent = spark.createDataFrame([(k, u, at(s)) for k, u, s in requests], "k long, uri string, sent_at timestamp").repartition(3)
    log = spark.createDataFrame([(u, at(ts), seq) for u, ts, seq in entries], "entry_uri string, entry_ts timestamp, entry_seq long").repartition(4)
    return sorted((r.k, r.entry_seq) for r in joins.match_replay(sent, log, "entry_seq", ["entry_seq", "entry_uri"]).collect())


def test_equals_brute_force(spark):
    r = random.Random(2)
    pieces = ["/", "a", "bc", "/u/1", "x.y", "é", "%2f", "//", "login"]
    make = lambda: "".join(r.choice(pieces) for _ in range(r.randint(0, 6)))
    requests = [(k, make() + r.choice(["", "?q=1", "?a?b"]), round(r.uniform(0, 60), 3)) for k in range(250)]
    entries = [(r.choice(["", "http://h"]) + make() + make(), None if r.random() < 0.2 else round(r.uniform(0, 60), 3), seq) for seq in range(400)]
    assert matched(spark, requests, entries) == brute(requests, entries)


def test_edges(spark):
    entries = [("http://h/app/x", None, 0), ("/app/x", 100.0, 1), ("/app/x/long/" + "y" * 5000, None, 2), ("/other", 105.0, 3), ("", 100.0, 4)]
    requests = [(1, "app/x?z", 100.0), (2, "/app/x", 105.0), (3, "/app/x", 105.001), (4, "", 100.0), (5, "y" * 400, 95.0), (6, "/nothing", 100.0), (6, "/nothing", 100.0)]
    assert matched(spark, requests, entries) == brute(requests, entries)
    assert matched(spark, requests, []) == sorted((k, None) for k, _, _ in requests)
    assert matched(spark, [], entries) == []
    assert matched(spark, requests[:2], [("/app/x", None, 1)]) == [(1, None), (2, None)]


def test_a_long_target_answers_with_as_many_pieces_as_characters(spark):
    row = spark.range(1).select(joins.F.size(joins._grams(joins.F.lit("abcdefgh" * 105))).alias("n"), joins.F.size(joins._grams(joins.F.lit(""))).alias("none")).first()
    assert row.n <= 840 and row.none == 1
