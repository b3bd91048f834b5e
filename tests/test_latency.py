import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.operators import joins, metrics

FRACTIONS = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "mostly one", "few"])
def test_exact_quantiles_equal_numpy_with_few_rows_a_task(spark, monkeypatch, kind):
    monkeypatch.setattr(metrics, "SORTED_ROWS", 50)
    r = random.Random(3)
    make = {
        "spread": lambda: [r.lognormvariate(0, 3) for _ in range(3000)], "ties": lambda: [float(r.randrange(7)) for _ in range(2000)],
        "one": lambda: [4.5] * 900, "mostly one": lambda: [1.0] * 1500 + [r.random() for _ in range(400)], "few": lambda: [3.0, 1.0],
    }
    values = make[kind]()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    assert metrics.exact_quantiles(df, "x", FRACTIONS) == pytest.approx(np.quantile(values, FRACTIONS).tolist())


def test_no_rows_have_no_quantiles(spark):
    df = spark.createDataFrame([], "x double, ts timestamp")
    assert metrics.exact_quantiles(df, "x", [0.5]) == [None]
    assert metrics.sketched_quantiles(metrics.latency_sketches(df, "x"), [0.5]).first().quantiles is None


def test_minute_sketches_merge_over_any_window(spark):
    r = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(r.expovariate(1), start + timedelta(seconds=r.randrange(3600))) for _ in range(20_000)]
    sketches = metrics.latency_sketches(spark.createDataFrame(rows, "latency_ms double, ts timestamp")).cache()
    assert sketches.count() == 60
    bound = 2.3 / metrics.SKETCH_K**0.9
    for low, high in ((0, 60), (10, 25), (59, 60)):
        window = sketches.where((F.minute("minute") >= low) & (F.minute("minute") < high))
        got = metrics.sketched_quantiles(window, [0.5, 0.95]).first()
        mine = sorted(v for v, t in rows if low <= t.minute < high)
        assert got.n == len(mine)
        for f, q in zip((0.5, 0.95), got.quantiles, strict=True):
            assert abs(np.searchsorted(mine, q) / len(mine) - f) <= bound + 1 / len(mine)


def test_unmatched_replays_are_left_out(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, entry_seq int")
    assert [r.id for r in joins.matched_only(df, "entry_seq").collect()] == [1]
