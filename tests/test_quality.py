"""Gates, split and sampling on small frames with known answers."""

import pytest
from pyspark.sql import functions as F

from reqlens.operators import quality
from reqlens.schemas import REQUIRED_FIELDS

FIELDS = ["request_id", "uri", "label", "attack_family"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "request_id string, uri string, label string, attack_family string")


def clean(n, missing=0):
    return [(f"r{i}", None if i < missing else "/", "attack" if i % 2 else "benign", "f") for i in range(n)]


def gates(spark, rows):
    return {r.gate: r for r in quality.run_gates(frame(spark, rows), FIELDS).collect()}


@pytest.mark.parametrize("n,missing,fails", [(20, 0, False), (20, 6, True), (100, 5, False), (100, 6, True)])
def test_missing_field_gate(spark, n, missing, fails):
    assert ("MISSING_FIELDS" in gates(spark, clean(n, missing))) is fails


def test_duplicates_and_conflicts_are_named(spark):
    got = gates(spark, [*clean(20), ("r3", "/", "benign", "f"), ("r4", "/", "benign", "f")])
    assert got["DUPLICATE_IDS"].affected == 4 and "r3" in got["DUPLICATE_IDS"].message
    assert got["LABEL_CONFLICTS"].message == "LABEL_CONFLICTS: 1 request_id(s) have conflicting labels (sample: ['r3'])"


def test_all_gates_fail_together(spark):
    rows = [*clean(20, 10), ("r1", "/", "benign", "f")]
    assert set(gates(spark, rows)) == {"MISSING_FIELDS", "DUPLICATE_IDS", "LABEL_CONFLICTS"}


def test_required_fields_are_added(spark):
    assert set(REQUIRED_FIELDS) <= set(quality.with_required_fields(frame(spark, clean(2))).columns)


def test_split_is_whole_stratified_and_repeatable(spark):
    rows = [(f"r{i}", "/", "attack", f"f{min(i % 7, 2)}") for i in range(500)]
    rows += [("t0", "/", "attack", "tiny"), ("t1", "/", "attack", "tiny2"), *[(f"s{i}", "/", "attack", "three") for i in range(3)]]
    split = quality.stratified_split(frame(spark, rows)).cache()
    assert split.count() == len(rows) and split.where("split is null").count() == 0
    shares = {r.split: r["count"] / len(rows) for r in split.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.70) < 0.02 and abs(shares["test"] - 0.15) < 0.02
    families = split.where("attack_family like 'f%' or attack_family = 'three'").groupBy("attack_family").agg(F.countDistinct("split"))
    assert {r[1] for r in families.collect()} == {3}
    again = quality.stratified_split(frame(spark, rows[::-1])).select("request_id", "split")
    assert split.select("request_id", "split").exceptAll(again).count() == 0


def test_sample_is_exact(spark):
    rows = clean(300)
    assert quality.sample_per_family(frame(spark, rows), "f", 37).count() == 37
    assert quality.sample_per_family(frame(spark, rows), None, 1000).count() == 300
    assert quality.sample_per_family(frame(spark, rows), "none", 5).count() == 0
