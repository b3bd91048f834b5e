"""Classifier metrics with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from reqlens.operators import evaluation as ev
from reqlens.operators import views


def scored(spark, ys, ps):
    rows = [("m", str(i), "f", y, float(p)) for i, (y, p) in enumerate(zip(ys, ps, strict=True))]
    return spark.createDataFrame(rows, "model string, id string, family string, y int, p double")


@pytest.mark.parametrize(
    "ys,ps,ece,brier",
    [
        ([0, 1], [0.0, 1.0], 0.0, 0.0),
        ([1, 0], [0.0, 1.0], 1.0, 1.0),
        ([0, 0, 0, 0], [0.41, 0.42, 0.43, 0.44], 0.425, None),
        ([0, 0, 1, 1], [0.1, 0.15, 0.9, 0.95], 0.1, None),
        ([0, 1], [0.5, 0.5], 0.0, 0.25),
        ([1], [1.0], 0.0, 0.0),
    ],
)
def test_calibration(spark, ys, ps, ece, brier):
    counts = ev.score_counts(scored(spark, ys, ps))
    assert math.isclose(ev.calibration_error(counts).first().ece, ece, abs_tol=1e-12)
    if brier is not None:
        assert math.isclose(ev.brier(counts).first().brier_score, brier, abs_tol=1e-12)


def test_bin_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.3, 0.6, 0.7, 1.0, 0.1)], "p double")
    assert [r[0] for r in df.select(ev._bin_closed_left(F.col("p"))).collect()] == [2, 5, 6, 9, 1]


def test_ranking_with_ties_and_single_class(spark):
    m = ev.all_metrics(scored(spark, [0, 1, 0, 1], [0.2, 0.2, 0.1, 0.9])).first()
    assert math.isclose(m.auroc, 0.875)
    one = ev.all_metrics(scored(spark, [1, 1], [0.2, 0.9])).first()
    assert one.auroc == 0.0 and one.pr_auc == 0.0 and one.fpr == 0.0


def test_composite(spark):
    row = spark.range(1).select(
        ev.composite(F.lit(0.8), F.lit(0.1), F.lit(0.9), F.lit(0.05)).alias("a"),
        ev.composite(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"),
        ev.composite(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("c"),
    ).first()
    assert math.isclose(row.a, 0.865) and math.isclose(row.b, 1.0) and math.isclose(row.c, 0.0)


def test_many_distinct_scores_rank_like_one_sort(spark):
    df = spark.range(5000).select(
        F.lit("m").alias("model"), F.col("id"), F.lit("f").alias("family"), (F.rand(1) < 0.3).cast("int").alias("y"),
        F.pow(F.rand(2), F.lit(6)).alias("p"),
    ).cache()
    got = ev.roc_area(ev.cumulative_scores(ev.score_counts(df))).first().auroc
    rows = sorted((r.p, r.y) for r in df.collect())
    pos = sum(y for _, y in rows)
    rank_sum = sum(i + 1 for i, (_, y) in enumerate(rows) if y)
    assert math.isclose(got, (rank_sum - pos * (pos + 1) / 2) / (pos * (len(rows) - pos)), abs_tol=1e-9)


def test_next_version_is_numeric(spark):
    df = spark.createDataFrame([("v9",), ("v10",), ("vx",), ("draft",)], "version string")
    assert views.next_version(df).first().next_version == 11
    assert views.next_version(df.limit(0)).first().next_version == 1


@pytest.mark.parametrize("limit", [0, 501])
def test_page_limits(spark, limit):
    with pytest.raises(ValueError):
        views.keyset_page(spark.range(3), ["id"], limit)


def test_pages_chain_to_the_whole(spark):
    df, after, seen = spark.range(23), None, []
    while True:
        page = views.keyset_page(df, ["id"], 5, after).orderBy(F.desc("id")).collect()
        seen += [r.id for r in page]
        if not page[0].has_more:
            break
        after = (page[0].next_id,)
    assert seen == list(range(22, -1, -1))


def test_poisson_weights_count_the_limits_reached(spark):
    """Few limits are compared for most words; the weight is the number of all limits that a word reaches."""
    limits = ev._poisson_limits()
    words = sorted({0, 2**32 - 1, *limits, *(x - 1 for x in limits)})
    digests = spark.createDataFrame([(f"{w:08x}" * 4, w) for w in words], "d string, w bigint")
    rows = digests.select("w", *[ev._poisson_weight(F.col("d"), j).alias(f"w{j}") for j in range(4)]).collect()
    for r in rows:
        assert {r.w0, r.w1, r.w2, r.w3} == {sum(r.w >= x for x in limits)}
