import json

import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Row
from pyspark.sql import functions as F

from reqlens.functions import advice
from reqlens.operators import registry, training
from reqlens.operators.registry import LinearScorer, ModelRegistry, ModelScorer
from reqlens.plans import tables as t
from reqlens.sources.store import KeyedStore
from reqlens.streaming import alerts as al

SF = "/root/testdata/sf0.001"
STORED = (
    "alert_key string, seq bigint, uri string, method string, body string, body_length bigint, anomaly_score double, timestamp_raw string, "
    "ai_status string, ai_score double, ai_model_version string, ai_explanation " + registry.CONTRIBUTION
)


@pytest.fixture
def models(spark, tmp_path):
    return ModelRegistry(spark, f"file://{tmp_path}/registry")


def scorer(weight=0.5, intercept=-1.0):
    return LinearScorer(names=["anomaly_score", "has_body"], weights=[weight, 0.25], means=[2.0, 0.5], intercept=intercept)


def audit(seq, uri="/a", method="POST", body="", score=5, stamp="2024/01/02 03:04:05", rule="942100"):
    value = json.dumps({
        "transaction": {"timestamp": stamp, "client_ip": "1.2.3.4", "request": {"uri": uri, "method": method, "body": body, "headers": {}}},
        "messages": [{"message": f"Inbound Anomaly Score Exceeded (Total Score: {score})"}, {"message": "hit", "data": {"id": int(rule), "severity": "CRITICAL"}}]})
    return ("audit", seq, value)


def access(seq, body, uri="/a", method="POST", at="2024-01-02T03:04:00"):
    from datetime import datetime

    us = datetime.fromisoformat(at + "+00:00").timestamp()
    return ("access", seq, json.dumps({"ts": us, "request": {"client_ip": "1.2.3.4", "method": method, "uri": uri, "headers": {}}, "status": 200, "request_body": body}))


@pytest.fixture
def tables(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/alerts", "alert_key", STORED), al.body_store(spark, f"file://{tmp_path}/bodies")


@pytest.fixture
def take(spark, tables):
    def run(batch, rows, score=lambda df: df.withColumn("ai_status", F.lit("enriched")), writer="w"):
        al.take_batch(spark.createDataFrame(rows, "kind string, seq bigint, value string"), batch, writer, *tables, score)
        return {r.seq: r for r in tables[0].current().collect()}

    return run


def test_versions_follow_each_other_and_one_is_in_force(models):
    assert models.active() is None
    assert models.register(scorer(), "h1", {"rounds": 3}, (-0.1, 0.2), 0.7) == "v1"
    assert models.register(scorer(0.9), "h2") == "v2"
    assert models.register(scorer(0.1), activate=False) == "v3"
    rows = {r.version: r for r in models.versions().collect()}
    assert [rows[v].active for v in ("v1", "v2", "v3")] == [False, True, False]
    assert (rows["v1"].dataset_hash, json.loads(rows["v1"].config), rows["v1"].q025, rows["v1"].q975, rows["v1"].composite_score) == ("h1", {"rounds": 3}, -0.1, 0.2, 0.7)
    models.activate("v3")
    assert models.active().version == "v3" and sum(r.active for r in models.versions().collect()) == 1
    with pytest.raises(ValueError):
        models.activate("v9")


def test_two_trainings_at_once_get_two_numbers(models, monkeypatch):
    other, plain, raced = ModelRegistry(models.spark, models.path), models.store._create, []

    def race(manifest):
        if not raced:
            raced.append(1)
            assert other.register(scorer()) == "v1"
        return plain(manifest)

    monkeypatch.setattr(models.store, "_create", race)
    assert models.register(scorer()) == "v2"
    assert [(r.version, r.active) for r in models.versions().collect()] == [("v1", False), ("v2", True)]


def test_reloaded_models_score_alike(spark, models):
    requests = t.enriched_requests(spark, SF).limit(200).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation")), F.pmod(F.crc32("request_id"), F.lit(2)).cast("int") + 1))
    featurizer, featured = training.featured_splits(requests)
    classifier, calibrator = training.fit_candidate(featured, training.logistic_regression(iterations=20))
    forest, forest_map = training.fit_candidate(featured, training.random_forest(trees=3, depth=4))
    for model in (training.CalibratedModel(featurizer, classifier, calibrator), training.CalibratedModel(featurizer, forest, forest_map), scorer()):
        models.register(model)
        again = models.load(models.active())
        assert type(again) is type(model)
        scores = lambda m: sorted(map(tuple, m.transform(requests).select("request_id", training.PROBABILITY).collect()))
        assert scores(again) == scores(model) and len(scores(model)) == 200


def test_unknown_feature_is_refused(spark):
    with pytest.raises(ValueError):
        LinearScorer(names=["no_such"], weights=[1.0]).transform(t.enriched_requests(spark, SF))


def test_stream_scores_with_the_version_in_force(models, take):
    import math

    score = ModelScorer(models)
    rows = take(0, [audit(1)], score)
    assert (rows[1].ai_status, rows[1].ai_score, rows[1].ai_model_version) == ("unavailable", None, None)
    models.register(scorer())
    rows = take(1, [audit(2, uri="/b"), audit(1), audit(3, uri="")], score)
    want = round(1 / (1 + math.exp(-(-1.0 + 0.5 * 5))), 6)
    assert (rows[1].ai_status, rows[1].ai_score, rows[1].ai_model_version) == ("enriched", want, "v1")  # tried again, as it was not enriched
    assert [(c.name, c.value, c.direction) for c in rows[2].ai_explanation] == [("anomaly_score", 1.5, "positive"), ("has_body", -0.125, "negative")]
    assert (rows[3].ai_status, rows[3].ai_score) == ("unavailable", None)
    models.register(scorer(0.1))
    rows = take(2, [audit(4, uri="/c"), audit(2, uri="/b")], score)
    assert rows[4].ai_model_version == "v2" and rows[2].ai_model_version == "v1"


def test_bodies_come_from_the_batch_and_from_batches_before(take):
    rows = take(0, [audit(1, uri="/x"), access(1, "first", uri="/a"), access(2, "own", uri="/x"), access(3, "later", uri="/x", at="2024-01-02T03:05:00")])
    assert (rows[1].body, rows[1].body_length) == ("own", 3)
    rows = take(1, [
        audit(2), audit(3, method="GET"), audit(4, stamp="2024/01/02 03:09:00", score=6), audit(5, stamp="2024/01/02 03:08:59", score=7),
        audit(6, body="has one"), audit(7, stamp="2024/01/02 03:03:59", score=8)])
    assert rows[2].body == "first" and rows[5].body == "first" and rows[6].body == "has one"
    assert rows[3].body == rows[4].body == rows[7].body == ""  # other method; five minutes old; from before the body


def test_an_older_body_does_not_replace_a_newer_one(take, tables):
    take(0, [access(1, "new", at="2024-01-02T03:04:00")])
    take(1, [access(2, "old", at="2024-01-02T03:03:00")])
    assert [r.body for r in tables[1].current().collect()] == ["new"]


def test_no_alert_is_lost(take):
    late = [audit(k, uri=f"/{k}", stamp=s) for k, s in enumerate(["2024/01/02 03:04:05", "2019/01/01 00:00:00", "no time at all", "2031-01-01T00:00:00Z"])]
    rows = take(0, late)
    assert sorted(rows) == [0, 1, 2, 3]
    rows = take(1, [audit(9, uri="/9", stamp="2001/01/01 00:00:00"), audit(10, score=0), ("audit", 11, "{broken")])
    assert sorted(rows) == [0, 1, 2, 3, 9]


def test_replays_after_any_failure_end_alike(take, tables, monkeypatch):
    first = [audit(1), access(1, "one"), audit(2, uri="/b")]
    second = [audit(3, stamp="2024/01/02 03:04:06"), access(2, "two", at="2024-01-02T03:04:04"), audit(2, uri="/b")]
    take(0, first)

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables[0], "commit", dies)
        with pytest.raises(RuntimeError):
            take(1, second)
    with monkeypatch.context() as m:
        m.setattr(tables[1], "commit", dies)
        with pytest.raises(RuntimeError):
            take(1, second)
    rows = take(1, second)
    assert {k: r.body for k, r in rows.items()} == {1: "one", 2: "", 3: "two"}
    again = take(1, second)
    assert again == rows and [r.body for r in tables[1].current().collect()] == ["two"]


def test_offsets_reach_the_interval(spark):
    df = spark.createDataFrame([Row(p=0.5)])
    columns = registry.scored_columns(F.col("p"), (-0.12, None), F.array().cast(registry.CONTRIBUTION), "v7")
    row = df.select(*[c.alias(n) for n, c in columns.items()]).first()
    assert (row.ai_confidence_interval.low, row.ai_confidence_interval.high, row.ai_model_version) == (0.38, 0.6, "v7")


def test_training_keeps_what_it_was_made_of(spark, models):
    from reqlens.operators import quality

    splits = quality.stratified_split(t.enriched_requests(spark, SF))
    chosen = {"logistic_regression": {"iterations": 15}, "boosted_trees_x5": {"rounds": 2, "depth": 3}}
    version, metrics = registry.train_and_register(models, splits, chosen, replicates=40)
    row = models.active()
    config = json.loads(row.config)
    assert version == row.version == "v1" and {r.model for r in metrics.collect()} == set(chosen)
    assert config["model"] == max(metrics.collect(), key=lambda r: r.composite_score).model
    assert config["candidates"] == chosen and config["bootstrap"]["b"] == 40
    assert row.q025 <= 0 <= row.q975 and row.q025 > -0.5
    assert row.dataset_hash == splits.repartition(7).agg(quality.content_hash(splits).cast("string")).first()[0]
    model = models.load(row)
    explained = model.transform(splits.limit(5)).select(registry.explanation(model, config).alias("e")).collect()
    assert all(len(r.e) == len(model.featurizer.feature_names()) for r in explained)


def test_comparison_trains_every_candidate_in_full(spark, tmp_path, monkeypatch):
    from reqlens.plans import training_queries

    asked = []
    monkeypatch.setattr(training_queries, "_splits", lambda *_: None)
    monkeypatch.setattr(registry, "train_and_register", lambda models, splits, candidates: asked.append(candidates) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        training_queries.model_comparison(spark, str(tmp_path))
    made = {name: training.CANDIDATES[name](**settings) for name, settings in asked[0].items()}
    assert set(made) == {"boosted_trees", "boosted_trees_x5", "random_forest", "logistic_regression"}
    forest = made["random_forest"]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSubsamplingRate()) == (200, 30, 1.0)
    assert made["logistic_regression"].getMaxIter() == 1000
    assert all((m.getMaxIter(), m.getMaxDepth()) == (200, 6) for n, m in made.items() if n.startswith("boosted"))


def test_five_times_weight_of_positives(spark):
    df = spark.createDataFrame([(1,), (0,)], "y int")
    assert sorted((r.y, r.weight) for r in training.WEIGHING["boosted_trees_x5"](df).collect()) == [(0, 1.0), (1, 5.0)]


def test_rows_of_one_partition_are_dealt_out_to_be_scored(spark):
    one = t.enriched_requests(spark, SF).limit(40).coalesce(1)
    assert training.score_requests(scorer(), one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_strongest_parts_by_size_then_name(spark):
    nan = float("nan")
    rows = [
        [("b", "g", 1.0), ("a", "g", -1.0), ("c", "g", 3.0), ("z", "g", 0.0), ("y", "g", -0.0), ("d", "g", 0.5)],
        [("b", "g", 1.0), ("n", "g", nan), ("i", "g", float("-inf")), ("a", "x", -1.0), ("a", "g", 1.0), ("m", "g", nan)],
        [("b", "g", 1.0), ("a", "g", None)],
        [],
        None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<struct<name:string,grp:string,value:double>>")
    got = {r.i: r.t and [(p.name, p.grp, p.direction) for p in r.t] for r in df.select("i", advice.top_contributions(F.col("c"), 4).alias("t")).collect()}
    assert got[0] == [("c", "g", "positive"), ("a", "g", "negative"), ("b", "g", "positive"), ("d", "g", "positive")]
    assert got[1] == [("m", "g", "positive"), ("n", "g", "positive"), ("i", "g", "negative"), ("a", "x", "negative")]
    assert {p[0] for p in got[2]} == {"a", "b"} and got[3] == [] and got[4] is None


def test_a_vector_is_unpacked_once_for_all_its_parts(spark, models):
    class Stub:
        class featurizer:  # noqa: N801
            feature_names = staticmethod(lambda: ["u", "v", "w"])

        class classifier:  # noqa: N801
            coefficients = DenseVector([1.0, -2.0, 0.5])

    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(training.array_to_vector("x").alias("features"))
    for parts in (training.linear_contributions(Stub, [0.0, 1.0, 1.0]), training.raw_contributions(Stub)):
        shown = df.select(parts.alias("p"))
        assert shown._jdf.queryExecution().optimizedPlan().toString().count("UDF(features") <= 1
    assert [p.value for p in df.select(training.linear_contributions(Stub, [0.0, 1.0, 1.0]).alias("p")).first().p] == [1.0, -2.0, 1.0]
