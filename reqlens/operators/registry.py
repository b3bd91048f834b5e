"""Model registry: saved models, their versions, and scoring by the version in force.

A version is a row of a keyed store: where the model lies, what it was trained on and how, its bootstrap offsets and
score. Registering writes the model first and the row after it; the new row and the end of the old version's term are
one commit, made only if no other version appeared meanwhile, so numbers are unique and one version is in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reqlens.contract import CONTRACT_VERSION, FEATURE_NAMES
from reqlens.functions import advice
from reqlens.functions.features import with_features
from reqlens.functions.parse import rename_for_features
from reqlens.operators import evaluation, quality, training
from reqlens.operators.training import PROBABILITY, CalibratedModel, contributions, linear_contributions, raw_contributions
from reqlens.session import cut_lineage
from reqlens.sources.store import KeyedStore

VERSION = (
    "version string, number int, kind string, path string, active boolean, dataset_hash string, feature_schema_version string, "
    "config string, q025 double, q975 double, composite_score double, trained_at timestamp"
)
CONTRIBUTION = "array<struct<name:string,grp:string,value:double,direction:string>>"


class LinearScorer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A logistic score of named contract features with given weights; adds the probability and the margin's parts."""

    names = Param(Params._dummy(), "names", "features", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "weight of each feature", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean of each feature in training", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "margin of a request whose features are all zero", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, names: list[str] | None = None, weights: list[float] | None = None, means: list[float] | None = None, intercept: float = 0.0):
        super().__init__()
        names = names or []
        self._set(names=names, weights=weights or [0.0] * len(names), means=means or [0.0] * len(names), intercept=intercept)

    def _parts(self):
        unknown = set(self.getOrDefault(self.names)) - set(FEATURE_NAMES)
        if unknown:
            raise ValueError(f"not in the contract: {sorted(unknown)}")
        return zip(*(self.getOrDefault(p) for p in (self.names, self.weights, self.means)), strict=True)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = F.lit(self.getOrDefault(self.intercept))
        for name, weight, _ in self._parts():
            margin = margin + F.lit(weight) * F.col(name)
        return with_features(dataset).withColumn(PROBABILITY, F.round(1 / (1 + F.exp(-margin)), 6))

    def contributions(self) -> Column:
        return contributions({n: F.lit(w) * (F.col(n) - F.lit(m)) for n, w, m in self._parts()})


def explanation(model: LinearScorer | CalibratedModel, config: dict, strongest: int | None = None) -> Column:
    """The parts of a score: weight times distance from the mean where the model is linear, else the raw values.

    ``strongest`` is how many of the strongest parts are wanted, where not all are; a calibrated model then yields no others.
    """
    if isinstance(model, LinearScorer):
        return model.contributions()
    if hasattr(model.classifier, "coefficients") and config.get("means"):
        return linear_contributions(model, config["means"], strongest)
    return raw_contributions(model, strongest)


class ModelRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = KeyedStore(spark, f"{self.path}/versions", "version", VERSION, buckets=1)

    def versions(self) -> DataFrame:
        return self.store.current().orderBy("number")

    def register(
        self, model: LinearScorer | CalibratedModel, dataset_hash: str = "", config: dict | None = None,
        offsets: tuple[float, float] | tuple[None, None] = (None, None), composite_score: float | None = None, activate: bool = True,
    ) -> str:
        """Save a model and give it the next version; ``activate`` puts it in force at once. Returns the version."""
        kind = "linear" if isinstance(model, LinearScorer) else "calibrated"
        path = f"{self.path}/models/{uuid.uuid4().hex}"
        if kind == "linear":
            model.write().save(path)
        else:
            model.save(path)
        while True:
            now = self.store.manifest()
            known = self.store.current().select("version", "number", "active").collect()  # one small row for each training run
            number = 1 + max((r.number for r in known if r.number), default=0)
            row = Row(
                version=f"v{number}", number=number, kind=kind, path=path, active=activate, dataset_hash=dataset_hash,
                feature_schema_version=CONTRACT_VERSION, config=json.dumps(config or {}, sort_keys=True, default=str), q025=offsets[0], q975=offsets[1],
                composite_score=composite_score)
            rows = self.spark.createDataFrame([row], VERSION.replace(", trained_at timestamp", "")).withColumn("trained_at", F.current_timestamp())
            ended = [(r.version, False) for r in known if r.active and activate]
            if ended:
                rows = rows.unionByName(self.spark.createDataFrame(ended, "version string, active boolean"), allowMissingColumns=True)
            if self.store.upsert_after(now, rows):
                return f"v{number}"

    def activate(self, version: str) -> None:
        """Put a registered version in force."""
        while True:
            now = self.store.manifest()
            known = [r.version for r in self.store.current().select("version").collect()]
            if version not in known:
                raise ValueError(f"no version {version}")
            rows = self.spark.createDataFrame([(v, v == version) for v in known], "version string, active boolean")
            if self.store.upsert_after(now, rows):
                return

    def active(self) -> Row | None:
        """The version in force."""
        return self.store.current().where("active").orderBy(F.desc("number")).first()

    def load(self, row: Row) -> LinearScorer | CalibratedModel:
        return LinearScorer.load(row.path) if row.kind == "linear" else CalibratedModel.load(row.path)


def train_and_register(
    registry: ModelRegistry, requests: DataFrame, candidates: dict[str, dict], replicates: int = evaluation.BOOTSTRAP_REPLICATES,
) -> tuple[str, DataFrame]:
    """Train candidates on split requests, register the best one, and return its version and all test metrics.

    ``candidates`` names those to train with their settings. The version keeps the content hash of the data set, the
    settings, the metrics of all candidates, the training means, and how far the bootstrap percentiles of the best
    candidate's mean test probability lie from that mean.
    """
    featurizer, featured = training.featured_splits(requests)
    fitted = {
        name: training.fit_candidate(featured, training.CANDIDATES[name](**settings), training.WEIGHING.get(name, training.balanced_weights))
        for name, settings in candidates.items()
    }
    scores = cut_lineage(training.test_scores(featured, fitted), "test-scores")
    metrics = cut_lineage(evaluation.rank_models(evaluation.all_metrics(scores)), "metrics")
    ranked = metrics.orderBy(F.desc("composite_score"), "model").collect()  # a row for each candidate
    best = ranked[0]
    interval = evaluation.bootstrap_interval(evaluation.bootstrap_means(scores.where(F.col("model") == best.model), replicates)).first()
    config = {
        "model": best.model, "candidates": candidates, "seed": training.SEED, "bootstrap": {"b": interval.b, "ci_level": advice.LEVEL},
        "metrics": [{k: v for k, v in r.asDict().items() if v is not None} for r in ranked],
        "means": training.feature_means(featured.where(F.col("split") == "train")),
    }
    digest = requests.agg(quality.content_hash(requests).cast("string").alias("h")).first().h
    version = registry.register(
        training.CalibratedModel(featurizer, *fitted[best.model]), digest, config,
        (interval.quantile_low - interval.mean, interval.quantile_high - interval.mean), float(best.composite_score))
    return version, metrics


def _severity(rule: Column) -> Column:
    """Severity of a rule among the details; the last one counts."""
    hits = F.filter("rule_details", lambda d: d["rule_id"] == rule)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["severity"])


def _message(rule: Column) -> Column:
    hits = F.filter("rule_details", lambda d: d["rule_id"] == rule)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["message"])


def alert_requests(df: DataFrame) -> DataFrame:
    """Alerts as the feature step expects requests: one private copy of the row, and the evidence columns."""
    evidence = df.select(
        F.struct(*df.columns).alias("_own"), "method", "uri", "headers", "body", F.col("triggered_rules").alias("coraza_fired_rule_ids"),
        F.transform("triggered_rules", _severity).alias("coraza_rule_severities"), F.transform("triggered_rules", _message).alias("coraza_rule_messages"),
        F.col("anomaly_score").alias("coraza_anomaly_score"),
    )
    return rename_for_features(evidence)


def scored_columns(p: Column, offsets: tuple[float | None, float | None], parts: Column, version: str) -> dict[str, Column]:
    """What is stored of a score."""
    low, high = (F.lit(x).cast("double") for x in offsets)
    columns = advice.advisory_columns(p, low, high)
    stored = ("ai_score", "ai_confidence", "ai_confidence_interval", "ai_entropy", "ai_priority")
    return {"ai_status": F.lit("enriched"), **{c: columns[c] for c in stored}, "ai_explanation": advice.top_contributions(parts), "ai_model_version": F.lit(version)}


class ModelScorer:
    """Scores batches of alerts by the version in force, read again for every batch; a new version is loaded once.

    Without a version in force, or for alerts without method or URI, the status is ``unavailable`` and nothing else is set.
    """

    def __init__(self, registry: ModelRegistry):
        self.registry, self.row, self.model = registry, None, None

    def __call__(self, df: DataFrame) -> DataFrame:
        row = self.registry.active()
        if row is None:
            return df.withColumn("ai_status", F.lit("unavailable"))
        if self.row is None or row.version != self.row.version:
            self.row, self.model = row, self.registry.load(row)
        scored = self.model.transform(alert_requests(df))
        parts = explanation(self.model, json.loads(row.config))
        columns = scored_columns(F.col(PROBABILITY), (row.q025, row.q975), parts, row.version)
        valid = (F.col("_own.method") != "") & (F.col("_own.uri") != "") & (F.col("_own.anomaly_score") >= 0)
        columns = {k: F.when(valid, v).otherwise(F.lit("unavailable") if k == "ai_status" else F.lit(None)).alias(k) for k, v in columns.items()}
        own = [F.col(f"_own.`{c}`").alias(c) for c in df.columns if c not in columns]
        return scored.select(*own, *columns.values())


