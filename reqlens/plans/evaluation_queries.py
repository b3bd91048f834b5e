"""Metrics, curves, calibration, resampling and advisory columns over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.functions import advice
from reqlens.operators import evaluation as ev
from reqlens.operators import training
from reqlens.plans import tables as t


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_RATES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")
_CONF_SQL = """conf AS (SELECT model, {by} count_if(y = 1 AND p > 0.5) AS tp, count_if(y = 0 AND p > 0.5) AS fp,
  count_if(y = 1 AND p <= 0.5) AS fn, count_if(y = 0 AND p <= 0.5) AS tn FROM scored GROUP BY ALL)"""
_RATE_SQL = """(tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(fn / nullif(fn + tp, 0), 0) AS fnr"""


def classification_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and rates per model."""
    return _round(ev.classification_rates(t.scored(spark, sf_dir)), *_RATES)


CLASSIFICATION_RATES = f"""WITH {t.SCORED_SQL}, {_CONF_SQL.format(by='')}, r AS (SELECT model, tp, fp, fn, tn, {_RATE_SQL} FROM conf)
SELECT model, tp, fp, fn, tn, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _RATES)} FROM r"""


def family_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positive and negative rate per model and family."""
    return _round(ev.family_rates(t.scored(spark, sf_dir)), "fpr", "fnr")


FAMILY_RATES = f"""WITH {t.SCORED_SQL}, {_CONF_SQL.format(by='family,')}, r AS (SELECT model, family, tp + fp + fn + tn AS rows, {_RATE_SQL} FROM conf)
SELECT model, family, rows, round(fpr, 6)::DOUBLE AS fpr, round(fnr, 6)::DOUBLE AS fnr FROM r"""

FAMILIES = ["de", "en", "es", "fr"]


def family_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by families, false negative rate."""
    return _round(ev.family_matrix(t.scored(spark, sf_dir), FAMILIES, "fnr"), *FAMILIES)


FAMILY_MATRIX = f"""WITH {t.SCORED_SQL}, {_CONF_SQL.format(by='family,')}, r AS (SELECT model, family, {_RATE_SQL} FROM conf)
SELECT model, {', '.join(f"coalesce(round(max(CASE WHEN family = '{f}' THEN fnr END), 6), 0)::DOUBLE AS {f}" for f in FAMILIES)} FROM r GROUP BY model"""


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per model, true and predicted class."""
    return ev.confusion_matrix(t.scored(spark, sf_dir))


CONFUSION_MATRIX = f"WITH {t.SCORED_SQL} SELECT model, y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM scored GROUP BY ALL"


def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.cumulative_scores(ev.score_counts(t.scored(spark, sf_dir)))


_CUM_SQL = f"""{t.SCORED_SQL}, k AS (SELECT model, p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS tp,
  sum(neg) OVER (PARTITION BY model) AS tn FROM k WINDOW w AS (PARTITION BY model ORDER BY p DESC))"""


def ranking_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC area, average precision and trapezoid area per model."""
    c = _cumulative(spark, sf_dir)
    out = ev.roc_area(c).join(ev.average_precision(c), "model").join(ev.pr_trapezoid_area(c), "model")
    return _round(out, "auroc", "pr_auc", "pr_trapezoid")


RANKING_AREAS = f"""WITH {_CUM_SQL}, pts AS (SELECT model, cp / tp AS rec, cp / (cp + cn) AS prec, p FROM cum
  UNION ALL SELECT DISTINCT model, 0.0, 1.0, 2.0 FROM cum),
l AS (SELECT *, lag(rec) OVER w AS r0, lag(prec) OVER w AS p0 FROM pts WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
z AS (SELECT model, sum((rec - r0) * (prec + p0) / 2) AS pr_trapezoid FROM l GROUP BY model),
ranks AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2 AS r FROM scored),
u AS (SELECT model, (sum(CASE WHEN y = 1 THEN r END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2)
  / (count_if(y = 1) * count_if(y = 0)) AS auroc FROM ranks GROUP BY model),
ap AS (SELECT model, sum(pos / tp * cp / (cp + cn)) AS pr_auc FROM cum GROUP BY model)
SELECT model, round(auroc, 6)::DOUBLE AS auroc, round(pr_auc, 6)::DOUBLE AS pr_auc, round(pr_trapezoid, 6)::DOUBLE AS pr_trapezoid
FROM u JOIN ap USING (model) JOIN z USING (model)"""


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC curve points."""
    return _round(ev.roc_points(_cumulative(spark, sf_dir)), "fpr", "tpr")


ROC_POINTS = f"""WITH {_CUM_SQL} SELECT model, p AS threshold, round(cn / tn, 6)::DOUBLE AS fpr, round(cp / tp, 6)::DOUBLE AS tpr FROM cum
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM cum"""


def roc_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC points without those on a straight line between their neighbours."""
    return _round(ev.roc_corners(_cumulative(spark, sf_dir)), "fpr", "tpr")


ROC_CORNERS = f"""WITH {_CUM_SQL}, n AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM cum
  WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC) AS rn FROM n)
SELECT model, p AS threshold, round(cn / tn, 6)::DOUBLE AS fpr, round(cp / tp, 6)::DOUBLE AS tpr FROM f
WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM cum"""


def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision-recall curve points."""
    return _round(ev.pr_points(_cumulative(spark, sf_dir)), "precision", "recall")


PR_POINTS = f"""WITH {_CUM_SQL} SELECT model, p AS threshold, round(cp / (cp + cn), 6)::DOUBLE AS precision, round(cp / tp, 6)::DOUBLE AS recall FROM cum
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM cum"""

_EDGES = "[" + ", ".join(repr(e) for e in ev._edges()) + "]::DOUBLE[]"


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error and Brier score per model."""
    k = ev.score_counts(t.scored(spark, sf_dir))
    return _round(ev.calibration_error(k).join(ev.brier(k), "model"), "ece", "brier_score")


_ECE_SQL = f"""bins AS (SELECT model, len(list_filter({_EDGES}, lambda e: p >= e)) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS fp
  FROM scored GROUP BY ALL), ece AS (SELECT model, sum(n * abs(mp - fp)) / sum(n) AS ece FROM bins GROUP BY model),
br AS (SELECT model, avg((p - y) * (p - y)) AS brier_score FROM scored GROUP BY model)"""
CALIBRATION = f"""WITH {t.SCORED_SQL}, {_ECE_SQL} SELECT model, round(ece, 6)::DOUBLE AS ece, round(brier_score, 6)::DOUBLE AS brier_score
FROM ece JOIN br USING (model)"""


def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability curve per model."""
    return _round(ev.reliability_curve(ev.score_counts(t.scored(spark, sf_dir))), "mean_predicted", "fraction_positive")


RELIABILITY_CURVE = f"""WITH {t.SCORED_SQL} SELECT model, CAST(len(list_filter({_EDGES}, lambda e: p > e)) AS INT) AS bin, count(*) AS n,
  round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive FROM scored GROUP BY ALL"""


def probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty probability bins per model."""
    return ev.probability_histogram(ev.score_counts(t.scored(spark, sf_dir)))


PROBABILITY_HISTOGRAM = f"""WITH {t.SCORED_SQL}, s AS (SELECT *, min(p) OVER (PARTITION BY model) AS lo, max(p) OVER (PARTITION BY model) AS hi FROM scored),
g AS (SELECT *, (hi - lo) / 50 AS st, least(floor((p - lo) / (hi - lo) * 50), 49) AS g FROM s),
d AS (SELECT *, g - CASE WHEN p < lo + g * st THEN 1 ELSE 0 END AS d FROM g),
b AS (SELECT model, CAST(d + CASE WHEN d < 49 AND p >= lo + (d + 1) * st THEN 1 ELSE 0 END AS BIGINT) AS bin FROM d)
SELECT model, bin, count(*) AS n FROM b GROUP BY ALL"""


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics and the composite score per model, ranked."""
    m = ev.rank_models(ev.all_metrics(t.scored(spark, sf_dir)))
    return _round(m, *ev.METRICS, "composite_score")


_METRICS_SQL = f"""{_CUM_SQL}, {_CONF_SQL.format(by='')}, rt AS (SELECT model, {_RATE_SQL} FROM conf), {_ECE_SQL},
roc AS (SELECT model, sum(neg * (cp - pos / 2)) / (max(tp) * max(tn)) AS auroc, sum(pos / tp * cp / (cp + cn)) AS pr_auc FROM cum GROUP BY model),
m AS (SELECT *, 0.4 * f1 + 0.3 * (1 - ece) + 0.2 * auroc + 0.1 * (1 - fpr) AS composite_score
  FROM rt JOIN ece USING (model) JOIN br USING (model) JOIN roc USING (model))"""
MODEL_METRICS = f"""WITH {_METRICS_SQL} SELECT model, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in [*ev.METRICS, 'composite_score'])},
  CAST(rank() OVER (ORDER BY composite_score DESC) AS INT) AS rank FROM m"""


def best_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every model with the best one marked."""
    return _round(ev.best_per_metric(ev.all_metrics(t.scored(spark, sf_dir))), "value")


BEST_PER_METRIC = f"""WITH {_METRICS_SQL}, l AS (UNPIVOT (SELECT model, {', '.join(f'{c}::DOUBLE AS {c}' for c in ev.METRICS)} FROM m)
  ON {', '.join(ev.METRICS)} INTO NAME metric VALUE value)
SELECT model, metric, round(value, 6) AS value, abs(value - CASE WHEN metric IN ('fpr', 'fnr', 'ece', 'brier_score')
  THEN min(value) OVER (PARTITION BY metric) ELSE max(value) OVER (PARTITION BY metric) END) < 1e-9 AS is_best FROM l"""


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean probability per model, 200 replicates."""
    means = ev.bootstrap_means(t.scored(spark, sf_dir))
    return _round(ev.bootstrap_interval(means), "quantile_low", "quantile_high", "mean")


_LIMITS = ev._poisson_limits()
BOOTSTRAP_INTERVAL = f"""WITH {t.SCORED_SQL}, d AS (SELECT model, p, b, md5(CAST(id AS VARCHAR) || '|42|' || b) AS h FROM scored, range(50) r(b)),
w AS (SELECT model, p, b * 4 + j AS replicate, ('0x' || substr(h, CAST(j * 8 + 1 AS BIGINT), 8))::BIGINT AS w FROM d, range(4) s(j)),
k AS (SELECT model, p, replicate, {' + '.join(f'(w >= {x})::INT' for x in _LIMITS)} AS k FROM w),
means AS (SELECT model, replicate, sum(p * k) / sum(k) AS m FROM k GROUP BY ALL)
SELECT model, count(*) AS b, round(quantile_cont(m, 0.025), 6) AS quantile_low, round(quantile_cont(m, 0.975), 6) AS quantile_high,
  round(avg(m), 6) AS mean FROM means GROUP BY model"""


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights of the labelled documents."""
    w = training.class_weights(t.scored(spark, sf_dir))
    return w.select("y", F.round("weight", 6).alias("weight"))


CLASS_WEIGHTS = f"WITH {t.SCORED_SQL} SELECT y, round((SELECT count(*) FROM scored) / (2 * count(*)), 6)::DOUBLE AS weight FROM scored GROUP BY y"


# ---- advisory ----------------------------------------------------------------------------


def advisory_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval, entropy, confidence, priority, reason and label set of every score; wide and narrow intervals."""
    s = t.scored(spark, sf_dir)
    offset = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 10) / 100.0)
    c = advice.advisory_columns(F.col("p"), -offset, offset)
    interval = c["ai_confidence_interval"]
    return s.select(
        "model", "id", c["ai_score"].alias("ai_score"), c["ai_confidence"].alias("ai_confidence"),
        interval["low"].alias("low"), interval["high"].alias("high"), advice.interval_width(interval).alias("width"),
        c["ai_entropy"].alias("ai_entropy"), c["ai_priority"].alias("ai_priority"), c["ai_reason"].alias("ai_reason"),
        F.array_join(c["ai_labels"], ",").alias("ai_labels"),
    )


_F4 = "CAST(CAST(round(CAST({x} AS DECIMAL(18, 6)), 4) AS DECIMAL(18, 4)) AS VARCHAR)"


def _f4(x: str) -> str:
    return _F4.format(x=x)


ADVISORY_COLUMNS = f"""WITH {t.SCORED_SQL}, o AS (SELECT *, CASE WHEN id % 3 = 0 THEN 0.1::DOUBLE ELSE (id % 10) / 100.0 END AS off FROM scored),
c AS (SELECT *, round(greatest(0, p - off), 4) AS low, round(least(1, p + off), 4) AS high,
  greatest(1e-12, least(1 - 1e-12, p)) AS q FROM o),
e AS (SELECT *, round(high - low, 4) AS width, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS h FROM c),
b AS (SELECT *, CASE WHEN p >= 0.9 AND width <= 0.15 THEN 'P1' WHEN p <= 0.1 AND width <= 0.15 THEN 'P3' ELSE 'P2' END AS band FROM e)
SELECT model, id, p AS ai_score, round((1 - h) * 100, 2) AS ai_confidence, low::DOUBLE AS low, high::DOUBLE AS high, width::DOUBLE AS width, h AS ai_entropy,
  band AS ai_priority, CASE
   WHEN band = 'P1' THEN 'P1 assigned: attack_probability=' || {_f4('p')} || ' (>= 0.90) and CI_width=' || {_f4('width')} || ' (<= 0.15) — high-confidence attack signal.'
   WHEN band = 'P3' THEN 'P3 assigned: attack_probability=' || {_f4('p')} || ' (<= 0.10) and CI_width=' || {_f4('width')} || ' (<= 0.15) — high-confidence benign signal.'
   WHEN width > 0.15 THEN 'P2 assigned: attack_probability=' || {_f4('p')} || ', CI_width=' || {_f4('width')} || ' (> 0.15) — wide confidence interval indicates uncertainty.'
   WHEN h >= 0.5 THEN 'P2 assigned: attack_probability=' || {_f4('p')} || ', CI_width=' || {_f4('width')} || ', entropy_normalized=' || {_f4('h')} || ' (>= 0.5) — high entropy indicates uncertainty.'
   ELSE 'P2 assigned: attack_probability=' || {_f4('p')} || ', CI_width=' || {_f4('width')} || ' — probability in ambiguous range.' END AS ai_reason,
  array_to_string(list_filter([CASE WHEN p >= 0.05 THEN 'attack' END, CASE WHEN p <= 0.95 THEN 'benign' END], lambda x: x IS NOT NULL), ',') AS ai_labels
FROM b"""


def miss_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Miss advice from a logit of every score."""
    s = t.scored(spark, sf_dir)
    return s.select("model", "id", *[c.alias(n) for n, c in advice.miss_columns((F.col("p") - 0.5) * 12).items()])


MISS_ADVICE = f"""WITH {t.SCORED_SQL}, s AS (SELECT model, id, 1 / (1 + exp(-((p - 0.5) * 12))) AS q FROM scored),
e AS (SELECT *, -(q * log2(q + 1e-9) + (1 - q) * log2(1 - q + 1e-9)) AS h FROM s)
SELECT model, id, round(q, 6) AS attack_probability, round((1 - h) * 100, 2) AS confidence_score,
  CASE WHEN q >= 0.8 THEN 'P1' WHEN q >= 0.5 THEN 'P2' ELSE 'P3' END AS recommended_priority,
  CASE WHEN q >= 0.8 THEN 'High' WHEN q >= 0.5 THEN 'Moderate' ELSE 'Low' END || ' probability miss detection' AS priority_reasoning,
  round(h, 4) AS entropy FROM e"""


def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five strongest contributions per labelled document, from quasi-random signed values."""
    s = t.scored(spark, sf_dir).where(F.col("model") == "m1")
    names = ["uri_length", "body_length", "shannon_entropy", "anomaly_score", "rule_942100", "query_param_count", "mystery"]
    values = {n: (F.pmod(F.col("id") * k, F.lit(41)) - 20) / 10.0 for n, k in zip(names, (3, 7, 11, 13, 17, 19, 23), strict=True)}
    top = advice.top_contributions(training.contributions(values))
    return s.select("id", F.posexplode(top).alias("pos", "c")).select("id", "pos", "c.name", "c.grp", "c.value", "c.direction")


TOP_CONTRIBUTIONS = f"""WITH {t.SCORED_SQL}, n(name, grp, k) AS (VALUES ('uri_length', 'request_structure', 3), ('body_length', 'request_structure', 7),
  ('shannon_entropy', 'payload_statistical', 11), ('anomaly_score', 'anomaly_score', 13), ('rule_942100', 'rule', 17),
  ('query_param_count', 'request_structure', 19), ('mystery', 'unknown', 23)),
v AS (SELECT id, name, grp, ((id * k) % 41 - 20) / 10.0 AS value FROM scored, n WHERE model = 'm1'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, name) - 1 AS pos FROM v)
SELECT id, CAST(pos AS INT) AS pos, name, grp, value::DOUBLE AS value, CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM r WHERE pos < 5"""

QUERIES = {
    "classification_rates": (classification_rates, CLASSIFICATION_RATES),
    "family_rates": (family_rates, FAMILY_RATES),
    "family_matrix": (family_matrix, FAMILY_MATRIX),
    "confusion_matrix": (confusion_matrix, CONFUSION_MATRIX),
    "ranking_areas": (ranking_areas, RANKING_AREAS),
    "roc_points": (roc_points, ROC_POINTS),
    "roc_corners": (roc_corners, ROC_CORNERS),
    "pr_points": (pr_points, PR_POINTS),
    "calibration": (calibration, CALIBRATION),
    "reliability_curve": (reliability_curve, RELIABILITY_CURVE),
    "probability_histogram": (probability_histogram, PROBABILITY_HISTOGRAM),
    "model_metrics": (model_metrics, MODEL_METRICS),
    "best_per_metric": (best_per_metric, BEST_PER_METRIC),
    "bootstrap_interval": (bootstrap_interval, BOOTSTRAP_INTERVAL),
    "class_weights": (class_weights, CLASS_WEIGHTS),
    "advisory_columns": (advisory_columns, ADVISORY_COLUMNS),
    "miss_advice": (miss_advice, MISS_ADVICE),
    "top_contributions": (top_contributions, TOP_CONTRIBUTIONS),
}
