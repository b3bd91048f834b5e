"""Classifier metrics, curves and calibration over a long table (model, id, family, y, p).

Every metric but the per-family ones is a function of the count table (model, p, positives, negatives),
so rows are aggregated map-side once and all curves work on distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reqlens.operators.ranking import score_bucket

# Composite weights and lower-is-better metrics.
COMPOSITE = {"f1": 0.4, "ece": 0.3, "auroc": 0.2, "fpr": 0.1}
LOWER_IS_BETTER = ["fpr", "fnr", "ece", "brier_score"]
METRICS = ["accuracy", "precision", "recall", "f1", "auroc", "pr_auc", "fpr", "fnr", "ece", "brier_score"]
BINS = 10
HISTOGRAM_BINS = 50
TIE_TOLERANCE = 1e-9
BOOTSTRAP_REPLICATES = 200
BOOTSTRAP_SEED = 42
#: Bootstrap weights below this number are told apart first.
COMMON_WEIGHTS = 4


def predicted(p: Column) -> Column:
    """1 when the positive class has the larger probability; a tie is negative."""
    return (p > 0.5).cast("int")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per model and distinct score."""
    return scored.groupBy("model", "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )


def _confusion(pos: Column, neg: Column, hit: Column) -> dict[str, Column]:
    def total(when: Column, n: Column) -> Column:
        return F.sum(F.when(when, n).otherwise(0))

    return {"tp": total(hit, pos), "fp": total(hit, neg), "fn": total(~hit, pos), "tn": total(~hit, neg)}


def confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn per group."""
    hit = predicted(F.col("p")) == 1
    cells = _confusion(F.col("y"), 1 - F.col("y"), hit)
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "y", predicted(F.col("p")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def rate_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }


def classification_rates(scored: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, FPR and FNR per model; a zero denominator gives 0."""
    counted = confusion(scored, ["model"])
    return counted.withColumns(rate_columns())


def family_rates(scored: DataFrame) -> DataFrame:
    """FPR, FNR and rows per model and family."""
    counted = confusion(scored, ["model", "family"])
    rates = rate_columns()
    return counted.select(
        "model", "family", rates["fpr"].alias("fpr"), rates["fnr"].alias("fnr"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows"),
    )


def family_matrix(scored: DataFrame, families: list[str], metric: str = "fnr") -> DataFrame:
    """Models by families; families are named by the caller so the plan needs no extra pass."""
    return family_rates(scored).groupBy("model").pivot("family", families).agg(F.first(metric)).na.fill(0.0, families)


# ---- curves over distinct scores --------------------------------------------


def cumulative_scores(counts: DataFrame) -> DataFrame:
    """Score counts with running totals from the highest score down, per model.

    Adds cum_pos, cum_neg (this score included), total_pos, total_neg, and ``next``, the counts of the
    next lower score (null at the lowest). Scores are ordered in buckets whose
    totals are running-summed separately, so a model with many distinct scores is not ordered in one task.
    """
    keyed = counts.withColumn("_bucket", score_bucket(F.col("p")))
    totals = keyed.groupBy("model", "_bucket").agg(
        F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"), F.max_by(F.struct("pos", "neg"), "p").alias("_top")
    )
    below = W.partitionBy("model").orderBy(F.desc("_bucket"))
    above = W.partitionBy("model").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("model")
    offsets = totals.select(
        "model", "_bucket",
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"),
        F.sum("_bp").over(whole).alias("total_pos"),
        F.sum("_bn").over(whole).alias("total_neg"),
        F.lead("_top").over(below).alias("_next_bucket"),
    )
    inside = W.partitionBy("model", "_bucket").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, W.currentRow)
    next_inside = F.lead(F.struct("pos", "neg")).over(W.partitionBy("model", "_bucket").orderBy(F.desc("p")))
    running = keyed.withColumns(
        {"_ip": F.sum("pos").over(inside), "_in": F.sum("neg").over(inside), "_next": next_inside}
    )
    return running.join(offsets, ["model", "_bucket"]).select(
        "model", "p", "pos", "neg",
        (F.col("_op") + F.col("_ip")).alias("cum_pos"),
        (F.col("_on") + F.col("_in")).alias("cum_neg"),
        "total_pos", "total_neg",
        F.coalesce("_next", "_next_bucket").alias("next"),
    )


def roc_area(cumulative: DataFrame) -> DataFrame:
    """Area under the ROC curve with tied scores counted half; 0 when a class is missing."""
    step = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    area = F.sum(step) / (F.first("total_pos") * F.first("total_neg"))
    both = (F.first("total_pos") > 0) & (F.first("total_neg") > 0)
    return cumulative.groupBy("model").agg(F.when(both, area).otherwise(0.0).alias("auroc"))


def average_precision(cumulative: DataFrame) -> DataFrame:
    """Step-wise area under precision and recall; 0 when a class is missing."""
    gain = F.col("pos") / F.col("total_pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    both = (F.first("total_pos") > 0) & (F.first("total_neg") > 0)
    value = F.sum(F.when(F.col("total_pos") > 0, gain).otherwise(0.0))
    return cumulative.groupBy("model").agg(F.when(both, value).otherwise(0.0).alias("pr_auc"))


def roc_points(cumulative: DataFrame) -> DataFrame:
    """False and true positive rate per threshold; the origin is the threshold nothing reaches (null)."""
    points = cumulative.select(
        "model", F.col("p").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )
    origin = cumulative.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def roc_corners(cumulative: DataFrame) -> DataFrame:
    """ROC points where the curve changes direction, both ends kept; drawing them gives the same curve."""
    nxt = F.col("next")
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    turn = first | nxt.isNull() | (nxt["pos"] != F.col("pos")) | (nxt["neg"] != F.col("neg"))
    return roc_points(cumulative.where(turn))


def pr_points(cumulative: DataFrame) -> DataFrame:
    """Precision and recall per threshold, with the closing point (1, 0)."""
    points = cumulative.select(
        "model", F.col("p").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )
    end = cumulative.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def pr_trapezoid_area(cumulative: DataFrame) -> DataFrame:
    """Trapezoid area under the precision-recall points.

    The point before a score follows from its own totals, so no neighbour has to be fetched.
    """
    pos, cum_pos = F.col("pos"), F.col("cum_pos")
    n, cum_n = F.col("pos") + F.col("neg"), F.col("cum_pos") + F.col("cum_neg")
    here = cum_pos / cum_n
    before = F.when(cum_n > n, (cum_pos - pos) / F.nullif(cum_n - n, F.lit(0))).otherwise(1.0)
    step = ratio(pos, F.col("total_pos")) * (here + before) / 2
    return cumulative.groupBy("model").agg(F.sum(step).alias("pr_trapezoid"))


# ---- calibration ------------------------------------------------------------


def _edges() -> list[float]:
    return [i * (1.0 / BINS) for i in range(1, BINS)]


def _bin_closed_left(p: Column) -> Column:
    """0-based bin with the lower edge included; the top edge belongs to the last bin."""
    index = F.lit(0)
    for e in _edges():
        index = index + (p >= e).cast("int")
    return index


def _bin_closed_right(p: Column) -> Column:
    index = F.lit(0)
    for e in _edges():
        index = index + (p > e).cast("int")
    return index


def _bin_means(counts: DataFrame, bin_of: Column) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    return counts.groupBy("model", bin_of.alias("bin")).agg(
        F.sum(n).alias("n"),
        (F.sum(F.col("p") * n) / F.sum(n)).alias("mean_predicted"),
        (F.sum("pos") / F.sum(n)).alias("fraction_positive"),
    )


def calibration_error(counts: DataFrame) -> DataFrame:
    """Expected calibration error over ten equal bins; empty bins do not count."""
    bins = _bin_means(counts, _bin_closed_left(F.col("p")))
    gap = F.abs(F.col("mean_predicted") - F.col("fraction_positive"))
    return bins.groupBy("model").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def reliability_curve(counts: DataFrame) -> DataFrame:
    """Mean probability and positive share of ten uniform bins; an inner edge belongs to the lower bin."""
    return _bin_means(counts, _bin_closed_right(F.col("p")))


def brier(counts: DataFrame) -> DataFrame:
    loss = F.col("pos") * F.pow(F.col("p") - 1, F.lit(2)) + F.col("neg") * F.pow(F.col("p"), F.lit(2))
    return counts.groupBy("model").agg((F.sum(loss) / F.sum(F.col("pos") + F.col("neg"))).alias("brier_score"))


def probability_histogram(counts: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal bin between the smallest and largest probability of a model."""
    span = counts.groupBy("model").agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    # Equal ends widen by one half on both sides.
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        "model", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    lo, hi, p = F.col("_lo"), F.col("_hi"), F.col("p")
    step = (hi - lo) / bins
    guess = F.least(F.floor((p - lo) / (hi - lo) * bins), F.lit(bins - 1))
    moved = guess - (p < lo + guess * step).cast("int")
    index = moved + ((moved < bins - 1) & (p >= lo + (moved + 1) * step)).cast("int")
    return (
        counts.join(span, "model")
        .groupBy("model", index.alias("bin"))
        .agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
    )


# ---- whole reports -----------------------------------------------------------


def composite(f1: Column, ece: Column, auroc: Column, fpr: Column) -> Column:
    w = COMPOSITE
    return w["f1"] * f1 + w["ece"] * (1 - ece) + w["auroc"] * auroc + w["fpr"] * (1 - fpr)


def all_metrics(scored: DataFrame) -> DataFrame:
    """Every metric of every model, composite score included, from one pass over the rows."""
    counts = score_counts(scored)
    cells = _confusion(F.col("pos"), F.col("neg"), predicted(F.col("p")) == 1)
    rates = counts.groupBy("model").agg(*[c.alias(n) for n, c in cells.items()]).withColumns(rate_columns())
    cumulative = cumulative_scores(counts)
    out = rates.drop("tp", "fp", "fn", "tn")
    parts = (
        roc_area(cumulative), average_precision(cumulative), calibration_error(counts), brier(counts)
    )
    for part in parts:
        out = out.join(part, "model")
    score = composite(*[F.col(c) for c in ("f1", "ece", "auroc", "fpr")])
    return out.select("model", *METRICS).withColumn("composite_score", score)


def rank_models(metrics: DataFrame) -> DataFrame:
    """Candidates by composite score, best first."""
    return metrics.withColumn("rank", F.rank().over(W.orderBy(F.desc("composite_score"))))


def best_per_metric(metrics: DataFrame) -> DataFrame:
    """Long table of metric values with the best one of each metric marked."""
    long = metrics.unpivot(["model"], METRICS, "metric", "value")
    w = W.partitionBy("metric")
    best = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.min("value").over(w)).otherwise(F.max("value").over(w))
    return long.withColumn("is_best", F.abs(F.col("value") - best) < TIE_TOLERANCE)


# ---- resampling --------------------------------------------------------------


def _poisson_limits() -> list[int]:
    """32-bit limits of the Poisson(1) distribution: how many words fall at or below k."""
    limits, term, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += term
        limits.append(int(total * 2**32))
        term /= k + 1
    return limits


def _poisson_weight(digest: Column, word: int) -> Column:
    """Poisson(1) weight from one 32-bit word of a hex digest; hex words compare like their numbers.

    Few weights pass the first limits, so the others are compared only for those. Written out for every word, all
    limits make a method that the virtual machine leaves uncompiled.
    """
    hexed = F.substring(digest, word * 8 + 1, 8)
    limits = [f"{limit:08x}" for limit in _poisson_limits()]
    first, others = limits[:COMMON_WEIGHTS], limits[COMMON_WEIGHTS:]
    weight = F
    for i, limit in enumerate(first):
        weight = weight.when(hexed < limit, i)
    return weight.otherwise(len(first) + F.size(F.filter(F.array(*map(F.lit, others)), lambda limit: hexed >= limit)))


def bootstrap_means(
    scored: DataFrame, replicates: int = BOOTSTRAP_REPLICATES, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """Mean probability per model and bootstrap replicate.

    Row weights are Poisson(1), read from a digest of row id and replicate, so a replicate needs no row
    counts and comes out the same on every run. One digest serves four replicates, and their sums are formed
    map-side: what is shuffled is four sums per model and block, never rows.
    """
    blocks = -(-replicates // 4)
    text = F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)), F.col("block").cast("string"))
    drawn = (
        scored.select("model", "p", "id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        .withColumn("digest", F.md5(text.cast("binary")))
        .select("model", "p", "block", *[_poisson_weight(F.col("digest"), j).alias(f"w{j}") for j in range(4)])
    )
    sums = drawn.groupBy("model", "block").agg(
        *[F.sum(F.col("p") * F.col(f"w{j}")).alias(f"s{j}") for j in range(4)],
        *[F.sum(f"w{j}").alias(f"n{j}") for j in range(4)],
    )
    words = F.array(
        *[
            F.struct((F.col("block") * 4 + j).alias("replicate"), F.try_divide(f"s{j}", f"n{j}").alias("mean_probability"))
            for j in range(4)
        ]
    )
    return sums.select("model", F.explode(words).alias("r")).select("model", "r.*").where(F.col("replicate") < replicates)


def bootstrap_interval(means: DataFrame) -> DataFrame:
    """2.5 and 97.5 percentiles and the mean of the replicate means."""
    cuts = F.percentile("mean_probability", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("model").agg(
        F.count(F.lit(1)).alias("b"), cuts.alias("_q"), F.avg("mean_probability").alias("mean")
    ).select("model", "b", F.col("_q")[0].alias("quantile_low"), F.col("_q")[1].alias("quantile_high"), "mean")

