"""Quality rules: base statistics of a text, and robust multivariate outliers among the texts of its kind.

A text is described by a vector of transformed statistics in whole thousandths. For every language and source the
minimum covariance determinant is estimated by concentration: from medians and median deviations, then in rounds that
keep the KEPT share of the group nearest by Mahalanobis distance and estimate mean and covariance from them, corrected
for the share and reweighted once. Texts beyond the chi-square quantile are rejected.

A round is one grouped sum: distances fall in fine bins, moments are summed by bin, and bins are added up to the one
that completes the share. Sums are of whole numbers, so the order in which tasks end does not matter.

Only texts that pass the base rules are estimated from and judged; the others fail. Groups of fewer than LEAST texts
are pooled with the other small groups of their language, and if that is too few, of all languages. Null language or
source is a value of its own. Null and empty texts have no words and fail the base rules. Repeated rows count as often
as they occur. A statistic that hardly varies has the least deviation FLOOR, so that no covariance is singular.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.functions.binding import let
from reqlens.llm.common import join_same
from reqlens.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Share kept, rounds, least texts of a group, tail probability of a rejection, least deviation, unit of a statistic.
KEPT, ROUNDS, LEAST, TAIL, FLOOR, UNIT = 0.75, 6, 100, 1e-7, 0.35, 1000
#: Transformed statistics, in the order of the vector; their number must be even (chi_square).
STATISTICS = ["length", "word_length", "symbols", "dup_lines", "repeats", "capitals"]
#: Bins of a distance d: floor(BINS * log2(1 + d)).
BINS = 32


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """Words covered by a window of ``size`` words that occurs at least twice in the text."""
    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            near = lambda p, k: F.coalesce(F.get(s, k)["x"] == p["x"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda p, k: near(p, k - 1) | near(p, k + 1)), lambda p: p["i"]))

        def total(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, starts), total))

    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(n < size, F.lit(0)).otherwise(let(windows, covered))


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the count of capitals."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    counts = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    out = df.withColumn("_counts", counts)
    out = out.withColumn("n_words", F.col("_counts.n").cast("long"))
    out = out.withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = out.withColumn("n_repeat_words", F.col("_counts.r").cast("long"))
    out = out.withColumn("n_capitals", (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_counts")


def transformed() -> dict[str, Column]:
    """The statistic vector in thousandths, from the base statistics."""
    percent = lambda part, whole: F.log1p(100.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    share = lambda part: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col("n_words"), F.lit(1)))))
    vector = {
        "length": F.log1p("n_words") / 2, "word_length": 4 * F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": percent("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines"),
        "repeats": share("n_repeat_words"), "capitals": percent("n_capitals", "word_chars"),
    }
    return {k: F.round(vector[k] * UNIT).cast("long") for k in STATISTICS}


def chi_square(x: float, p: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(tail: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi_square(mid, p) > tail else (low, mid)
    return high


def _pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the group they are estimated in: g0, g1 and the level of pooling."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    language = Window.partitionBy(keys[0])
    small = F.col("_n") < LEAST
    sizes = sizes.withColumn("_small", F.sum(F.when(small, F.col("_n")).otherwise(0)).over(language))
    level = F.when(~small, 0).when(F.col("_small") >= LEAST, 1).otherwise(2)
    return cut_lineage(sizes.withColumn("level", level).select(*keys, "level"), "pools")


def _moments(rows: DataFrame, group: list[str]) -> DataFrame:
    """Sums of the vector and of its products by group and distance bin."""
    p = STATISTICS
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(a).alias(f"s_{a}") for a in p]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(p) for b in p[: i + 1]]
    return rows.groupBy(*group, "bin").agg(*sums)


def _estimate(moments: DataFrame, group: list[str], share: float | None, scale: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group's bins up to the one that completes the share."""
    p = STATISTICS
    names = ["n"] + [f"s_{a}" for a in p] + [f"s_{a}_{b}" for i, a in enumerate(p) for b in p[: i + 1]]
    order = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = moments
    if share is not None:
        inside = moments.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        inside = inside.withColumn("_all", F.sum("n").over(Window.partitionBy(*group)))
        inside = inside.where(F.col("_before") < F.lit(share) * F.col("_all"))
    total = inside.groupBy(*group).agg(*[F.sum(x).alias(x) for x in names])
    out = total
    for i, a in enumerate(p):
        out = out.withColumn(f"m_{a}", F.col(f"s_{a}") / F.col("n"))
    for i, a in enumerate(p):
        for j, b in enumerate(p[: i + 1]):
            value = scale * (F.col(f"s_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}"))
            if i == j:
                value = value + F.lit((FLOOR * UNIT) ** 2)
            for k in range(j):
                value = value - F.col(f"l_{a}_{p[k]}") * F.col(f"l_{b}_{p[k]}")
            root = F.sqrt(F.greatest(value, F.lit(1.0))) if i == j else value / F.col(f"l_{b}_{b}")
            out = out.withColumn(f"l_{a}_{b}", root)
    return out.select(*group, *[f"m_{a}" for a in p], *[f"l_{a}_{b}" for i, a in enumerate(p) for b in p[: i + 1]])


def _distance(rows: DataFrame, estimate: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``d`` to the estimate of their group."""
    out = join_same(rows, estimate, group)
    p = STATISTICS
    for i, a in enumerate(p):
        value = F.col(a) - F.col(f"m_{a}")
        for k in range(i):
            value = value - F.col(f"l_{a}_{p[k]}") * F.col(f"z_{p[k]}")
        out = out.withColumn(f"z_{a}", value / F.col(f"l_{a}_{a}"))
    d = sum((F.col(f"z_{a}") * F.col(f"z_{a}") for a in p[1:]), F.col(f"z_{p[0]}") * F.col(f"z_{p[0]}"))
    return out.withColumn("d", d).select(rows.columns + ["d"])


def _binned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin", F.floor(F.lit(float(BINS)) * F.log2(1 + F.col("d"))).cast("int"))


def outliers(df: DataFrame, lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """``df`` (with the base statistics) and outlier_distance (null where the base rules fail) and kept."""
    p, group = STATISTICS, ["level", "g0", "g1"]
    rows = df.withColumns(transformed()).withColumn("g0", F.col(f"`{lang}`")).withColumn("g1", F.col(f"`{source}`"))
    rows = cut_lineage(rows, "statistics")
    good = rows.where("not base_failed")
    pools = _pooled(good, ["g0", "g1"])
    placed = join_same(good.select("g0", "g1", *p), pools, ["g0", "g1"])
    placed = placed.withColumn("g1", F.when(F.col("level") == 0, F.col("g1"))).withColumn("g0", F.when(F.col("level") < 2, F.col("g0")))
    middle = placed.groupBy(*group).agg(*[F.percentile(F.floor(F.col(a) / 10), 0.5).alias(f"m_{a}") for a in p])
    middle = cut_lineage(middle, "medians")
    off = lambda a: F.abs(F.col(a) / 10 - F.col(f"m_{a}"))
    spread = join_same(placed, middle, group).groupBy(*group).agg(
        *[F.percentile(F.floor(off(a)), 0.5).alias(f"d_{a}") for a in p], *[F.first(f"m_{a}").alias(f"m_{a}") for a in p])
    spread = cut_lineage(spread, "deviations")
    first = sum((F.pow(off(a) / (1.4826 * F.col(f"d_{a}") + FLOOR * UNIT / 10), 2) for a in p[1:]),
                F.pow(off(p[0]) / (1.4826 * F.col(f"d_{p[0]}") + FLOOR * UNIT / 10), 2))
    near = join_same(placed, spread, group).withColumn("d", first).select(*group, *p, "d")
    dims = len(p)
    correct = KEPT / chi_square(chi_square_quantile(1 - KEPT, dims), dims + 2)
    for _ in range(ROUNDS):
        estimate = cut_lineage(_estimate(_moments(_binned(near), group), group, KEPT, correct), "estimate")
        near = _distance(placed, estimate, group)
    cut = chi_square_quantile(0.025, dims)
    correct = 0.975 / chi_square(cut, dims + 2)
    core = near.where(F.col("d") <= cut).withColumn("bin", F.lit(0))
    final = cut_lineage(_estimate(_moments(core, group), group, None, correct), "estimate")
    judged = join_same(rows, pools, ["g0", "g1"], "left")
    judged = judged.withColumn("g1", F.when(F.col("level") == 0, F.col("g1"))).withColumn("g0", F.when(F.col("level") < 2, F.col("g0")))
    fine = judged.where("not base_failed")
    fine = _distance(fine, final, group).withColumnRenamed("d", "outlier_distance")
    failed = judged.where("base_failed").withColumn("outlier_distance", F.lit(None).cast("double"))
    both = fine.unionByName(failed).withColumn("kept", F.coalesce(F.col("outlier_distance") <= chi_square_quantile(tail, dims), F.lit(False)))
    return both.drop(*group, *p)
