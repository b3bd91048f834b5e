"""Exact ranks and running sums without gathering a group in one task.

Rows are cut into ordered buckets inside their group. Per-bucket totals are
small, so their running sum is cheap; the final value is that offset plus the
rank inside the bucket. A group holding a third of all rows is then spread over
as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DIGEST_BUCKETS = 4096


def digest_bucket(digest: Column) -> Column:
    """Leading 12 bits of a hex digest: equal-sized buckets in digest order."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def distributed_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Add the row number within ``group`` by (``bucket``, ``order``) and the group size ``{out}_of``.

    ``bucket`` must be non-decreasing in the order wanted.
    """
    totals = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    by_bucket = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col(bucket).alias("_g_bucket"),
        F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*group)).alias(f"{out}_of"),
    )
    inside = W.partitionBy(*group, bucket).orderBy(*order)
    ranked = df.withColumn("_inside", F.row_number().over(inside))
    match = F.col(bucket) == F.col("_g_bucket")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        ranked.join(offsets, match)
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_inside", "_before", "_g_bucket", *[f"_g_{g}" for g in group])
    )


def score_bucket(p: Column) -> Column:
    """Ordered bucket of a probability, finer towards 0 and 1 where classifier scores pile up."""
    odds = (p + 1e-12) / (1 - p + 1e-12)
    return F.floor(F.log(odds) * 64).cast("int")


# ---- cuts ---------------------------------------------------------------------

SMALL_ROWS = 50_000


def fetch_small(df: DataFrame, limit: int = SMALL_ROWS) -> list[Row] | None:
    """Rows of a table that is expected to be small, or None when it holds more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def local_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The table as a broadcastable local copy when its size allows, else unchanged."""
    rows = fetch_small(df, limit)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def digest_cuts(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """Digest and key of the rows at given ranks of each group.

    ``narrow`` holds grp, digest and key; ``wanted`` holds grp, cut and rank (1-based by digest, key) and is
    small. Ranks are located by bucket counts, and only the rows of the buckets hit are ordered, so finding a
    cut never sorts a group and never moves a payload. Returns grp, cut, digest, key.
    """
    keyed = narrow.withColumn("bucket", digest_bucket(F.col("digest")))
    counts = keyed.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("grp").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    placed = counts.withColumn("before", before)
    hit = (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n"))
    targets = placed.join(local_small(wanted), "grp").where(hit).select(
        "grp", "bucket", "cut", (F.col("rank") - F.col("before")).alias("inner")
    )
    targets = local_small(targets)
    buckets = targets.select("grp", "bucket").distinct()
    inside = W.partitionBy("grp", "bucket").orderBy("digest", "key")
    ordered = keyed.join(local_small(buckets), ["grp", "bucket"], "left_semi").withColumn("_i", F.row_number().over(inside))
    return ordered.join(targets, ["grp", "bucket"]).where(F.col("_i") == F.col("inner")).select("grp", "cut", "digest", "key")


def at_or_before(digest: Column, key: Column, cut_digest: Column, cut_key: Column) -> Column:
    return (digest < cut_digest) | ((digest == cut_digest) & (key <= cut_key))
