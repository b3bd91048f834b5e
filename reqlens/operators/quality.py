"""Dataset gates, stratified split, sampling and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.functions.hashing import seeded_digest
from reqlens.operators.ranking import at_or_before, digest_cuts, fetch_small, local_small
from reqlens.schemas import ENRICHED_REQUEST, REQUIRED_FIELDS, columns_of

MISSING_LIMIT = 0.05
SMALL_FAMILY = 3
SEED = 42
SAMPLE_IDS = 10


def with_required_fields(df: DataFrame) -> DataFrame:
    """Add the required columns that are absent, as nulls."""
    absent = {n: F.lit(None).cast(t) for n, t in columns_of(ENRICHED_REQUEST) if n not in df.columns}
    return df.withColumns(absent) if absent else df


def any_missing(fields: list[str] = REQUIRED_FIELDS) -> Column:
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    return missing


def completeness(df: DataFrame, fields: list[str] = REQUIRED_FIELDS) -> DataFrame:
    whole = F.avg((~any_missing(fields)).cast("double")) * 100
    return df.agg(F.round(F.coalesce(whole, F.lit(0.0)), 4).alias("feature_completeness_pct"))


def id_groups(df: DataFrame) -> DataFrame:
    """One row per request id: rows sharing it, and whether their labels differ."""
    differ = F.coalesce(F.min("label") != F.max("label"), F.lit(False))
    return df.groupBy("request_id").agg(F.count(F.lit(1)).alias("rows"), differ.alias("conflict"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    return id_groups(df).where("rows > 1").select("request_id", "rows")


def label_conflicts(df: DataFrame) -> DataFrame:
    return id_groups(df).where("conflict").select("request_id", "rows")


def gate_counts(df: DataFrame, fields: list[str] = REQUIRED_FIELDS) -> DataFrame:
    """Rows, rows with a missing field, rows sharing an id, ids with conflicting labels."""
    per_id = df.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_missing(fields)).alias("missing"),
        F.coalesce(F.min("label") != F.max("label"), F.lit(False)).alias("conflict"),
    )

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return per_id.agg(
        total(F.col("rows")).alias("total"),
        total(F.col("missing")).alias("missing"),
        total(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)).alias("duplicates"),
        F.count_if("conflict").alias("conflicts"),
    )


def run_gates(df: DataFrame, fields: list[str] = REQUIRED_FIELDS) -> DataFrame:
    """One row per failed gate: gate, affected, message. No rows means the dataset may be built."""
    counts = gate_counts(df, fields).withColumn("_k", F.lit(1))

    def sample(ids: DataFrame, name: str) -> DataFrame:
        few = ids.select("request_id").orderBy("request_id").limit(SAMPLE_IDS)
        listed = F.array_join(F.sort_array(F.collect_list("request_id")), "', '")
        return few.agg(F.concat(F.lit("['"), listed, F.lit("']")).alias(name), F.lit(1).alias("_k"))

    row = (
        counts.join(sample(duplicate_ids(df), "_dups"), "_k").join(sample(label_conflicts(df), "_confs"), "_k")
    )
    pct = F.col("missing") / F.col("total")

    def failure(when: Column, gate: str, affected: str, message: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(gate).alias("gate"), F.col(affected).alias("affected"), message.alias("message"))
        )

    failures = F.array_compact(
        F.array(
            failure(
                (F.col("total") > 0) & (pct > MISSING_LIMIT), "MISSING_FIELDS", "missing",
                F.format_string(
                    "MISSING_FIELDS: %d/%d rows (%.1f%%) are missing required fields — threshold is 5%%",
                    "missing", "total", pct * 100,
                ),
            ),
            failure(
                F.col("duplicates") > 0, "DUPLICATE_IDS", "duplicates",
                F.format_string(
                    "DUPLICATE_IDS: %d rows share duplicate request_id values (sample: %s)", "duplicates", "_dups"
                ),
            ),
            failure(
                F.col("conflicts") > 0, "LABEL_CONFLICTS", "conflicts",
                F.format_string(
                    "LABEL_CONFLICTS: %d request_id(s) have conflicting labels (sample: %s)", "conflicts", "_confs"
                ),
            ),
        )
    )
    return row.select(F.explode(failures).alias("f")).select("f.*")


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("attack_family").agg(F.count(F.lit(1)).alias("rows"))


def small_families(df: DataFrame) -> DataFrame:
    return family_counts(df).where(F.col("rows") < SMALL_FAMILY)


def _held_out(n: Column) -> tuple[Column, Column]:
    """Rows outside training, and test rows among them, of a stratum of ``n`` rows."""
    held = F.when(n < SMALL_FAMILY, n - 1).otherwise(F.greatest(F.floor((n * 3 + 9) / 10), F.lit(2)))
    return held, F.when(held < 2, 0).otherwise(F.floor((held + 1) / 2))


def stratified_split(df: DataFrame, seed: int = SEED, key: str = "request_id") -> DataFrame:
    """Add ``split``: 70/15/15 within each attack family, by rank of a seeded digest of the id.

    Families below three rows share one stratum. Only ids and families are counted and ordered, and of those
    only the digest buckets that hold a cut; the rows themselves are compared with the cuts where they lie, so
    neither a large family nor a wide row is shuffled. The ranks are exact and a rerun gives the same split.
    """
    family = F.coalesce("attack_family", F.lit(""))
    sizes = df.groupBy(family.alias("_family")).agg(F.count(F.lit(1)).alias("_n"))
    large = local_small(sizes.where(F.col("_n") >= SMALL_FAMILY).select("_family", F.concat(F.lit("f|"), "_family").alias("grp")))
    stratum = F.coalesce("grp", F.lit("s|"))

    def strata(rows: DataFrame) -> DataFrame:
        joined = rows.join(large, family == F.col("_family"), "left").drop("_family")
        return joined.withColumns({"grp": stratum, "_digest": seeded_digest(F.col(key), seed)})

    narrow = strata(df.select(key, "attack_family")).select("grp", F.col("_digest").alias("digest"), F.col(key).alias("key"))
    held, test = _held_out(F.col("n"))
    n = narrow.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    ranks = F.array(
        F.struct(F.lit("train").alias("cut"), (F.col("n") - held).alias("rank")),
        F.struct(F.lit("validation").alias("cut"), (F.col("n") - test).alias("rank")),
    )
    wanted = n.select("grp", F.explode(ranks).alias("r")).select("grp", "r.cut", "r.rank")
    at = F.struct("digest", "key")
    cuts = digest_cuts(narrow, wanted).groupBy("grp").agg(
        *[F.max(F.when(F.col("cut") == c, at)).alias(f"_{c}") for c in ("train", "validation")]
    )

    def within(cut: str) -> Column:
        c = F.col(f"_{cut}")
        return F.coalesce(at_or_before(F.col("_digest"), F.col(key), c["digest"], c["key"]), F.lit(False))

    split = F.when(within("train"), "train").when(within("validation"), "validation").otherwise("test")
    return strata(df).join(local_small(cuts), "grp").withColumn("split", split).drop(
        "grp", "_digest", "_train", "_validation"
    )


def split_distribution(df: DataFrame) -> DataFrame:
    """Rows per split and label, with subtotals per split and overall (null stands for all)."""
    return df.rollup("split", "label").agg(F.count(F.lit(1)).alias("rows"))


def sample_per_family(df: DataFrame, family: str | None, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows of an attack family (all families when None) in seeded random order.

    The digest of the n-th row is found first and the rows are filtered by it, so ``n`` may be large and no
    row is moved.
    """
    chosen = df if family is None else df.where(F.col("attack_family") == family)
    digest, key = seeded_digest(F.col("request_id"), seed), F.col("request_id")
    narrow = chosen.select(F.lit(1).alias("grp"), digest.alias("digest"), key.alias("key"))
    total = narrow.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    wanted = total.select("grp", F.lit("last").alias("cut"), F.least(F.col("n"), F.lit(n)).alias("rank"))
    last = fetch_small(digest_cuts(narrow, wanted))
    if not last:
        return chosen.limit(0)
    return chosen.where(at_or_before(digest, key, F.lit(last[0].digest), F.lit(last[0].key)))


def content_hash(df: DataFrame) -> Column:
    """Order-free hash of all rows; maps are hashed as sorted entries."""
    parts = []
    for field in df.schema.fields:
        c = F.col(field.name)
        parts.append(F.array_sort(F.map_entries(c)) if field.dataType.typeName() == "map" else c)
    return F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))


def manifest(df: DataFrame, fields: list[str] = REQUIRED_FIELDS) -> DataFrame:
    """One row describing a split dataset: counts, label distribution, completeness, content hash."""
    splits = ["train", "validation", "test"]
    whole = F.avg((~any_missing(fields)).cast("double")) * 100
    cells = [
        F.count_if((F.col("split") == s) & (F.col("label") == v)).alias(f"{s}_{v}")
        for s in splits
        for v in ("attack", "benign")
    ]
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in splits],
        *cells,
        F.round(F.coalesce(whole, F.lit(0.0)), 4).alias("feature_completeness_pct"),
        content_hash(df).cast("string").alias("content_hash"),
        F.current_timestamp().alias("created_at"),
    )
