"""As-of, interval, catalog and key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BODY_TTL_SECONDS = 300
REPLAY_WINDOW_SECONDS = 5
SLICE_SECONDS = 60
MICROS = 1_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    right_seq: str,
    values: list[str],
    tolerance_us: int,
    direction: str = "backward",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Left rows with the nearest right row of the same key, at most ``tolerance_us`` away.

    ``backward`` takes the last right row at or before the left time (on equal times the highest
    ``right_seq``), ``forward`` the first at or after it (the lowest). Times are TIMESTAMP columns.

    No pairs are formed. Both sides are cut into time slices of a key, and a window inside the slice
    finds the nearest row; when the slice has none, the nearest row of the neighbouring slices within
    reach is carried over from a table of one row per key and slice. A hot key is thus spread over
    its slices, and what is carried grows with time, not with rows.
    """
    sign = 1 if direction == "backward" else -1
    width = slice_seconds * MICROS
    reach = -(-tolerance_us // width) + 1

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c)) * sign

    keys = [F.col(k) for k in on]
    present = F.lit(True)
    for k in keys:
        present = present & k.isNotNull()
    payload = F.struct(micros(right_ts).alias("_rt"), *[F.col(v) for v in values])
    right_rows = right.where(present & F.col(right_ts).isNotNull()).select(
        *keys, micros(right_ts).alias("_t"), F.lit(0).alias("_side"),
        (F.col(right_seq).cast("bigint") * sign).alias("_seq"), payload.alias("_r"),
    )
    row = F.struct(*[F.col(c) for c in left.columns])
    left_rows = left.select(
        *keys, micros(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_seq"),
        row.alias("_l"),
    )
    both = left_rows.unionByName(right_rows, allowMissingColumns=True).withColumn(
        "_slice", F.floor(F.col("_t") / width)
    )

    inside = (
        W.partitionBy(*on, "_slice").orderBy("_t", "_side", "_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    found = both.withColumn("_near", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")

    slices = both.groupBy(*on, "_slice").agg(
        F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_seq"))).alias("_last")
    )
    earlier = W.partitionBy(*on).orderBy("_slice").rangeBetween(-reach, -1)
    carried = slices.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")

    nearest = F.coalesce(F.col("_near"), F.col("_carried"))
    joined = found.join(carried, [*on, "_slice"], "left")
    usable = (F.col("_t") - nearest["_rt"]) <= tolerance_us
    return joined.select("_l.*", *[F.when(usable, nearest[v]).alias(v) for v in values])


def fill_bodies(alerts: DataFrame, bodies: DataFrame, seq: str) -> DataFrame:
    """Alerts with an empty body take the latest access-log body of the same method and URI,
    younger than five minutes. ``bodies`` holds method, uri, ts, ``seq`` and body."""
    cached = bodies.where(F.col("body") != "").withColumnRenamed("body", "cached_body")
    empty = F.coalesce(F.col("body"), F.lit("")) == ""
    filled = asof_join(
        alerts.where(empty), cached, ["method", "uri"], "ts", "ts", seq, ["cached_body"],
        BODY_TTL_SECONDS * MICROS - 1,
    )
    body = F.coalesce(F.col("cached_body"), F.col("body"))
    length = F.when(F.col("cached_body").isNotNull(), F.octet_length("cached_body"))
    columns = {"body": body}
    if "body_length" in alerts.columns:
        columns["body_length"] = F.coalesce(length, F.col("body_length"))
    return filled.withColumns(columns).drop("cached_body").unionByName(alerts.where(~empty))


#: Characters of the pieces that a contained text and its container share.
GRAM = 3
#: Log places in a slice when entries without a time take that of the entry before.
PLACES_PER_SLICE = 60_000


def _grams(text: Column) -> Column:
    """Distinct pieces of GRAM characters, and an empty one that every text has."""
    n = F.char_length(text)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.filter(pieces, lambda p: F.char_length(p) == GRAM)))


def _own_gram(text: Column) -> Column:
    """One piece of a text, by hash, so that common beginnings do not all ask for the same; empty for a shorter text."""
    return F.array_max(F.transform(F.slice(_grams(text), 2, 1 << 30), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]


def entry_times(entries: DataFrame, seq: str, ts: str = "entry_ts") -> DataFrame:
    """Entries whose time is missing take that of the last entry before them in the log, the first ones the log's first.

    The log is cut into slices of places; a slice takes over one row from the slices before it.
    """
    place = F.timestamp_micros((F.col(seq) * (SLICE_SECONDS * MICROS // PLACES_PER_SLICE)).cast("bigint"))
    placed = entries.withColumns({"_log": F.lit(0), "_place": place})
    timed = F.col(ts).isNotNull()
    known = placed.where(timed).select("_log", "_place", F.col(seq).alias("_seq"), F.col(ts).alias("_before"))
    filled = asof_join(placed.where(~timed), known, ["_log"], "_place", "_place", "_seq", ["_before"], 1 << 60)
    first = F.broadcast(known.agg(F.min("_before").alias("_first")))  # one row
    filled = filled.crossJoin(first).withColumn(ts, F.coalesce("_before", "_first")).drop("_before", "_first")
    return placed.where(timed).unionByName(filled).drop("_log", "_place")


def match_replay(
    requests: DataFrame,
    entries: DataFrame,
    seq: str,
    values: list[str],
    window_seconds: int = REPLAY_WINDOW_SECONDS,
) -> DataFrame:
    """Replayed requests with the first audit entry in the log, within the window, whose URI contains the request path.

    ``requests`` holds uri and sent_at, ``entries`` entry_uri, entry_ts, ``seq`` (log order) and ``values``. Targets may
    be absolute or lack a slash; an entry without a time counts with that of the entry before it.

    Containment becomes an equality: all pieces of a contained text are among those of its container, so a request asks
    for one piece of its path, and an entry answers with its pieces, as many as it has characters, of which only those
    that are asked for go on. Request and entry meet by piece and time slot; containment and the window are tested then.
    """
    slot = window_seconds * MICROS
    row = F.struct(*requests.columns)
    sent = requests.select(
        F.monotonically_increasing_id().alias("_id"), row.alias("_row"), F.substring_index("uri", "?", 1).alias("_path"),
        F.unix_micros("sent_at").alias("_sent")
    ).withColumn("_gram", F.coalesce(_own_gram(F.col("_path")), F.lit("")))
    asked = requests.select(F.coalesce(_own_gram(F.substring_index("uri", "?", 1)), F.lit("")).alias("_gram")).distinct()
    answers = (
        entry_times(entries, seq).select("entry_uri", F.unix_micros("entry_ts").alias("_at"), F.struct(seq, *[v for v in values if v != seq]).alias("_e"))
        .withColumn("_gram", F.explode(_grams(F.coalesce("entry_uri", F.lit("")))))
        .join(asked, "_gram", "left_semi")
        .withColumn("_slot", F.floor(F.col("_at") / slot))
        .withColumnRenamed("_gram", "_g")
    )
    slots = sent.withColumn("_near", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("_sent") / slot) + d)))
    meets = (
        (F.col("_gram") == F.col("_g")) & (F.col("_near") == F.col("_slot")) & F.col("entry_uri").contains(F.col("_path"))
        & (F.abs(F.col("_at") - F.col("_sent")) <= slot)
    )
    found = slots.join(answers, meets, "left").groupBy("_id").agg(F.first("_row").alias("_row"), F.min("_e").alias("_e"))
    return found.select("_row.*", *[F.col(f"_e.{v}").alias(v) for v in values])


def matched_only(replayed: DataFrame, entry: str) -> DataFrame:
    """Replayed requests that have an audit entry; the others tell nothing about the firewall and are left out."""
    return replayed.where(F.col(entry).isNotNull())


def apply_overrides(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rule catalog with the latest override of each rule; an override wins.

    Overrides are reduced to one row per catalog id before the join.
    """
    latest = (
        overrides.join(catalog.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.max_by("enabled", "updated_at").alias("_enabled"), F.max("updated_at").alias("updated_at"))
    )
    return catalog.join(latest, "id", "left").withColumn("enabled", F.coalesce("_enabled", "enabled")).drop("_enabled")


def valid_rule_updates(updates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Updates of numeric ids the catalog knows."""
    return updates.where(F.col("id").rlike("^[0-9]+$")).join(catalog.select("id"), "id", "left_semi")


def rejected_rule_updates(updates: DataFrame, catalog: DataFrame) -> DataFrame:
    """The other updates, with the reason."""
    numeric = F.col("id").rlike("^[0-9]+$")
    reason = F.when(F.trim("id") == "", "rule id is required").when(~numeric, "invalid rule id format")
    return updates.join(catalog.select("id"), "id", "left_anti").withColumn(
        "reason", F.coalesce(reason, F.lit("rule not found"))
    )


def without_enriched(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts whose key is not stored as enriched yet."""
    done = stored.where(F.col("ai_status") == "enriched").select("alert_key")
    return alerts.join(done, "alert_key", "left_anti")


def zero_filled(counts: DataFrame, scaffold: DataFrame, on: str, measures: list[str]) -> DataFrame:
    """Every scaffold bucket with its measures, zero where nothing was counted."""
    joined = scaffold.join(counts, on, "left")
    return joined.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in measures})


def rule_value(details: Column, rule_id: Column, name: str) -> Column:
    """Severity or message of a rule in a details array; the last entry of an id wins."""
    hits = F.filter(details, lambda d: d["rule_id"] == rule_id)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)[name])


def name_sets(training: DataFrame, serving: DataFrame, name: str) -> DataFrame:
    """Distinct names of two tables and where they stand: ``training``, ``serving`` or ``both``; nulls are no names.

    One sum over both tables, formed before the shuffle, so a name that fills a table is one row of each task.
    """
    both = training.select(name, F.lit(1).alias("_t"), F.lit(0).alias("_s")).unionByName(serving.select(name, F.lit(0).alias("_t"), F.lit(1).alias("_s")))
    seen = both.where(F.col(name).isNotNull()).groupBy(name).agg(F.max("_t").alias("_t"), F.max("_s").alias("_s"))
    return seen.select(name, F.when(F.col("_s") == 0, "training").when(F.col("_t") == 0, "serving").otherwise("both").alias("side"))


def contract_differences(training: DataFrame, serving: DataFrame) -> DataFrame:
    """One row per difference between two feature contracts: feature, kind, message."""
    names = ["type", "grp", "range_min", "range_max", "version"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("feature", F.lit(True).alias(f"{tag}_has"), *[F.col(n).alias(f"{tag}_{n}") for n in names])

    both = side(training, "t").join(side(serving, "s"), "feature", "full_outer")
    feature = F.col("feature")

    def differs(n: str) -> Column:
        return F.col("t_has").isNotNull() & F.col("s_has").isNotNull() & ~F.col(f"t_{n}").eqNullSafe(F.col(f"s_{n}"))

    def shown(n: str) -> Column:
        return F.coalesce(F.col(n).cast("string"), F.lit("None"))

    def mismatch(kind: str, t: Column, s: Column) -> Column:
        return F.concat(F.lit("Feature '"), feature, F.lit(f"' {kind} mismatch: training="), t, F.lit(", serving="),
                        s, F.lit("."))

    def span(tag: str) -> Column:
        return F.concat(F.lit("["), shown(f"{tag}_range_min"), F.lit(", "), shown(f"{tag}_range_max"), F.lit("]"))

    def present_in(here: str, there: str) -> Column:
        return F.concat(F.lit("Feature '"), feature,
                        F.lit(f"' present in {here} schema but missing from {there} schema."))

    def finding(kind: str, when: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), message.alias("message")))

    findings = F.array(
        finding("missing_in_serving", F.col("s_has").isNull(), present_in("training", "serving")),
        finding("missing_in_training", F.col("t_has").isNull(), present_in("serving", "training")),
        finding("type", differs("type"), mismatch("type", shown("t_type"), shown("s_type"))),
        finding("group", differs("grp"), mismatch("group", shown("t_grp"), shown("s_grp"))),
        finding("range", differs("range_min") | differs("range_max"), mismatch("range", span("t"), span("s"))),
        finding("version", differs("version"), mismatch("version", shown("t_version"), shown("s_version"))),
    )
    return both.select("feature", F.explode(F.array_compact(findings)).alias("f")).select("feature", "f.*")

