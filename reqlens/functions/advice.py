"""Advisory columns around a probability: interval, entropy, confidence, priority, reason, label set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqlens.functions.binding import let

# Limits of the priority bands, of the label set and of the miss bands.
P1_FROM, P3_TO, MAX_WIDTH, HIGH_ENTROPY = 0.90, 0.10, 0.15, 0.5
ATTACK_FROM, BENIGN_TO = 0.05, 0.95
MISS_P1_FROM, MISS_P2_FROM, MISS_WIDTH = 0.8, 0.5, 0.5
FALLBACK_OFFSET = 0.1
LEVEL = 0.95
#: Strongest contributions that are shown.
TOP = 5


def confidence_interval(p: Column, low_offset: Column, high_offset: Column) -> Column:
    """``STRUCT<low,high>`` of the probability shifted by the bootstrap offsets and clipped to [0, 1]."""
    low = F.greatest(F.lit(0.0), p + F.coalesce(low_offset, F.lit(-FALLBACK_OFFSET)))
    high = F.least(F.lit(1.0), p + F.coalesce(high_offset, F.lit(FALLBACK_OFFSET)))
    return F.struct(F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def interval_width(interval: Column) -> Column:
    return F.round(interval["high"] - interval["low"], 4)


def binary_entropy(p: Column) -> Column:
    """Bits, 6 decimals; one bit is the maximum, so this is the normalised entropy too."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.round(-(q * F.log2(q) + (1 - q) * F.log2(1 - q)), 6)


def confidence(entropy: Column) -> Column:
    return F.round((1 - entropy) * 100, 2)


def priority(p: Column, width: Column) -> Column:
    narrow = width <= MAX_WIDTH
    return F.when((p >= P1_FROM) & narrow, "P1").when((p <= P3_TO) & narrow, "P3").otherwise("P2")


def priority_reason(p: Column, width: Column, entropy: Column) -> Column:
    band = priority(p, width)

    def text(pattern: str, *values: Column) -> Column:
        return F.format_string(pattern, *values)

    return (
        F.when(
            band == "P1",
            text(
                "P1 assigned: attack_probability=%.4f (>= 0.90) and CI_width=%.4f (<= 0.15)"
                " — high-confidence attack signal.", p, width,
            ),
        )
        .when(
            band == "P3",
            text(
                "P3 assigned: attack_probability=%.4f (<= 0.10) and CI_width=%.4f (<= 0.15)"
                " — high-confidence benign signal.", p, width,
            ),
        )
        .when(
            width > MAX_WIDTH,
            text(
                "P2 assigned: attack_probability=%.4f, CI_width=%.4f (> 0.15)"
                " — wide confidence interval indicates uncertainty.", p, width,
            ),
        )
        .when(
            entropy >= HIGH_ENTROPY,
            text(
                "P2 assigned: attack_probability=%.4f, CI_width=%.4f, entropy_normalized=%.4f (>= 0.5)"
                " — high entropy indicates uncertainty.", p, width, entropy,
            ),
        )
        .otherwise(
            text(
                "P2 assigned: attack_probability=%.4f, CI_width=%.4f"
                " — probability in ambiguous range.", p, width,
            )
        )
    )


def label_set(p: Column) -> Column:
    """Labels not ruled out at the 5 % level."""
    return F.array_compact(
        F.array(F.when(p >= ATTACK_FROM, "attack"), F.when(p <= BENIGN_TO, "benign"))
    )


def miss_priority(p: Column) -> Column:
    return F.when(p >= MISS_P1_FROM, "P1").when(p >= MISS_P2_FROM, "P2").otherwise("P3")


def miss_reason(p: Column) -> Column:
    return (
        F.when(p >= MISS_P1_FROM, "High probability miss detection")
        .when(p >= MISS_P2_FROM, "Moderate probability miss detection")
        .otherwise("Low probability miss detection")
    )


def sigmoid(logit: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.exp(-logit))))


def smoothed_entropy(p: Column) -> Column:
    """Entropy with a 1e-9 guard inside the logarithms, not rounded."""
    return -(p * F.log2(p + 1e-9) + (1 - p) * F.log2(1 - p + 1e-9))


def miss_columns(logit: Column) -> dict[str, Column]:
    """Advisory columns of a miss model that yields a logit."""
    p = sigmoid(logit)
    entropy = smoothed_entropy(p)
    return {
        "attack_probability": F.round(p, 6),
        "confidence_score": F.round((1 - entropy) * 100, 2),
        "recommended_priority": miss_priority(p),
        "priority_reasoning": miss_reason(p),
        "entropy": F.round(entropy, 4),
    }


def advisory_columns(p: Column, low_offset: Column, high_offset: Column) -> dict[str, Column]:
    """All advisory columns of a calibrated probability."""
    interval = confidence_interval(p, low_offset, high_offset)
    width, entropy = interval_width(interval), binary_entropy(p)
    return {
        "ai_score": p,
        "ai_confidence": confidence(entropy),
        "ai_confidence_interval": interval,
        "ai_entropy": entropy,
        "ai_priority": priority(p, width),
        "ai_reason": priority_reason(p, width, entropy),
        "ai_labels": label_set(p),
    }


def direction(value: Column) -> Column:
    return F.when(value >= 0, "positive").otherwise("negative")


def top_contributions(contributions: Column, n: int = TOP) -> Column:
    """The ``n`` strongest of ``ARRAY<STRUCT<name,grp,value>>`` by size, then name, with direction."""

    def compared(parts: Column) -> Column:
        return F.array_sort(
            parts,
            lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
            .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
            .when(a["name"] < b["name"], -1)
            .when(a["name"] > b["name"], 1)
            .otherwise(0),
        )

    def keyed(parts: Column) -> Column:
        """The same order from keys, without a comparison written in columns; NaN is the strongest value."""
        number, size = lambda c: ~F.isnan(c["value"]), lambda c: -F.abs(c["value"])
        keys = F.transform(parts, lambda c, i: F.struct(number(c).alias("number"), size(c).alias("size"), c["name"].alias("name"), i.alias("at")))
        return F.transform(F.slice(F.sort_array(keys), 1, n), lambda k: F.get(parts, k["at"]))

    def strongest(parts: Column) -> Column:
        unknown = F.exists(parts, lambda c: c["value"].isNull() | c["name"].isNull())
        return F.when(unknown, F.slice(compared(parts), 1, n)).otherwise(keyed(parts))

    return F.transform(
        let(contributions, strongest),
        lambda c: F.struct(
            c["name"].alias("name"),
            c["grp"].alias("grp"),
            F.round(c["value"], 6).alias("value"),
            direction(c["value"]).alias("direction"),
        ),
    )
