"""Rule ids to attack vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqlens.functions.binding import let

# First rule number of each thousand, key, label.
VECTOR_RANGES = [
    (913000, "scanner", "Scanner"),
    (920000, "protocol", "Protocol"),
    (921000, "protocol", "Protocol Attack"),
    (930000, "lfi", "LFI/Traversal"),
    (931000, "rfi", "RFI Attack"),
    (932000, "cmdi", "Command Injection"),
    (933000, "php", "PHP Attack"),
    (934000, "nosql", "NoSQL Injection"),
    (941000, "xss", "XSS"),
    (942000, "sqli", "SQL Injection"),
    (943000, "session", "Session Fixation"),
    (949000, "anomaly", "Anomaly"),
    (990000, "custom", "Custom Rule"),
]
OTHER = ("other", "Other")


def vector_of(rule: Column) -> Column:
    """``STRUCT<key,label>`` of a rule id; ids outside every range are ``other``."""
    thousand = F.floor(rule.try_cast("double") / 1000) * 1000
    out = F
    for first, key, label in VECTOR_RANGES:
        out = out.when(thousand == first, F.struct(F.lit(key).alias("key"), F.lit(label).alias("label")))
    return out.otherwise(F.struct(F.lit(OTHER[0]).alias("key"), F.lit(OTHER[1]).alias("label")))


def dominant_vector(rules: Column) -> Column:
    """Vector most of an alert's rules vote for; ties go to the one seen first."""
    nothing = vector_of(F.lit(None).cast("string"))

    def winner(found: Column) -> Column:
        def pick(keys: Column) -> Column:
            votes = F.transform(keys, lambda k: F.size(F.filter(keys, lambda other: other == k)))
            return let(votes, lambda v: F.get(found, (F.array_position(v, F.array_max(v)) - 1).cast("int")))

        return let(F.transform(found, lambda v: v["key"]), pick)

    return F.when(F.size(rules) > 0, let(F.transform(rules, vector_of), winner)).otherwise(nothing)
