"""Signature catalog files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from reqlens.operators.rules import Signature
from reqlens.operators.signature_scan import guard_of
from reqlens.schemas import SIGNATURE


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether Java's regular expressions, which will run it, accept the pattern."""
    jvm = getattr(spark, "_jvm", None)
    try:
        if jvm is not None:
            jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception:
        return False
    return True


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNATURE).option("multiLine", True).json(path)


def signatures_of(catalog: DataFrame) -> Iterator[Signature]:
    """Signatures of a catalog table in its order, a partition at a time; patterns that do not compile are dropped.

    The texts that their matches need are found here, so ``rules.prefilter`` runs patterns only where one is present.
    """
    spark = catalog.sparkSession
    for row in catalog.toLocalIterator():
        usable = tuple(p for p in row.patterns or [] if p is not None and _compiles(spark, p))
        yield Signature(
            row.id, usable, row["name"], row.category, row.severity, row.description, word_guard=guard_of(usable))


def load_signatures(spark: SparkSession, path: str) -> list[Signature]:
    """Signatures of a file in catalog order; patterns that do not compile are dropped."""
    return list(signatures_of(read_signatures(spark, path)))
