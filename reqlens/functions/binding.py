"""Evaluate a sub-expression once inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    Higher-order functions evaluate everything written inside their lambda for every element; a value bound
    here is computed per row instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
