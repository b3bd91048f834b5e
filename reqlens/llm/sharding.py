"""Sharding along a Hilbert curve over quantised metadata.

Rows are ordered by their place on a curve through the grid of several dimensions and cut into runs of equal
counts, so each file covers a small box in every dimension and filters on any of them skip most files.

Nulls are a value of their own (first in a categorical dimension, cell 0 in a numeric one). Equal cells are
ordered by the tie columns; repeated rows get neighbouring slots. An empty table gives no rows. Columns of the
input named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reqlens.llm.common import global_rank

#: Bits of each dimension's grid.
BITS = 6


def magnitude_cell(value: Column, bits: int = BITS) -> Column:
    """Cell of a non-negative whole number on a logarithmic scale: two cells for each doubling."""
    digits = F.bin(value)
    half = F.when(F.substring(digits, 2, 1) == "1", 1).otherwise(0)
    return F.coalesce(F.least(F.lit((1 << bits) - 1), 2 * F.length(digits) + half), F.lit(0)).cast("int")


def range_cell(df: DataFrame, name: str, out: str, bits: int = BITS) -> DataFrame:
    """Cell of a whole number on an even scale between the column's least and greatest value."""
    bounds = df.agg(F.min(name).alias("_least"), F.max(name).alias("_most"))
    width = (F.col("_most") - F.col("_least") + 1).cast("decimal(38,0)")
    cell = F.expr(f"cast((cast(`{name}` as decimal(38,0)) - _least) * {1 << bits} as decimal(38,0))")
    return df.crossJoin(F.broadcast(bounds)).withColumn(
        out, F.coalesce(F.floor(cell / width), F.lit(0)).cast("int")
    ).drop("_least", "_most")


def ordinal_cell(df: DataFrame, name: str, out: str, bits: int = BITS) -> DataFrame:
    """Cell of a value by its place among the distinct values in their order."""
    values = df.groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = global_rank(values, ["_value"], f"cells-{out}")
    cells = ranked.select("_value", F.expr(f"cast((rank * {1 << bits}) div n_rows as int)").alias(out))
    return df.join(cells, df[name].eqNullSafe(cells["_value"])).drop("_value")


def hilbert_distance(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points given as rows of whole numbers below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, mask = 1 << level, (1 << level) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(high, mask, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def hilbert_index(cells: list[str], bits: int = BITS) -> Column:
    """Curve distance of the cells named."""
    if bits * len(cells) > 62:
        raise ValueError("the curve index must fit a long")

    @pandas_udf("long")
    def place(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_distance(points.to_numpy(), bits))

    return place(F.struct(*[F.col(c) for c in cells]))


def hilbert_shards(df: DataFrame, cells: list[str], ties: list[str], shards: int = 24, bits: int = BITS) -> DataFrame:
    """``df`` with hilbert_index, shard and slot: runs of the curve's order, counts at most one apart."""
    placed = df.drop("hilbert_index", "shard", "slot").withColumn("hilbert_index", hilbert_index(cells, bits))
    ranked = global_rank(placed, ["hilbert_index", *ties], "hilbert", "_rank", "_n")
    shard = F.expr(f"cast((_rank * {shards}) div _n as int)")
    first = F.expr(f"(cast(shard as bigint) * _n + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", F.col("_rank") - first)
        .drop("_rank", "_n")
    )


def write_shards(df: DataFrame, path: str) -> None:
    """One folder a shard, its rows in slot order; a shard is one range of the sort and so one file."""
    (
        df.repartitionByRange(F.col("shard"), F.col("slot"))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
