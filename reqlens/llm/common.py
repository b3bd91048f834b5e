"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.session import cut_lineage, prepare

#: A word of the word-shingle and quality operators: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a map of hashes, at every size of the input.
MAP_BITS = 1 << 26
#: Bytes of rows that go to or come from a Python worker at once.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return a finished task's memory to the system; the worker lives on and shares its executor with other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work):
    """The function of a group, or of a pair of groups, that gives its memory back when it is done."""

    def one(rows):
        out = work(rows)
        give_back()
        return out

    def two(rows, others):
        out = work(rows, others)
        give_back()
        return out

    return one if work.__code__.co_argcount == 1 else two


def small_batches(batch, column: str, size: int = BATCH_BYTES):
    """A batch cut into pieces whose texts have ``size`` bytes, at least one row each."""
    sizes = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    start = 0
    at = sizes.to_numpy()
    while start < len(at):
        before = at[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(at, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; rows go to Python in batches of a few MB, as a batch of very long texts would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the named columns, under private names, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_like(df: DataFrame, schema: str) -> DataFrame:
    """No rows of a schema."""
    return df.sparkSession.createDataFrame([], schema)


def global_rank(df: DataFrame, keys: list[str], name: str, rank: str = "rank", total: str = "n_rows") -> DataFrame:
    """Gapless position of every row in the order of ``keys``, and the number of rows.

    Rows are dealt out by range and sorted where they lie; a row's position is the number of rows in earlier
    ranges, known from one count a range, plus its place in its range. The ranges are written first, because a
    second evaluation could cut them elsewhere. Rows equal in all keys are told apart by where they were read,
    so a very common key does not fall to one task.
    """
    spark = df.sparkSession
    order = [*keys, "_tie"]
    dealt = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts(spark), *order)
        .sortWithinPartitions(*order)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    dealt = cut_lineage(dealt, name)
    place = dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = place.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias(total),
    )
    return place.join(offsets, "_range").withColumn(rank, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def struct_of(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def identity(doc: str = "doc_id", text: str = "text") -> Column:
    """The document's number; one without a number gets a negative one made from its text.

    Rows that share a number are one document.
    """
    made = -F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1) - 1
    return F.coalesce(F.col(doc).cast("long"), made)


def text_key(text: str = "text") -> Column:
    """Tells the texts of rows that share a number, or have none, apart."""
    return F.xxhash64(F.col(text), F.octet_length(text))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys of the left side stay."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(other[f"_same_{k}"])
    return left.join(other, condition, how).drop(*[f"_same_{k}" for k in keys])


def hash_bitmap(df: DataFrame, column: str = "h") -> np.ndarray:
    """Bits of the hashes in a column, in 64-bit words; at most MAP_BITS / 64 rows come to the driver.

    The map's size is fixed: with very many hashes it lets more and more through, so it may only spare work whose
    result does not depend on it.
    """
    bit = F.col(column).bitwiseAND(F.lit(MAP_BITS - 1))
    found = (
        df.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("bits")).toArrow()
    )
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the map."""
    bit = hashes.view(np.int64) & (MAP_BITS - 1)
    return (bits[bit >> 6] >> (bit & 63)) & 1 > 0
