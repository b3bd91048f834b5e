"""Login limiter over stored attempts, with one key's attempts spread over many tasks.

The limiter's verdict on an attempt depends on all before it, yet little of that is carried on. A key is cut where a
minute has no attempt, since then everything is reset, and each run of busy minutes is cut into slices of time.

1. A window opened at an attempt leads to one next opening: the first success in it, the first attempt after it, or the
   first one after the block that its failures earn. So every attempt of a slice leads to one state at the slice's end.
2. These ends are the only states that the next slice can be entered with; each of them leads to one end there.
3. Such maps of neighbouring slices are composed, doubling their reach each round, until the state at the start of
   every slice is known. Rounds grow with the logarithm of a run's slices, rows with the distinct end states.
4. With that state every slice is judged by itself, its rows streaming through a sorted partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reqlens.session import cut_lineage
from reqlens.streaming.state import BLOCK_US, LOGIN_RESULT, MAX_FAILURES, WINDOW_US, Limiter

SLICE_MINUTES = 10
#: A window that is open at a slice's start and the block it may earn end within two minutes, and a third busy minute then
#: opens one, so what enters the next slice was opened in this one.
LEAST_MINUTES = 1 + (WINDOW_US + BLOCK_US) // WINDOW_US
PIECE = ["key", "run", "slice"]

# A block is at least as long as a window, so whoever comes after a block opens a new window.
assert BLOCK_US >= WINDOW_US


class Slice:
    """Attempts of one key in order of time, as arrays: where windows opened here lead to.

    A state is (failures, start of the window, end of the block), times in microseconds, -1 for none.
    """

    def __init__(self, us: np.ndarray, status: np.ndarray, limit: int):
        self.us, self.limit, self.size = us, limit, len(us)
        failed = status == 401
        self.failures = np.flatnonzero(failed)
        self.successes = np.flatnonzero((status >= 200) & (status < 300))
        self.failed_before = np.concatenate([[0], np.cumsum(failed)])

    def _at(self, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The place of each rank, the end of the slice beyond the last."""
        return np.append(places, self.size)[np.minimum(ranks, len(places))]

    def follow(self, first: np.ndarray, after: np.ndarray, count: np.ndarray, start: np.ndarray):
        """For windows with failures counted before attempt ``first``: the next opening, or the end and the state there.

        Successes count from ``after`` on: the success that opened a window does not open the next.
        """
        blocked = self._at(self.failures, self.failed_before[first] + self.limit - count - 1)
        success = self._at(self.successes, np.searchsorted(self.successes, after))
        late = np.searchsorted(self.us, start + WINDOW_US)
        block = blocked < np.minimum(success, late)
        until = np.where(block, np.append(self.us, 0)[blocked] + BLOCK_US, -1)
        opening = np.where(block, np.searchsorted(self.us, until), np.minimum(success, late))
        total = np.where(block, self.limit, count + self.failed_before[-1] - self.failed_before[first])
        return opening, np.stack([total, start, until], axis=1)

    def ends(self) -> np.ndarray:
        """State at the end for a window opened at each attempt."""
        here = np.arange(self.size)
        opening, state = self.follow(here, here + 1, np.zeros(self.size, np.int64), self.us)
        to = np.where(opening < self.size, opening, here)
        while (to[to] != to).any():
            to = to[to]
        return state[to]

    def lead(self, entries: np.ndarray) -> np.ndarray:
        """State at the end for each state (count, start, until) at the beginning."""
        count, start, until = entries.T
        zero = np.zeros(len(entries), np.int64)
        opening, state = self.follow(zero, zero, count, start)
        opening = np.where(start < 0, 0, opening)
        held = until > self.us[0]
        opening = np.where(held, np.searchsorted(self.us, until), opening)
        state = np.where(held[:, None], entries, state)
        inside = opening < self.size
        return np.where(inside[:, None], self.ends()[np.where(inside, opening, 0)], state)


def _runs(attempts: DataFrame, slice_minutes: int) -> DataFrame:
    """(key, _m, run, slice, first, last): busy minutes, numbered by run and by slice within it."""
    minutes = attempts.select("key", F.floor(F.col("us") / WINDOW_US).alias("_m")).distinct()
    w = W.partitionBy("key").orderBy("_m")
    starts = F.coalesce((F.col("_m") - F.lag("_m").over(w)) > 1, F.lit(True)).cast("int")
    runs = minutes.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w)).drop("_s")
    whole = W.partitionBy("key", "run")
    runs = runs.withColumn("slice", F.floor((F.col("_m") - F.min("_m").over(whole)) / slice_minutes))
    return runs.withColumn("last", F.max("slice").over(whole))


def _entries(pieces: DataFrame, limit: int) -> DataFrame:
    """(key, run, slice, count, start, until): the state with which each slice but the first of a run is entered."""
    many = pieces.where("last > 0").select(*PIECE, "last", "us", "seq", "status")
    state = "count long, start long, until long"
    known = f"key string, run long, slice long, real boolean, {state}"

    def slice_of(rows: pd.DataFrame) -> Slice:
        rows = rows.sort_values(["us", "seq"])
        return Slice(rows["us"].to_numpy(np.int64), rows["status"].fillna(0).to_numpy(np.int64), limit)

    def named(name, slice_number: int, real, states: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(states, columns=["count", "start", "until"])
        return out.assign(key=name[0], run=name[1], slice=slice_number, real=real)[["key", "run", "slice", "real", "count", "start", "until"]]

    def ends(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        states = slice_of(rows).ends()
        real = np.zeros(len(states), bool)
        real[0] = name[2] == 0
        return named(name, name[2] + 1, real, states).groupby(["key", "run", "slice", "count", "start", "until"], as_index=False, dropna=False)[
            "real"].max()[["key", "run", "slice", "real", "count", "start", "until"]]

    def lead(name: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        columns = {c: pd.Series(dtype="int64") for c in ("count", "start", "until", "count2", "start2", "until2")}
        if not len(rows) or not len(states):
            return pd.DataFrame({"key": pd.Series(dtype=str), "run": pd.Series(dtype="int64"), "slice": pd.Series(dtype="int64")} | columns)
        given = states[["count", "start", "until"]].to_numpy(np.int64)
        out = pd.DataFrame(np.hstack([given, slice_of(rows).lead(given)]), columns=list(columns))
        return out.assign(key=name[0], run=name[1], slice=name[2])[["key", "run", "slice", *columns]]

    inner = many.where("slice < last")
    entered = cut_lineage(inner.groupBy(*PIECE).applyInPandas(ends, known), "limiter-ends")
    here = ["count", "start", "until"]
    jump = cut_lineage(
        inner.where("slice > 0").groupBy(*PIECE).cogroup(entered.groupBy(*PIECE)).applyInPandas(
            lead, f"key string, run long, slice long, {state}, count2 long, start2 long, until2 long"), "limiter-jumps")
    reached = entered.where("real").select(*PIECE, *here)
    slices = pieces.agg(F.max("last")).first()[0] or 0
    reach = 1
    while reach < slices:
        there = [F.col("j.key"), F.col("j.run"), (F.col("j.slice") + reach).alias("slice"), *[F.col(f"j.{c}2").alias(c) for c in here]]
        same = [F.col(f"a.{c}") == F.col(f"j.{c}") for c in (*PIECE, *here)]
        more = reached.alias("a").join(jump.alias("j"), same).select(*there)
        reached = cut_lineage(reached.unionByName(more).distinct(), "limiter-reached")
        reach *= 2
        if reach < slices:
            left, right = jump.alias("l"), jump.alias("r")
            meet = [F.col("l.key") == F.col("r.key"), F.col("l.run") == F.col("r.run"), F.col("l.slice") + reach // 2 == F.col("r.slice"),
                    *[F.col(f"l.{c}2") == F.col(f"r.{c}") for c in here]]
            both = left.join(right, meet).select(*[F.col(f"l.{c}") for c in (*PIECE, *here)], *[F.col(f"r.{c}2") for c in here])
            jump = cut_lineage(both, "limiter-jumps")
    return reached


def login_bursts(attempts: DataFrame, limit: int = MAX_FAILURES, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """Attempts (key, us, seq, status) with the limiter's verdict; a limit below one stands for the default.

    A slice's times and states are held by a task as arrays. Times are not null and not before 1970, keys not null;
    a null status is neither failure nor success.
    """
    if slice_minutes < LEAST_MINUTES:
        raise ValueError(f"a slice has at least {LEAST_MINUTES} minutes")
    limit = limit if limit > 0 else MAX_FAILURES
    keyed = attempts.withColumn("_m", F.floor(F.col("us") / WINDOW_US))
    pieces = keyed.join(_runs(attempts, slice_minutes), ["key", "_m"]).select(
        "key", F.col("run").cast("long").alias("run"), F.col("slice").cast("long").alias("slice"), F.col("last").cast("long").alias("last"),
        "us", "seq", "status")
    pieces = cut_lineage(pieces, "limiter-pieces")
    entries = _entries(pieces, limit)
    ordered = (
        pieces.join(entries, PIECE, "left")
        .repartition(*PIECE)
        .sortWithinPartitions(*PIECE, "us", "seq")
        .select(*PIECE, "us", "seq", "status", F.coalesce("count", F.lit(0)).alias("failures"), F.coalesce("start", F.lit(-1)).alias("start"),
                F.coalesce("until", F.lit(-1)).alias("until"))
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, Limiter()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.key, row.run, row.slice) != at:
                    at = (row.key, row.run, row.slice)
                    state = Limiter(row.failures, row.start if row.start >= 0 else None, row.until)
                refused = state.step(int(row.us), 0 if pd.isna(row.status) else int(row.status), limit)
                out.append((row.key, row.us, row.seq, row.status, refused, state.count))
            yield pd.DataFrame(out, columns=["key", "us", "seq", "status", "blocked", "failures"])

    return ordered.mapInPandas(judge, LOGIN_RESULT)
