"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length one, so a cosine of at least c is a squared distance of at most 2 - 2c. They are rotated
at random and cut into BLOCKS blocks of dimensions. The squared distance is the sum over the blocks, so of two near
vectors some block is within its share of the bound, in proportion to its dimensions. Each block is joined by range:
a vector goes to the cell of its first GRID coordinates in the block (cells as wide as the range) and to the
neighbouring cells, one of each two opposite ones. In a cell, pairs within the block's range are candidates, and a
candidate is verified by the cosine of the given components in double precision. A pair is counted in the first block
in which it is a candidate. Rotated coordinates are whole numbers, computed exactly, so every task takes the same
decision on a pair.

Equal vectors of a label are one vector with a count. Crowded cells are cut into groups of at most about GROUP vectors
that are compared two by two in tasks of their own. A task returns counts and a spanning forest of its links, never the
pairs. Vectors of different lengths do not link. Null labels, null or zero vectors and vectors with null or
non-finite components link with nothing. Rows that share a vec_id are one vector only if they are equal; otherwise the
number stands for all of them.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.components import components, forest
from reqlens.session import cut_lineage

COSINE, BLOCKS, GRID, GROUP, SEED = 0.93, 4, 2, 1024, 11
#: Whole-number scales of components and of rotated coordinates.
FINE, COARSE = 20, 15


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random rotation in whole numbers of 2**-FINE."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return np.rint(q * np.sign(np.diag(r)) * 2.0**FINE)


def rotated(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and their rotated coordinates in whole numbers of 2**-COARSE.

    All sums are of whole numbers below 2**53 and so the same in every order.
    """
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
    return unit, np.floor(np.rint(unit * 2.0**FINE) @ turn / 2.0 ** (2 * FINE - COARSE))


def block_bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [dims * k // blocks for k in range(blocks + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def block_ranges(dims: int, blocks: int, cosine: float) -> list[float]:
    """Squared range of each block in whole-number units, widened by what rounding can add."""
    out = []
    for a, b in block_bounds(dims, blocks):
        exact = np.sqrt((2 - 2 * cosine) * (b - a) / dims)
        out.append(float(np.ceil(((exact + 2.0 ** (2 - COARSE) * np.sqrt(dims)) * 2.0**COARSE) ** 2)))
    return out


def _decoded(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def _links(left: np.ndarray, right: np.ndarray, same: bool, block: int, home_l, home_r, dims: int, blocks: int, cosine: float, turn):
    """Index pairs (i, j) of links that this block counts; one side of a pair must be at home in the cell."""
    (ul, ql), (ur, qr) = rotated(left, turn), rotated(right, turn)
    bounds, ranges = block_bounds(dims, blocks), block_ranges(dims, blocks, cosine)

    def near(k: int, rows=slice(None), cols=slice(None), pairs=False):
        a, b = bounds[k]
        x, y = ql[rows, a:b], qr[cols, a:b]
        if pairs:
            return ((x - y) ** 2).sum(axis=1) <= ranges[k]
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T) <= ranges[k]

    hit = near(block) & (home_l[:, None] | home_r[None, :])
    if same:
        hit &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(hit)
    for k in range(block):
        fresh = ~near(k, i, j, True)
        i, j = i[fresh], j[fresh]
    close = np.einsum("ij,ij->i", ul[i], ur[j]) >= cosine
    return i[close], j[close]


def near_vectors(
    df: DataFrame, cosine: float = COSINE, vec: str = "vec_id", embedding: str = "embedding", label: str = "label",
    blocks: int = BLOCKS, grid: int = GRID,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(vec).alias("_vec"), F.col(embedding).alias("_e"), F.col(label).alias("_label"))
    finite = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_e", lambda x: x != 0)
    valid = rows.where(F.col("_vec").isNotNull() & F.col("_label").isNotNull() & F.col("_e").isNotNull() & F.coalesce(finite, F.lit(False)))
    valid = valid.withColumn("_e", F.transform("_e", lambda x: x.cast("double") + 0.0))
    copies = valid.groupBy("_label", "_e").agg(F.min("_vec").alias("rep"), F.countDistinct("_vec").alias("n"))
    ones = copies.withColumn("_dims", F.size("_e"))

    def to_cells(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for dims, rows in frame.groupby("_dims"):
                dims = int(dims)
                turn = turns.setdefault(dims, rotation(dims))
                vectors = np.stack(rows["_e"].to_numpy()).astype(np.float64)
                q = rotated(vectors, turn)[1]
                blobs = [v.tobytes() for v in vectors]
                for k, ((a, b), squared) in enumerate(zip(block_bounds(dims, blocks), block_ranges(dims, blocks, cosine), strict=True)):
                    axes = min(grid, b - a)
                    cells = np.floor(q[:, a : a + axes] / np.ceil(np.sqrt(squared))).astype(np.int64)
                    zero = (0,) * axes
                    for step in product((-1, 0, 1), repeat=axes):
                        if step < zero:
                            continue
                        at = cells + np.array(step)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(rows["_label"].astype(str)), pa.array(np.full(len(rows), dims)), pa.array(np.full(len(rows), k)),
                            pa.array([",".join(map(str, c)) for c in at.tolist()]), pa.array(np.full(len(rows), step == zero)),
                            pa.array(rows["rep"].to_numpy()), pa.array(rows["n"].to_numpy()), pa.array(blobs, pa.binary())],
                            names=["label", "dims", "block", "cell", "home", "rep", "n", "v"])

    key = ["label", "dims", "block", "cell"]
    placed = ones.select(F.col("_label").cast("string").alias("_label"), "_e", "_dims", "rep", "n").mapInArrow(
        to_cells, "label string, dims long, block long, cell string, home boolean, rep long, n long, v binary")
    placed = cut_lineage(placed, "cells")
    sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"), F.max("home").alias("_any")).where("_any and _size > 1")
    dealt = placed.join(sizes.select(*key, F.ceil(F.col("_size") / GROUP).cast("int").alias("_groups")), key)
    mine = F.pmod(F.xxhash64("rep"), F.col("_groups")).cast("int")
    dealt = dealt.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    dealt = dealt.withColumn("i", F.least("_mine", "_other")).withColumn("j", F.greatest("_mine", "_other"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        dims, block = int(frame["dims"].iloc[0]), int(frame["block"].iloc[0])
        turn = rotation(dims)
        same = frame["i"].iloc[0] == frame["j"].iloc[0]
        frame = frame.sort_values(["rep", "home"]).reset_index(drop=True)
        side = frame["_mine"].to_numpy() == frame["i"].iloc[0]
        l_at = np.flatnonzero(side)
        r_at = l_at if same else np.flatnonzero(~side)
        out = np.zeros(len(frame), np.int64)
        if not len(l_at) or not len(r_at):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        v, home, n = _decoded(frame["v"]), frame["home"].to_numpy(), frame["n"].to_numpy()
        i, j = _links(v[l_at], v[r_at], bool(same), block, home[l_at], home[r_at], dims, blocks, cosine, turn)
        i, j = l_at[i], r_at[j]
        np.add.at(out, i, n[j])
        np.add.at(out, j, n[i])
        rep = frame["rep"].to_numpy()
        node, root = forest(i, j, len(frame))
        roots = np.arange(len(frame))
        roots[node] = root
        hit = np.flatnonzero(out)
        return pd.DataFrame({"rep": rep[hit], "links": out[hit], "root": rep[roots[hit]]})

    found = dealt.drop("_groups", "_other").groupBy(*key, "i", "j").applyInPandas(compare, "rep long, links long, root long")
    found = cut_lineage(found, "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = valid.select("_vec", "_label", "_e").join(copies, ["_label", "_e"]).select("_vec", "rep", "n").distinct()
    links = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(member.select(F.col("_vec").alias("a"), F.col("rep").alias("b")))
    group = components(links)
    per_vec = member.join(counts, "rep", "left").groupBy("_vec").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("_vec").join(per_vec, "_vec", "left").join(group, F.col("_vec") == F.col("node"), "left")
    component = F.coalesce("component", "_vec")
    return out.select(
        F.col("_vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("_vec") == component).alias("kept"))
