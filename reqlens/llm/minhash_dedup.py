"""Near-duplicate documents by BagMinHash signatures of word shingles, verified on the multisets.

The weight of a shingle is its count. The weights' axis is cut at 1, 2, 4, 8, ...: each piece of each shingle is
a Poisson process of points, every point falls on one place of the signature, and a place keeps its earliest point.
Pieces wholly under the weight give all their points, in the piece that holds the weight a point counts if its own
level (halved down by further random bits) is under the weight. Two documents agree in a place with a probability
equal to their weighted Jaccard similarity. Points are drawn in order of time and only until every place is filled
and later points cannot win, so a long text costs about one draw a shingle.

Documents whose signatures agree in a band are candidates. In each bucket every member is compared with the
smallest and the largest member; then members that are not yet linked are compared with all members of the bucket
that belong to other groups. So no candidate pair that could join two groups is left out, and copies are not
expanded into all pairs. Small buckets are compared by pairs that are joined and verified, crowded ones chunk by chunk
in tasks that return a spanning forest. All are verified on their exact multisets.

A text of fewer words than a shingle has one shingle of all its words. Null, empty and blank texts have none:
each is a group of its own. Rows that share a doc_id are one document.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import WORD, identity, renamed, text_key, tidy
from reqlens.llm.components import components, forest
from reqlens.session import cut_lineage

#: Members of a bucket from which on it is compared in chunks instead of by pairs, and members of a chunk.
CROWD, CHUNK = 16, 256
#: Words of a shingle, least similarity, bands and places of a band.
SHINGLE, SIMILARITY, BANDS, PLACES = 5, 0.8, 25, 5
GOLD, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word; a bounded memory of those met."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= 500_000:
            self.clear()
        self[word] = found
        return found


def shingle_hashes(words: list[str], known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n, width = max(1, len(h) - size + 1), min(size, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out + h[k : k + n]) * GOLD
        out ^= out >> np.uint64(29)
    return mixed(out)


def bag_minhash(sets: list[tuple[np.ndarray, np.ndarray]], places: int) -> np.ndarray:
    """Signatures, a row for each (elements, counts); rows of empty sets are zero."""
    docs = len(sets)
    time = np.full((docs, places), np.inf)
    mark = np.zeros((docs, places), np.uint32)
    if not docs:
        return mark
    element = np.concatenate([e for e, _ in sets]) if sets else np.empty(0, np.uint64)
    count = np.concatenate([c for _, c in sets]).astype(np.int64)
    owner = np.repeat(np.arange(docs), [len(e) for e, _ in sets])
    pieces = []
    level = 0
    while len(element):
        low = 0 if level == 0 else 1 << (level - 1)
        here = count > low
        element, count, owner = element[here], count[here], owner[here]
        width = 1 if level == 0 else low
        pieces.append((mixed(element + np.uint64((level + 1) * int(GOLD) % (1 << 64))), np.minimum(count - low, width), owner, np.full(len(element), width)))
        level += 1
    if not pieces:
        return mark
    seed, inside, owner, width = (np.concatenate(x) for x in zip(*pieces, strict=True))
    at = np.zeros(len(seed))
    flat_time, flat_mark = time.ravel(), mark.ravel()
    draw = 0
    while len(seed):
        draw += 1
        first = mixed(seed + np.uint64(draw * int(MIX2) % (1 << 64)))
        second = mixed(first ^ GOLD)
        at = at - np.log(((first >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        place = ((second & np.uint64(0xFFFFFFFF)) * np.uint64(places)) >> np.uint64(32)
        height = ((second >> np.uint64(32)) * width.astype(np.uint64)) >> np.uint64(32)
        target = owner * places + place.astype(np.int64)
        wins = np.flatnonzero((height < inside.astype(np.uint64)) & (at < flat_time[target]))
        wins = wins[np.argsort(-at[wins], kind="stable")]
        flat_time[target[wins]] = at[wins]
        flat_mark[target[wins]] = (first[wins] >> np.uint64(16)).astype(np.uint32)
        go = at < time.max(axis=1)[owner]
        seed, inside, owner, width, at = seed[go], inside[go], owner[go], width[go], at[go]
    return mark


def signatures(df: DataFrame, bands: int, places: int, shingle: int) -> DataFrame:
    """(_id, words, bands): digest of the words and a hash for each band; null for texts without words."""
    word = re.compile(WORD)

    def run(batches):
        known = WordHashes()
        for batch in batches:
            ids, texts = batch.column("_id"), batch.column("_text")
            start = 0
            while start < len(texts):
                end, sets, digests, got = start, [], [], 0
                while end < len(texts) and got < 400_000:
                    words = word.findall(texts[end].as_py() or "")
                    got += len(words) + 20
                    h = shingle_hashes(words, known, shingle)
                    sets.append(np.unique(h, return_counts=True))
                    digests.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest() if words else None)
                    end += 1
                marks = bag_minhash(sets, bands * places).reshape(len(sets), bands, places).astype(np.uint64)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), marks.shape[:2]).copy()
                for k in range(places):
                    band = mixed(band * GOLD + marks[:, :, k])
                rows = [None if d is None else b for d, b in zip(digests, band.view(np.int64).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                    names=["_id", "words", "bands"],
                )
                start = end

    return df.select("_id", "_text").mapInArrow(run, "_id long, words binary, bands array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser counts over the sum of the greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""
    word = re.compile(WORD)
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("text_b"))
    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("text_a"))
    wide = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        known = WordHashes()
        recent: dict[int, tuple] = {}

        def bag(i, text):
            if i not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[i] = np.unique(shingle_hashes(word.findall(text), known, shingle), return_counts=True)
            return recent[i]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [
                weighted_jaccard(bag(x, s.as_py()), bag(y, t.as_py())) >= similarity
                for x, y, s, t in zip(a, b, batch.column("text_a"), batch.column("text_b"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return wide.mapInArrow(run, "a long, b long")


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the lesser counts of every two different multisets: the k-th copy of an element is an element of its own."""
    element = np.concatenate([np.repeat(e, c) for e, c in sets])
    owner = np.repeat(np.arange(len(sets)), [int(c.sum()) for _, c in sets])
    nth = np.concatenate([np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) for _, c in sets])
    column, count = np.unique(element + mixed(nth.astype(np.uint64)), return_inverse=True, return_counts=True)[1:]
    shared = count[column] > 1
    column = np.unique(column[shared], return_inverse=True)[1]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += block @ block.T
    return total


def _crowd_links(crowd: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """A spanning forest of the links between groups in crowded buckets.

    A bucket is cut into chunks of about CHUNK members; a task holds two chunks and compares their members of
    different groups on their exact multisets. Pairs are not returned, so rows grow with members, not with pairs.
    """
    word = re.compile(WORD)
    mine = crowd.withColumn("mine", F.pmod(F.xxhash64("_id"), F.col("chunks")).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("_id", "band", "group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    @tidy
    def compare(frame):
        known = WordHashes()
        sets = [np.unique(shingle_hashes(word.findall(t), known, shingle), return_counts=True) for t in frame["_text"]]
        both = overlaps(sets)
        size = np.array([int(c.sum()) for _, c in sets], np.float64)
        group = frame["group"].to_numpy()
        alike = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
        i, j = np.nonzero(np.triu(alike & (group[:, None] != group[None, :]), 1))
        node, root = forest(i, j, len(sets))
        ids = frame["_id"].to_numpy()
        return pd.DataFrame({"a": ids[root], "b": ids[node]})

    return dealt.join(texts, "_id").groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    bands: int = BANDS, places: int = PLACES,
) -> DataFrame:
    """(doc_id, component_id, kept, text_key) for every row: its group's smallest document, and whether that is it."""
    rows = renamed(df, {doc: "_doc", text: "_text"}).withColumn("_id", identity("_doc", "_text"))
    signed = cut_lineage(signatures(rows, bands, places, shingle), "signatures")
    copies = signed.where("words is not null").groupBy("words").agg(F.min("_id").alias("rep"))
    member = signed.select("_id", "words").join(copies, "words").select("_id", "rep")
    member = cut_lineage(member.where("_id <> rep").distinct(), "copies")
    ones = signed.where("words is not null").join(member, "_id", "left_anti")
    keys = ones.dropDuplicates(["_id"]).select("_id", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high")
    shared = cut_lineage(keys.join(buckets, "band"), "buckets")
    wanted = shared.select("_id").distinct()
    texts = cut_lineage(rows.join(wanted, "_id", "left_semi").dropDuplicates(["_id"]).select("_id", "_text"), "texts")
    stars = shared.select(F.explode(F.array(
        F.struct(F.col("low").alias("a"), F.col("_id").alias("b")), F.struct(F.col("_id").alias("a"), F.col("high").alias("b")))).alias("p"))
    stars = stars.select("p.*").where("a < b").distinct()
    links = cut_lineage(_verified(stars, texts, shingle, similarity), "links")
    found = cut_lineage(components(links), "groups")
    open_members = cut_lineage(
        shared.join(found, shared["_id"] == found["node"], "left")
        .select("_id", "band", "low", "high", F.coalesce("component", "_id").alias("group")), "members")
    mixed_up = open_members.groupBy("band").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.count(F.lit(1)).alias("n"))
    mixed_up = cut_lineage(mixed_up.where("g0 < g1").select("band", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), (F.col("n") > CROWD).alias("crowded")), "mixed")
    rest = open_members.join(mixed_up.where("not crowded"), "band", "left_semi").where("_id <> low and _id <> high")
    other = rest.select("band", F.col("_id").alias("b"), F.col("group").alias("group_b"))
    across = (
        rest.select("band", F.col("_id").alias("a"), "group").join(other, "band")
        .where("a < b and group <> group_b").select("a", "b").distinct()
    )
    late = _verified(across, texts, shingle, similarity)
    crowd = open_members.join(mixed_up.where("crowded"), "band").select("_id", "band", "group", "chunks")
    late = late.unionByName(_crowd_links(crowd, texts, shingle, similarity))
    final = components(links.unionByName(late))
    rep = rows.select("_doc", "_id", text_key("_text").alias("text_key")).join(member, "_id", "left").withColumn("_rep", F.coalesce("rep", "_id"))
    named = rep.join(final, rep["_rep"] == final["node"], "left")
    group = F.coalesce("component", "_rep")
    return named.select(
        F.col("_doc").alias("doc_id"), group.alias("component_id"), (F.col("_id") == group).alias("kept"), "text_key")
