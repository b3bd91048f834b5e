"""Substring dedup by sliding spans of sentences.

Every run of several consecutive sentences is hashed: from each sentence, and up to each sentence, the shortest run of
``span`` sentences or more that has ``least_words`` words. The first document that holds a span keeps it; in all
others the sentences that it covers are removed, so of a passage that two documents share all whole sentences go. With
``within`` a span that stands again further on in its own document is removed there too. White space inside a sentence
does not count. Spans travel as 128-bit hashes; only those that a fixed-size map of the repeated ones lets through are
looked up, so a span that stands once is sent once, and a very common one is split by the join's skew handling.

Null and empty texts have no sentences and stay empty. A text with fewer sentences than a span has one span of
all its sentences if ``whole_short`` is set, else none. Rows that share a doc_id are one document and keep what they
share; each is cut by its own text. A row without doc_id is a document before all others, known by its text. A blank
piece is no sentence and stays in the text. Extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import hash_bitmap, identity, in_bitmap, renamed, small_batches
from reqlens.session import cut_lineage

#: A text is cut after . ! ? before white space and after line ends.
CUT = re.compile(rb"(?<=[.!?])(?=[\x20\x09-\x0D])|(?<=\n)")
SPANS = "_id long, _hash long, _at int, _to int, h long, g long, _again boolean"


def sentences(raw: bytes) -> tuple[list[bytes], list[int], list[list[bytes]]]:
    """The pieces of a text, nothing lost; the numbers of those that are sentences; and the sentences' words."""
    pieces = CUT.split(raw)
    words = [p.split() for p in pieces]
    at = [i for i, w in enumerate(words) if w]
    return pieces, at, [words[i] for i in at]


def runs(sizes: list[int], span: int, least_words: int, whole_short: bool) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs that are long enough, from every and up to every sentence."""
    n, out, words, end = len(sizes), [], 0, 0
    if whole_short and 0 < n < span:
        return [(0, n)]
    for start in range(n):
        while end < n and (end - start < span or words < least_words):
            words += sizes[end]
            end += 1
        if end - start < span or words < least_words:
            break
        out.append((start, end))
        words -= sizes[start]
    words, start = 0, n
    for end in range(n, 0, -1):
        while start > 0 and (end - start < span or words < least_words):
            start -= 1
            words += sizes[start]
        if end - start < span or words < least_words:
            break
        out.append((start, end))
        words -= sizes[end - 1]
    return sorted(set(out))


def sentence_spans(df: DataFrame, span: int, least_words: int, whole_short: bool, among: np.ndarray | None = None) -> DataFrame:
    """The spans of every text (_id, _hash, _raw); with ``among`` those whose hash may be in the map, or that repeat."""
    shared = None if among is None else df.sparkSession.sparkContext.broadcast(among)

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for batch in small_batches(whole, "_raw"):
                row, at, to, hashes, again = [], [], [], [], []
                for k, raw in enumerate(batch.column("_raw").to_pylist()):
                    words = sentences(raw)[2]
                    marks = [digest(b" ".join(w)) for w in words]
                    seen = set()
                    for start, end in runs(list(map(len, words)), span, least_words, whole_short):
                        h = digest(b"".join(marks[start:end]))
                        row.append(k)
                        at.append(start)
                        to.append(end)
                        hashes.append(h)
                        again.append(h in seen)
                        seen.add(h)
                if not row:
                    continue
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                kept = np.ones(len(row), bool) if shared is None else in_bitmap(shared.value, np.ascontiguousarray(both[:, 0])) | np.array(again)
                row = pa.array(np.array(row)[kept])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(row), batch.column("_hash").take(row), pa.array(np.array(at, np.int32)[kept]), pa.array(np.array(to, np.int32)[kept]),
                     pa.array(both[kept, 0]), pa.array(both[kept, 1]), pa.array(np.array(again)[kept])],
                    names=["_id", "_hash", "_at", "_to", "h", "g", "_again"])

    return df.select("_id", "_hash", "_raw").mapInArrow(run, SPANS)


def _without(df: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of every row, without the sentences that its runs cover."""

    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "_raw"):
                n, gone, left = [], [], []
                for raw, cover in zip(batch.column("_raw").to_pylist(), batch.column("_cover").to_pylist(), strict=True):
                    pieces, at, _ = sentences(raw)
                    n.append(len(at))
                    edges = np.zeros(len(at) + 1, np.int64)
                    for x in cover or ():
                        edges[x["_at"]] += 1
                        edges[x["_to"]] -= 1
                    drop = np.flatnonzero(np.cumsum(edges[:-1])).tolist()
                    gone.append(len(drop))
                    for i in drop:
                        pieces[at[i]] = b""
                    left.append(b"".join(pieces))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_sentences", "n_removed", "text"])

    return df.select("_doc", "_raw", "_cover").mapInArrow(run, f"doc_id {df.schema['_doc'].dataType.simpleString()}, n_sentences long, n_removed long, text string")


def remove_repeated_spans(
    df: DataFrame, span: int = 3, doc: str = "doc_id", text: str = "text", whole_short: bool = False, least_words: int = 0, within: bool = True,
) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text): what is left of every row's text."""
    rows = renamed(df, {doc: "_doc", text: "_text"}).withColumn("_id", identity("_doc", "_text"))
    rows = rows.select("_doc", "_id", F.coalesce("_text", F.lit("")).cast("binary").alias("_raw")).withColumn("_hash", F.xxhash64("_raw"))
    spans = sentence_spans(rows, span, least_words, whole_short)
    repeated = spans.groupBy("h", "g").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    repeated = cut_lineage(repeated.select("h", "g", "_first"), "repeated-spans")
    found = cut_lineage(sentence_spans(rows, span, least_words, whole_short, hash_bitmap(repeated)), "spans")
    later = F.col("_id") > F.col("_first")
    gone = found.join(repeated, ["h", "g"], "left").where(F.coalesce(later, F.lit(False)) | (F.lit(within) & F.col("_again")))
    cover = gone.groupBy("_id", "_hash").agg(F.collect_set(F.struct("_at", "_to")).alias("_cover"))
    return _without(rows.join(cover, ["_id", "_hash"], "left"))
