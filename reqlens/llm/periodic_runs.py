"""Maximal periodic runs of words by recursive frequency splitting and lag scans.

A run is a stretch of consecutive words with smallest period q and a length of at least ``least`` words and two
periods, which no neighbouring word extends with the same period. Every word of a run stands in it twice or more, so
a word that occurs once in a segment is in no run of the segment and splits it. The parts are counted again until
none splits; then the same is done with short windows of words, because some window over each word of a run recurs
too. What survives is scanned by lags: a run of period q has at least max(q, least - q) neighbouring words that equal
those q further on, hence a whole window that does at some multiple of a step below q. Windows are named by doubling,
so a lag is scanned only where windows of a quarter of its length agree. The work of a segment of m words is m log m
for splitting and probing plus the lengths of the matches found.

Null and empty texts have no words and no runs; their collapsed text is empty. Repeated rows are treated alike, extra
columns pass through, input columns named like an output column are replaced. Texts never meet each other.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reqlens.llm.common import small_batches

RUN = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
#: Distinct words a worker remembers.
KNOWN_WORDS = 1_000_000


def names_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each distinct pair; both sides are below 2**31."""
    return pd.factorize(a.astype(np.int64) << 32 | b)[0]


def _cut(at: np.ndarray, seg: np.ndarray, keep: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept places with the numbers of the segments they fall into; shorter segments go."""
    at, seg = at[keep], seg[keep]
    if not len(at):
        return at, seg
    new = np.append(True, (np.diff(at) > 1) | (np.diff(seg) != 0))
    number = np.cumsum(new) - 1
    long = np.bincount(number)[number] >= least
    return at[long], number[long]


def _stable(at: np.ndarray, seg: np.ndarray, least: int, recurring) -> tuple[np.ndarray, np.ndarray]:
    """Split by ``recurring`` again and again; a segment that it leaves whole is done."""
    done_at, done_seg, done = [], [], 0
    while len(at):
        keep = recurring(at, seg)
        number = pd.factorize(seg)[0]
        broken = np.bincount(number, ~keep) > 0
        whole = ~broken[number]
        done_at.append(at[whole])
        done_seg.append(number[whole] + done)
        done += len(broken)
        at, seg = _cut(at[~whole], number[~whole], keep[~whole], least)
    if not done_at:
        return at, seg
    at, seg = np.concatenate(done_at), np.concatenate(done_seg)
    order = np.argsort(at, kind="stable")
    return at[order], pd.factorize(seg[order])[0]


def split_by_frequency(words: np.ndarray, doc: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that can be in a run, and their segments; doc: each word's text."""

    def recurring_words(at, seg):
        name = names_of(seg, words[at])
        return np.bincount(name)[name] > 1

    def recurring_windows(at, seg):
        name, step = words[at], 1
        while step < width:
            name = names_of(name[:-step], name[step:])
            step *= 2
        inside = seg[width - 1 :] == seg[: len(name)]
        name = names_of(seg[: len(name)], name)
        hit = inside & (np.bincount(name, inside)[name] > 1)
        edges = np.zeros(len(at) + 1, np.int64)
        edges[: len(hit)] += hit
        edges[width : width + len(hit)] -= hit
        return np.cumsum(edges[:-1]) > 0

    at, seg = _cut(np.arange(len(words)), doc, np.ones(len(words), bool), least)
    at, seg = _stable(at, seg, least, recurring_words)
    return _stable(at, seg, least, recurring_windows)


def _stretch(word: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest stretch around place i whose words equal those q further on."""
    end, step, n = i, 64, len(word) - q
    while end < n:
        differ = word[end : min(n, end + step)] != word[end + q : min(n, end + step) + q]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = min(n, end + step), 2 * step
    start, step = i, 64
    while start > 0:
        low = max(0, start - step)
        differ = word[low:start] != word[low + q : start + q]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = low, 2 * step
    return start, end


def _lags(m: int, window: int, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The lags whose windows have this length, and the step of their probes, for a segment of m words."""
    q = np.arange(1 if window == width else 2 * window, min(4 * window, m // 2 + 1))
    return q, np.maximum(q, least - q) - window + 1


def lag_scan(word: np.ndarray, names: dict[int, np.ndarray], least: int, width: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment; names: the windows' names by window length."""
    m, found = len(word), []
    for window, name in names.items():
        q, step = _lags(m, window, width, least)
        room = m - q - window
        q, step, room = q[room >= 0], step[room >= 0], room[room >= 0]
        if not len(q):
            continue
        number = room // step + 1
        lag = np.repeat(q, number)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(number) - number, number)) * np.repeat(step, number)
        hit = name[at] == name[at + lag]
        lag, at = lag[hit], at[hit]

        def unexplained(lag, at, run, window=window):
            start, length, period = run
            return (lag % period > 0) | (at < start) | (at + lag + window > start + length)

        for run in found:
            if run[1] >= 4 * run[2] and run[1] >= 2 * q[0]:
                open_ = unexplained(lag, at, run)
                lag, at = lag[open_], at[open_]
        k, last = 0, (0, 0)
        while k < len(lag):
            p, i = int(lag[k]), int(at[k])
            k += 1
            if p == last[0] and i + window <= last[1]:
                continue
            start, end = _stretch(word, i, p)
            last = (p, end)
            if end - start < max(p, least - p):
                continue
            run = (start, end - start + p, p)
            found.append(run)
            if run[1] >= 4 * p:  # only such a run has lags of several periods that pass for runs
                open_ = unexplained(lag[k:], at[k:], run)
                lag, at, k = lag[k:][open_], at[k:][open_], 0
    return found


def runs_of(words: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the concatenated texts, by start, then period."""
    width = 1 << max(0, ((least + 1) // 2).bit_length() - 1)
    at, seg = split_by_frequency(words, doc, least, width)
    if not len(at):
        return []
    word = words[at]
    size = np.bincount(seg)
    first = np.cumsum(size) - size
    # Windows by doubling; one that would reach into the next segment gets a name, but no probe looks there.
    names, window, name = {}, 1, word
    while window <= max(width, int(size.max()) // 4):
        if window >= width:
            names[window] = name
        name = names_of(name, np.append(name[window:], np.full(min(window, len(name)), 0)))
        window *= 2
    out = []
    for start, m in zip(first.tolist(), size.tolist(), strict=True):
        own = {k: v[start : start + m] for k, v in names.items() if k == width or 4 * k <= m}
        place = int(at[start])
        out.extend((place + s, n, q) for s, n, q in lag_scan(word[start : start + m], own, least, width))
    return sorted(out, key=lambda r: (r[0], r[2]))


class Words(defaultdict):
    """Numbers of the words met."""

    def __init__(self) -> None:
        super().__init__()
        self.default_factory = self.__len__


def periodic_runs(
    df: DataFrame, least: int = 12, text: str = "text", words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed",
) -> DataFrame:
    """``df`` with the number of words, the runs as (start, length, period), and the text without repeats.

    Words are runs of characters other than ASCII white space, numbered from 0. The collapsed text keeps the words
    that no run holds after its first period, joined by one space.
    """
    kept = [c for c in df.columns if c not in (words, runs, collapsed)]
    added = [T.StructField(words, T.LongType()), T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())]
    schema = T.StructType([*[df.schema[c] for c in kept], *added])
    fields = pa.struct([(f.name, pa.int64()) for f in RUN])

    def run(batches):
        known = Words()
        for whole in batches:
            for batch in small_batches(whole, text):
                cut = [(t or b"").split() for t in batch.column(text).cast(pa.binary()).to_pylist()]
                size = np.fromiter(map(len, cut), np.int64, len(cut))
                ends = np.cumsum(size)
                ids = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
                if len(known) > KNOWN_WORDS:
                    known.clear()
                doc = np.repeat(np.arange(len(cut)), size)
                lists: list[list[dict]] = [[] for _ in cut]
                edges = np.zeros(len(ids) + 1, np.int64)
                for start, length, period in runs_of(ids, doc, least):
                    k = int(doc[start])
                    lists[k].append({"start": start - int(ends[k] - size[k]), "length": length, "period": period})
                    edges[start + period] += 1
                    edges[start + length] -= 1
                left = np.cumsum(edges[:-1]) == 0
                short = []
                for k, ws in enumerate(cut):
                    if lists[k]:
                        ws = [w for w, stays in zip(ws, left[ends[k] - size[k] : ends[k]].tolist(), strict=True) if stays]
                    short.append(b" ".join(ws))
                made = [pa.array(size), pa.array(lists, pa.list_(fields)), pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, words, runs, collapsed])

    return df.mapInArrow(run, schema)
