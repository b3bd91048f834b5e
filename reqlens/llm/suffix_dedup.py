"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller number. Strings
are judged on the input and never cross documents.

1. Windows. Each window of ``length`` bytes is named by the least hash of its GRAM-byte strings. Equal windows have
   equal names, and a run of windows with one name is one piece of text. Names that only one text sends cannot
   repeat; they are found by counting, with every part of the documents sending each name once.
2. Pieces. The pieces with repeated names go to the bin of their name, each distinct piece once a part with the
   smallest document that holds it there: a passage that a third of all documents share is one row a part.
3. Bins. Pieces of different bins share no window, so a bin is a small multi-string collection. A name whose pieces
   are all equal needs no search: every window repeats as the piece does. The others are sorted shard by shard
   into Burrows-Wheeler transforms (over super-symbols of STEP bytes, cyclic within a piece), and the transforms are
   merged by refining their interleave: each round lists the current order, and every slot is moved, stably, to the
   bucket of the symbol before it. After length / STEP rounds suffixes are in the order of their first ``length``
   bytes; a slot starts a new interval where its symbol or its former interval differs from its neighbour's, which
   gives the common prefixes in steps. No suffix is sorted again. An interval that keeps ``length`` common bytes
   is a repeated string; its smallest document is the verdict for all of its windows.
4. Verdicts go back to the parts, which cut the texts.

Null and empty texts have no bytes. Equal texts are settled first: only the smallest document of each text goes
through 1 to 3; the others lose everything if they have ``length`` bytes. Rows that share a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reqlens.llm.common import identity, renamed, small_batches, tidy
from reqlens.session import cut_lineage

#: Bytes of a repeated string, of the strings that name windows, and of a super-symbol.
LENGTH, GRAM, STEP = 50, 24, 10
#: Bytes of text that a part, and bytes of input that a bin, should hold.
PART_BYTES, SHARD_BYTES = 6 << 20, 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def window_names(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of ``length`` bytes the least hash of its ``gram``-byte strings."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    power, h, size, done, have, width = MULTIPLIER, _TABLE[data], 1, None, 0, gram
    while True:  # hashes of doubled sizes; the bits of gram say which of them make it up
        if width & 1:
            if done is None:
                done, have = h, size
            else:
                n = len(data) - have - size + 1
                done, have = done[:n] * np.uint64(power) + h[have : have + n], have + size
        width >>= 1
        if not width:
            break
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    h = done
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (span - have)], h[span - have :]) if span > have else h


def starts_of_runs(names: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.empty(0, np.int64)


def spread_names(names: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and 32-bit key of each name, which as a least hash is small and so is mixed once more."""
    names = names * np.uint64(0x94D049BB133111EB)
    names ^= names >> np.uint64(31)
    names *= np.uint64(0xBF58476D1CE4E5B9)
    return ((names >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int32), names.astype(np.uint32)


def _grouped(bins: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bins, kind="stable")
    cuts = starts_of_runs(bins[order])
    for a, b in zip(cuts, [*cuts[1:], len(bins)], strict=True):
        yield int(bins[order[a]]), values[order[a:b]]


def stable_order(ranks: np.ndarray) -> np.ndarray:
    """Stable order of ranks below 2**32, by their lower and then their upper 16 bits: numpy sorts those in linear time."""
    order = np.argsort(ranks.astype(np.uint16), kind="stable")
    upper = (ranks >> 16).astype(np.uint16)
    return order[np.argsort(upper[order], kind="stable")] if len(upper) and upper.any() else order


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' sorted suffixes and the starts of the intervals with ``rounds`` common symbols.

    A shard is (suffixes in their order, for each of them the symbol before it): its Burrows-Wheeler transform.
    """
    sizes = [len(s) for s, _ in shards]
    source = np.repeat(np.arange(len(shards), dtype=np.int16 if len(shards) < 1 << 15 else np.int32), sizes)
    interval = np.zeros(len(source), np.int64)
    symbols = np.concatenate([b for _, b in shards]) if shards else np.empty(0, np.int64)
    for _ in range(rounds):
        # the k-th slot that a shard has in the interleave holds its k-th suffix
        place = np.empty(len(source), np.int64)
        place[np.argsort(source, kind="stable")] = np.arange(len(source))
        before = symbols[place]
        order = stable_order(before)
        before, interval, source = before[order], interval[order], source[order]
        fresh = np.concatenate([[False], (before[1:] != before[:-1]) | (interval[1:] != interval[:-1])])
        interval = np.cumsum(fresh[: len(source)])
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = np.arange(len(source))
    suffixes = np.concatenate([s for s, _ in shards])[place] if shards else np.empty(0, np.int64)
    return suffixes, interval


def symbol_ranks(text: np.ndarray, after: np.ndarray, step: int) -> np.ndarray:
    """Rank of the ``step`` bytes from every place on; after: the next place in the cyclic piece."""
    half = step // 2
    key, at = np.zeros(len(text), np.int64), np.arange(len(text))
    for _ in range(half):
        key = key << 8 | text[at]
        at = after[at]
    first = np.unique(key, return_inverse=True)[1]
    return np.unique(first.astype(np.int64) * (int(first.max()) + 1) + first[at], return_inverse=True)[1]


def least_owner(pieces: list[bytes], owners: np.ndarray, length: int = LENGTH, step: int = STEP) -> list[list[tuple[int, int]]]:
    """For the windows of each piece the smallest owner of a piece that holds them, as runs (windows, owner)."""
    if length % step or step % 2:
        raise ValueError("the length must be a multiple of an even step")
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    piece = np.repeat(np.arange(len(pieces)), sizes)
    base, size = begins[piece], sizes[piece]
    here = np.arange(len(text)) - base
    rank = symbol_ranks(text, base + (here + 1) % size, step)
    before = rank[base + (here - step) % size]
    shards, start = [], 0
    while start < len(pieces):  # sort each shard's suffixes and note the symbol before each
        end = max(start + 1, int(np.searchsorted(ends, begins[start] + SHARD_BYTES, "right")))
        own = np.arange(begins[start], ends[end - 1])
        for ahead in range(length - step, -1, -step):
            own = own[stable_order(rank[base[own] + (here[own] + ahead) % size[own]])]
        shards.append((own, before[own]))
        start = end
    suffixes, interval = merged_intervals(shards, length // step)
    whole = here[suffixes] + length <= size[suffixes]  # a cyclic suffix that runs over its piece's end does not count
    suffixes, interval = suffixes[whole], interval[whole]
    cuts = starts_of_runs(interval)
    verdict = np.zeros(len(text), np.int64)
    verdict[suffixes] = np.repeat(np.minimum.reduceat(owners[piece[suffixes]], cuts), np.diff([*cuts, len(suffixes)]))
    whole = here + length <= size
    own, of = verdict[whole], piece[whole]
    cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])])) if len(own) else np.empty(0, np.int64)
    runs = list(zip(np.diff(np.append(cuts, len(own))).tolist(), own[cuts].tolist(), strict=True))
    at = np.searchsorted(of[cuts], np.arange(len(pieces) + 1)).tolist()
    return [runs[a:b] for a, b in zip(at, at[1:], strict=False)]


def bin_verdicts(pieces: list[bytes], names: np.ndarray, owners: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Runs (windows, smallest owner) of distinct pieces; names whose pieces are all one piece are not searched."""
    _, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(count[inverse] > 1).tolist()
    out = [[(len(p) - length + 1, o)] for p, o in zip(pieces, owners, strict=True)]
    for i, runs in zip(rest, least_owner([pieces[i] for i in rest], np.array([owners[i] for i in rest], np.int64), length), strict=True):
        out[i] = runs
    return out


def _distinct_pieces(docs: list[tuple[int, bytes]], flagged: np.ndarray, bins: int, length: int, gram: int):
    """The part's pieces with flagged names, each with bin and smallest document; and where each document has them."""
    found: dict[bytes, list[int]] = {}
    uses = []
    for doc, raw in docs:
        names = window_names(np.frombuffer(raw, np.uint8), length, gram)
        first = starts_of_runs(names)
        last = np.concatenate([first[1:], [len(names)]]) + length - 1
        at, key = spread_names(names[first], bins)
        both = at.astype(np.uint64) << np.uint64(32) | key
        spot = np.searchsorted(flagged, both)
        hit = np.flatnonzero(np.append(flagged, np.uint64(0))[spot] == both) if len(flagged) else []
        own = []
        for a, b, bin_ in zip(first[hit].tolist(), last[hit].tolist(), at[hit].tolist(), strict=True) if len(hit) else ():
            piece = raw[a:b]
            entry = found.get(piece)
            if entry is None:
                found[piece] = [bin_, doc]
            elif doc < entry[1]:
                entry[1] = doc
            own.append((a, piece))
        uses.append(own)
    return found, uses


def _flags(letters: pd.DataFrame) -> np.ndarray:
    """Sorted (bin, key) that are flagged, from the letters a part was sent."""
    rows = letters[letters["kind"] == FLAGS]
    got = [np.uint64(b) << np.uint64(32) | np.frombuffer(v, np.uint32).astype(np.uint64) for b, v in zip(rows["bin"], rows["blob"], strict=True)]
    return np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)


def _originals(texts: pd.DataFrame, letters: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """(row, document, text) of the rows that are no copies of a smaller document."""
    rows = letters[letters["kind"] == COPIES]
    gone = set(zip(rows["id"].tolist(), rows["hash"].tolist(), strict=True))
    each = enumerate(zip(texts["_id"].tolist(), texts["_hash"].tolist(), texts["_raw"], strict=True))
    return [(k, i, raw) for k, (i, h, raw) in each if (i, h) not in gone]


def _pack_runs(lists: list[list[tuple[int, int]]]) -> bytes:
    """Number of pieces, then runs of each piece, then their windows and owners."""
    flat = [x for runs in lists for x in runs]
    head = np.array([len(lists), *map(len, lists)], np.int32).tobytes()
    return head + np.array([n for n, _ in flat], np.int32).tobytes() + np.array([o for _, o in flat], np.int64).tobytes()


def _unpack_runs(blob: bytes) -> Iterator[list[tuple[int, int]]]:
    n = int(np.frombuffer(blob, np.int32, 1)[0])
    counts = np.frombuffer(blob, np.int32, n, 4).tolist()
    total = sum(counts)
    at = 4 + 4 * n
    flat = list(zip(np.frombuffer(blob, np.int32, total, at).tolist(), np.frombuffer(blob, np.int64, total, at + 4 * total).tolist(), strict=True))
    k = 0
    for c in counts:
        yield flat[k : k + c]
        k += c


def _byte_runs(windows: np.ndarray, length: int) -> list[int]:
    """Starts and ends, in turn, of the maximal byte runs that the marked windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], windows.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2] + length - 1
    if not len(starts):
        return []
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([fresh[1:], [True]])
    return np.stack([starts[fresh], ends[last]], axis=1).ravel().tolist()


#: Kinds of letters sent to a part.
FLAGS, COPIES, VERDICTS = 0, 1, 2


def repeated_bytes(
    df: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): of each row the removed byte runs (starts and ends in turn) and what is left.

    The string columns named in ``carry`` follow. ``part_bytes`` of text are one task's part: smaller ones take less memory
    and send more letters.
    """
    carry = carry or []
    rows = renamed(df, {doc: "_doc", text: "_text", **{c: f"_carry_{c}" for c in carry}}).select(
        *[F.col(f"_carry_{c}").cast("string") for c in carry], F.col("_doc").isNotNull().alias("_named"), identity("_doc", "_text").alias("_id"),
        F.coalesce("_text", F.lit("")).cast("binary").alias("_raw")).withColumn("_hash", F.xxhash64("_raw"))
    sized = cut_lineage(rows.select("_id", "_hash", F.octet_length("_raw").alias("_n"), F.sha2("_raw", 256).alias("_digest")), "digests")
    total = sized.agg(F.sum("_n")).first()[0] or 0
    n_parts = max(4, -(-total // part_bytes))
    n_bins = n_parts
    least = sized.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    copies = sized.join(least, "_digest").where("_id <> _first").select("_id", "_hash").distinct()
    texts = rows.withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(n_parts)).cast("int"))

    def letters(df: DataFrame, kind: int, part, bin_, id_, hash_, blob) -> DataFrame:
        zero, nothing = F.lit(0).cast("long"), F.lit(b"")
        return df.select(part.cast("int").alias("part"), F.lit(kind).alias("kind"), (zero if bin_ is None else bin_).alias("bin"),
                         (zero if id_ is None else id_).alias("id"), (zero if hash_ is None else hash_).alias("hash"),
                         (nothing if blob is None else blob).alias("blob"))

    def send_names(batches):
        for whole in batches:
            for batch in small_batches(whole, "_raw"):
                lists, parts = [], []
                for p, raw in zip(batch.column("part").to_pylist(), batch.column("_raw").to_pylist(), strict=True):
                    names = window_names(np.frombuffer(raw, np.uint8), length, gram)
                    if len(names):
                        lists.append(np.unique(names[starts_of_runs(names)]))
                        parts.append(p)
                if not lists:
                    continue
                names, owner = np.concatenate(lists), np.repeat(np.array(parts, np.uint32), [len(x) for x in lists])
                order = np.lexsort((names, owner))
                names, owner = names[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])]))
                many = np.diff([*first, len(names)]) > 1
                at, key = spread_names(names[first], n_bins)
                tag = owner[first] << np.uint32(1) | many.astype(np.uint32)
                out = [(b, key[rows].tobytes(), tag[rows].tobytes()) for b, rows in _grouped(at, np.arange(len(at)))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["bin", "keys", "tags"])

    @tidy
    def flag_names(rows: pd.DataFrame) -> pd.DataFrame:
        keys, tags = (np.concatenate([np.frombuffer(v, np.uint32) for v in rows[c]]) for c in ("keys", "tags"))
        weight, owner = (tags & np.uint32(1)).astype(np.int64) + 1, (tags >> np.uint32(1)).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, weight, owner = keys[order], weight[order], owner[order]
        cuts = starts_of_runs(keys)
        again = np.repeat(np.add.reduceat(weight, cuts) > 1, np.diff([*cuts, len(keys)]))
        out = [(rows["bin"].iloc[0], p, np.unique(k).tobytes()) for p, k in _grouped(owner[again], keys[again])] if again.any() else []
        return pd.DataFrame(out, columns=["bin", "part", "keys"])

    names = texts.select("part", "_raw").mapInArrow(send_names, "bin long, keys binary, tags binary")
    flagged = names.groupBy("bin").applyInPandas(flag_names, "bin long, part long, keys binary")
    mail = letters(flagged, FLAGS, F.col("part"), F.col("bin"), None, None, F.col("keys")).unionByName(
        letters(copies, COPIES, F.pmod(F.xxhash64("_id"), F.lit(n_parts)), None, F.col("_id"), F.col("_hash"), None))
    mail = cut_lineage(mail, "flags")

    @tidy
    def send_pieces(texts: pd.DataFrame, letters: pd.DataFrame) -> pd.DataFrame:
        docs = [(i, raw) for _, i, raw in _originals(texts, letters)]
        found, _ = _distinct_pieces(docs, _flags(letters), n_bins, length, gram)
        by_bin: dict[int, list] = {}
        for piece, (at, owner) in found.items():
            by_bin.setdefault(at, []).append((piece, owner))
        out = []
        for at, got in by_bin.items():
            got.sort()
            out.append((at, texts["part"].iloc[0], b"".join(x for x, _ in got), np.array([len(x) for x, _ in got], np.int32).tobytes(),
                        np.array([o for _, o in got], np.int64).tobytes()))
        return pd.DataFrame(out, columns=["bin", "part", "pieces", "sizes", "owners"])

    @tidy
    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        index: dict[bytes, int] = {}
        names, owners, refs = [], [], []
        for blob, sizes, owner in zip(rows["pieces"], rows["sizes"], rows["owners"], strict=True):
            size = np.frombuffer(sizes, np.int32)
            begins = np.cumsum(size) - size
            name = window_names(np.frombuffer(blob, np.uint8), length, gram)[begins]
            own = []
            for a, n, k, o in zip(begins.tolist(), size.tolist(), name.tolist(), np.frombuffer(owner, np.int64).tolist(), strict=True):
                i = index.setdefault(blob[a : a + n], len(names))
                if i == len(names):
                    names.append(k)
                    owners.append(o)
                elif o < owners[i]:
                    owners[i] = o
                own.append(i)
            refs.append(own)
        verdicts = bin_verdicts(list(index), np.array(names, np.uint64), owners, length)
        out = [(p, b, _pack_runs([verdicts[i] for i in own])) for p, b, own in zip(rows["part"], rows["bin"], refs, strict=True)]
        return pd.DataFrame(out, columns=["part", "bin", "runs"])

    sent = texts.select("part", "_id", "_hash", "_raw").groupBy("part").cogroup(mail.groupBy("part")).applyInPandas(
        send_pieces, "bin long, part long, pieces binary, sizes binary, owners binary")
    answers = sent.groupBy("bin").applyInPandas(answer, "part long, bin long, runs binary")
    back = mail.unionByName(letters(answers, VERDICTS, F.col("part"), F.col("bin"), None, None, F.col("runs")))

    @tidy
    def cut_texts(texts: pd.DataFrame, letters: pd.DataFrame) -> pd.DataFrame:
        own = _originals(texts, letters)
        found, uses = _distinct_pieces([(i, raw) for _, i, raw in own], _flags(letters), n_bins, length, gram)
        by_bin: dict[int, list] = {}
        for piece, (at, _) in found.items():
            by_bin.setdefault(at, []).append(piece)
        least: dict[bytes, list[tuple[int, int]]] = {}
        rows = letters[letters["kind"] == VERDICTS]
        for at, blob in zip(rows["bin"].tolist(), rows["blob"], strict=True):
            least.update(zip(sorted(by_bin[at]), _unpack_runs(blob), strict=True))
        removed: dict[int, list[int]] = {}
        for (k, i, raw), pieces in zip(own, uses, strict=True):
            windows = None
            for a, piece in pieces:
                for n, owner in least[piece]:
                    if owner < i:
                        windows = np.zeros(len(raw) - length + 1, bool) if windows is None else windows
                        windows[a : a + n] = True
                    a += n
            removed[k] = [] if windows is None else _byte_runs(windows, length)
        out = []
        for k, (named, i, raw) in enumerate(zip(texts["_named"], texts["_id"].tolist(), texts["_raw"], strict=True)):
            runs = removed.get(k, [0, len(raw)] if len(raw) >= length else [])
            kept = b"".join(raw[a:b] for a, b in zip([0, *runs[1::2]], [*runs[::2], len(raw)], strict=True))
            out.append((i if named else None, len(raw), runs, kept))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "removed", "kept"]).astype({"doc_id": "Int64"})
        for c in carry:
            frame[c] = texts[f"_carry_{c}"].to_numpy(object)
        return frame

    return texts.groupBy("part").cogroup(back.groupBy("part")).applyInPandas(
        cut_texts, ", ".join(["doc_id long, n_bytes long, removed array<bigint>, kept binary", *[f"`{c}` string" for c in carry]]))


def whole_characters(name: str) -> Column:
    """Kept bytes as a text; what is left of a character that was cut in two goes."""

    @pandas_udf("string")
    def text(kept: pd.Series) -> pd.Series:
        return kept.map(lambda raw: raw.decode("utf-8", "ignore"), na_action="ignore")

    return text(F.col(name))
