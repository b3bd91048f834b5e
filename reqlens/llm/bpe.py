"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Null and empty texts encode to no ids and decode to an empty text; extra columns pass through, an input column
named like the output column is replaced. Repeated rows are coded alike. Very long words cost n log n.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reqlens.llm.common import give_back, small_batches

#: Rank of a leaf whose pair cannot be merged, and bits of an id in a pair.
NO_MERGE, PAIR = 1 << 62, 24
#: Symbols up to which words of a batch are merged side by side; bits of a place in their leaves.
SHORT, PLACE = 64, 8
#: Words a worker remembers, and the characters up to which one is remembered.
KNOWN_WORDS, KNOWN_CHARS = 100_000, 40
#: Bytes of texts that are coded at once.
CODED_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print as Latin-1 stand for themselves; the others take the code points from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merge_word(ids: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """Merge the lowest-ranked, leftmost pair until none can be merged; ranks: pair -> (rank, merged id).

    A segment tree holds the least of rank * n + place over the adjacent pairs, so its root is the leftmost pair
    of the lowest rank. A merge changes three leaves (the pair's own, its right part's and its left neighbour's),
    and an update climbs only as far as the least changes.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids, get = list(ids), ranks.get
    leaves = []
    for i in range(n - 1):
        found = get(ids[i] << PAIR | ids[i + 1])
        leaves.append(found[0] * n + i if found else NO_MERGE)
    size = 1 << (n - 1).bit_length()
    tree = [NO_MERGE] * size + leaves + [NO_MERGE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) < NO_MERGE:
        i = least % n
        j = after[i]
        ids[i] = get(ids[i] << PAIR | ids[j])[1]
        ids[j] = -1
        after[i] = k = after[j]
        changed = [(j, NO_MERGE)]
        found = None
        if k < n:
            before[k] = i
            found = get(ids[i] << PAIR | ids[k])
        changed.append((i, found[0] * n + i if found else NO_MERGE))
        if (h := before[i]) >= 0:
            found = get(ids[h] << PAIR | ids[i])
            changed.append((h, found[0] * n + h if found else NO_MERGE))
        for leaf, key in changed:
            leaf += size
            if tree[leaf] == key:
                continue
            tree[leaf] = key
            while leaf > 1:
                other = tree[leaf ^ 1]
                if other < key:
                    key = other
                leaf >>= 1
                if tree[leaf] == key:
                    break
                tree[leaf] = key
    return [x for x in ids if x >= 0]


class Forest:
    """The same trees for many short words at once, a row each, with the merges as sorted arrays."""

    def __init__(self, ranks: dict[int, tuple[int, int]]) -> None:
        pairs = np.array(list(ranks), np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.rank = np.array([r for r, _ in ranks.values()], np.int64)[order]
        self.merged = np.zeros(int(self.rank.max(initial=-1)) + 1, np.int32)
        self.merged[self.rank] = np.array([m for _, m in ranks.values()], np.int64)[order]

    def keys(self, a: np.ndarray, b: np.ndarray, place) -> np.ndarray:
        """What the leaves hold: rank and place of a pair."""
        if not len(self.pairs):
            return np.full(np.broadcast(a, b).shape, NO_MERGE)
        pair = a.astype(np.int64) << PAIR | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pairs[at] == pair), self.rank[at] << PLACE | place, NO_MERGE)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Merge words of the same number of leaves, padded with -1; what is merged away becomes -1."""
        size = ids.shape[1]
        wide = np.full((len(ids), size + 1), -1, np.int32)
        wide[:, :size] = ids
        tree = np.full((len(ids), 2 * size), NO_MERGE)
        tree[:, size:] = self.keys(ids, wide[:, 1:], np.arange(size))
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, size + 2, dtype=np.int16), (len(ids), 1))
        after[:, size] = size
        before = np.tile(np.arange(-1, size, dtype=np.int16), (len(ids), 1))
        rows = np.arange(len(ids))
        while len(rows := rows[tree[rows, 1] < NO_MERGE]):
            least = tree[rows, 1]
            i = least & ((1 << PLACE) - 1)
            j = after[rows, i].astype(np.int64)
            k = after[rows, j].astype(np.int64)
            wide[rows, i], wide[rows, j] = self.merged[least >> PLACE], -1
            after[rows, i], before[rows, k] = k, i
            h = before[rows, i].astype(np.int64)
            # Leaves that change: the merged-away part's, the pair's own, its left neighbour's.
            has = h >= 0
            where = np.concatenate([rows, rows, rows[has]])
            leaf = np.concatenate([j, i, h[has]])
            right = np.concatenate([np.full(len(rows), size), k, i[has]])
            tree[where, size + leaf] = self.keys(wide[where, leaf], wide[where, right], leaf)
            node = (size + leaf) // 2
            while node[0]:
                tree[where, node] = np.minimum(tree[where, 2 * node], tree[where, 2 * node + 1])
                node //= 2
        return wide[:, :size]


def token_strings(rules: dict) -> dict[int, str]:
    """Each id's string, special tokens included."""
    return {i: t for t, i in rules["model"]["vocab"].items()} | {x["id"]: x["content"] for x in rules["added_tokens"]}


class WordBpe:
    """The rules of one vocabulary file: special tokens, normal form, word pattern, merges.

    Covers files of lower-cased byte-level words with a word end; words met before are looked up, the new words of a
    batch are merged side by side.
    """

    def __init__(self, text: str) -> None:
        rules = json.loads(text)
        model = rules["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pieces = rules["pre_tokenizer"]["pretokenizers"]
        pattern = pieces[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        simple = pattern.replace(r"\p{White_Space}", r"\x20\x09-\x0D").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        self.ascii_words = re.compile(simple)
        self.specials = {x["content"]: x["id"] for x in rules["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in self.specials) + ")") if self.specials else None
        self.vocab, self.characters = vocab, byte_characters()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a] << PAIR | vocab[b]] = (rank, vocab[a + b])
        self.tokens = token_strings(rules)
        self.forest = Forest(self.ranks)
        inner = [vocab.get(c, -1) for c in self.characters]
        last = [vocab.get(c + self.end, -1) for c in self.characters]
        self.symbols = np.array([inner, last], np.int32)
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, str] = {}

    def merged(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words, none of them empty: their bytes' characters, the last one with the word end, merged."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        place = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        place[ends - 1] = 1
        flat = self.symbols[place, np.frombuffer(b"".join(raw), np.uint8)]
        if (flat < 0).any():  # symbols that the vocabulary lacks are left out
            size = np.add.reduceat(flat >= 0, ends - size)
            flat, ends = flat[flat >= 0], np.cumsum(size)
        out: list[tuple[int, ...]] = [()] * len(raw)
        width = np.left_shift(1, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
        for leaves in np.unique(width).tolist():
            here = np.flatnonzero(width == leaves)
            start = (ends - size)[here]
            if leaves > SHORT:
                for k, a in zip(here.tolist(), start.tolist(), strict=True):
                    out[k] = tuple(merge_word(flat[a : ends[k]].tolist(), self.ranks))
                continue
            inside = np.arange(leaves) < size[here][:, None]
            ids = np.full((len(here), leaves), -1, np.int32)
            ids[inside] = flat[(start[:, None] + np.arange(leaves))[inside]]
            ids = self.forest.merge(ids)
            left = ids >= 0
            found, upto = ids[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
            for k, a, b in zip(here.tolist(), [0, *upto], upto, strict=False):
                out[k] = tuple(found[a:b])
        return out

    def split(self, text: str) -> list[str]:
        """Words of the normal form: composed, lower-cased one character at a time (a final sigma is not special)."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str | None) -> list[str]:
        """Words and, after a space, special strings of a text, in order."""
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self.split(text)
        cut = self.special.split(text)
        return [w for k, piece in enumerate(cut) for w in ([f" {piece}"] if k % 2 else self.split(piece))]

    def code(self, texts: list[str | None]) -> list[list[str]]:
        """The words of all texts, every one of them known afterwards."""
        known, shown = self.known, self.shown
        for word in [w for w in known if len(w) > KNOWN_CHARS] if len(known) <= KNOWN_WORDS else list(known):
            del known[word], shown[word]
        cut = [self.pieces(t) for t in texts]
        fresh = list(set().union(*cut) - known.keys())
        plain = [w for w in fresh if w[0] != " "]
        known.update(zip(plain, self.merged(plain), strict=True))
        known.update((w, (self.specials[w[1:]],)) for w in fresh if w[0] == " ")
        tokens = self.tokens
        shown.update((w, " ".join([tokens[i] for i in known[w]])) for w in fresh)
        return cut

    def encode_all(self, texts: list[str | None]) -> list[Iterator[int]]:
        """Ids of every text."""
        return [chain.from_iterable(map(self.known.__getitem__, words)) for words in self.code(texts)]

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def round_trip(self, texts: list[str | None]) -> Iterator[tuple[Iterable[int], str]]:
        """Ids of every text, and the text they stand for."""
        for words in self.code(texts):
            yield chain.from_iterable(map(self.known.__getitem__, words)), " ".join(filter(None, map(self.shown.__getitem__, words)))


def rules_of(text: str) -> WordBpe:
    """Rules of a vocabulary file, with room for the words met in a task; a worker does not keep them for later tasks."""
    return WordBpe(text)


def _with_columns(df: DataFrame, kinds: dict[str, T.DataType], make, by: str | None = None) -> DataFrame:
    """``df`` with more columns, computed from small Arrow batches by the function that ``make`` returns."""
    kept = [c for c in df.columns if c not in kinds]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(k, v) for k, v in kinds.items()]])

    def run(batches):
        usual = gc.get_threshold()
        gc.set_threshold(200_000)  # the words met are many small objects; default passes over them cost a sixth
        work = make()
        try:
            for whole in batches:
                for batch in small_batches(whole, by, CODED_BYTES) if by else [whole]:
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *work(batch)], names=[*kept, *kinds])
        finally:
            del work
            gc.set_threshold(*usual)
            give_back()

    return df.mapInArrow(run, schema)


def _lists(flat: array, ends: array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text; ``vocabulary`` is the path of a tokenizers file on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        rules = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = rules_of(rules.value)

        def work(batch):
            flat, ends = array("i"), array("i", [0])
            for coded in bpe.encode_all(batch.column(text).to_pylist()):
                flat.extend(coded)
                ends.append(len(flat))
            return [_lists(flat, ends)]

        return work

    return _with_columns(df, {out: T.ArrayType(T.IntegerType())}, make, text)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of each whole text and the text they decode to, in one pass over the words."""
    with open(vocabulary, encoding="utf-8") as f:
        rules = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = rules_of(rules.value)

        def work(batch):
            flat, ends, back = array("i"), array("i", [0]), []
            for coded, shown in bpe.round_trip(batch.column(text).to_pylist()):
                flat.extend(coded)
                ends.append(len(flat))
                back.append(shown)
            return [_lists(flat, ends), pa.array(back, pa.string())]

        return work

    return _with_columns(df, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, make, text)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for: the tokens' strings, special ones too, one space between them.

    Null gives an empty text; ids outside the vocabulary are left out.
    """
    with open(vocabulary, encoding="utf-8") as f:
        rules = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        tokens = token_strings(json.loads(rules.value))
        strings = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_string())

        def work(batch):
            lists = batch.column(ids).fill_null([]) if batch.column(ids).null_count else batch.column(ids)
            flat, rows = lists.flatten(), pc.list_parent_indices(lists)
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(strings)))
            flat, rows = flat.filter(known), rows.filter(known)
            shown = strings.take(flat)
            if shown.null_count:
                rows, shown = rows.filter(shown.is_valid()), shown.drop_null()
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows.to_numpy(), minlength=len(lists)))])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shown), pa.scalar(" ", pa.large_string()))
            return [joined.cast(pa.string())]

        return work

    return _with_columns(df, {out: T.StringType()}, make)
