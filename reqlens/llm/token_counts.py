"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

The pretokens of a batch that were not met before lie in one flat array, one stretch a sequence. Every round finds
each sequence's lowest pair rank and merges that pair in all sequences at once, wherever it stands; sequences in which
no pair can be merged leave with the number of symbols they have left.

Null and empty texts have no tokens. Extra columns pass through; an input column named like the output column is
replaced. Repeated rows are counted alike. A very long pretoken takes one round for each rank that occurs in it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reqlens.llm.bpe import byte_characters
from reqlens.llm.common import small_batches

#: Fixed value: the pattern that cuts text into pretokens for vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern, for texts of ASCII characters only.
BLANK = r"\x20\x09-\x0D"
#: Rank of a pair that cannot be merged; bits of an id in a pair's key.
NO_MERGE, PAIR = np.int32(2**31 - 1), np.int64(32)
#: Pretokens a worker remembers, and the bytes up to which one is remembered.
KNOWN_WORDS, KNOWN_BYTES = 400_000, 64


class RankMerges:
    """The merges of a vocabulary as sorted arrays, applied to many sequences at once."""

    def __init__(self, rules: dict) -> None:
        vocab = rules["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << PAIR | right
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_ids = np.array([vocab[c] for c in byte_characters()], np.int64)
        made = np.full(max(vocab.values()) + 1, -1)
        made[self.merged] = np.arange(len(pairs))
        #: Whether symbols are made before they are merged on. Then a merge opens no pair of a lower rank, and all
        #: places of a sequence's lowest pair merge in one round; otherwise only the leftmost does.
        self.ordered = bool(len(np.unique(self.merged)) == len(pairs) and (np.maximum(made[left], made[right]) < np.arange(len(pairs))).all())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; a missing neighbour is negative."""
        if not len(self.keys):
            return np.full(len(a), NO_MERGE)
        key = a << PAIR | b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[place] == key), self.rank_of[place], NO_MERGE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols left of every word, none of which is empty."""
        out = np.empty(len(words), np.int64)
        seq, left = np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = None
        while len(seq):
            # Lay the open sequences out afresh; the slot behind the last one stands for a missing neighbour.
            size, n = left.copy(), len(ids)
            starts = np.cumsum(size) - size
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            after[starts + size - 1] = before[starts] = n
            ids = np.append(ids, -1)
            if rank is None:
                rank = self.ranks(ids[:n], ids[after[:n]])
            rank = np.append(rank, NO_MERGE)
            owner = np.repeat(np.arange(len(seq)), size)
            while True:
                low = np.minimum.reduceat(rank[:n], starts)
                if low.max() == NO_MERGE or 2 * left.sum() < n:
                    break
                at = self._apart(np.flatnonzero(rank[:n] == low[owner]), after, owner)
                gone = after[at]
                ids[at] = self.merged[rank[at]]
                ids[gone], rank[gone] = -1, NO_MERGE
                after[at] = after[gone]
                before[after[gone]] = at
                left -= np.bincount(owner[at], minlength=len(seq))
                changed = np.concatenate([at, before[at]])
                changed = changed[changed < n]
                rank[changed] = self.ranks(ids[changed], ids[after[changed]])
            still = low < NO_MERGE
            out[seq[~still]] = left[~still]
            kept = still[owner] & (ids[:n] >= 0)
            ids, rank, seq, left = ids[:n][kept], rank[:n][kept], seq[still], left[still]
        return out

    def _apart(self, at: np.ndarray, after: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The places that merge in this round: of pairs that share a symbol every second one, from the left."""
        if not self.ordered:
            return at[np.unique(owner[at], return_index=True)[1]]
        touching = after[at[:-1]] == at[1:]
        if not touching.any():
            return at
        number = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.append(True, ~touching), number, 0))
        return at[(number - first) % 2 == 0]


class Counter:
    """Counts the tokens of texts by the rules of one vocabulary file."""

    def __init__(self, text: str) -> None:
        rules = json.loads(text)
        if rules["model"]["type"] != "BPE" or (rules["pre_tokenizer"] or {}).get("type") != "ByteLevel" or rules["normalizer"]:
            raise ValueError("only byte-level BPE files without a normal form are covered")
        self.merges = RankMerges(rules)
        self.words = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        plain = PATTERN.replace(r"[^\s", f"[^{BLANK}").replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]")
        plain = re.sub(r"\[\^([^]]*)\\p\{L\}\\p\{N\}\]", r"[^\1A-Za-z0-9]", plain)
        self.ascii_words = re.compile(plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"))
        specials = [x["content"] for x in rules["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.known: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """Pretokens of a text, and the number of special strings in it."""
        if self.special is None or not (cuts := len(self.special.findall(text))):
            return (self.ascii_words if text.isascii() else self.words).findall(text), 0
        return [w for piece in self.special.split(text) for w in self.words.findall(piece)], cuts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of every text."""
        known = self.known
        cut = [self.split(t) if t else ([], 0) for t in texts]
        fresh = list(set().union(*(words for words, _ in cut)) - known.keys())
        if fresh:
            known.update(zip(fresh, self.merges.counts([w.encode() for w in fresh]).tolist(), strict=True))
        out = np.fromiter((sum(map(known.__getitem__, words)) + specials for words, specials in cut), np.int64, len(cut))
        for word in fresh:
            if len(word) > KNOWN_BYTES:
                del known[word]
        if len(known) > KNOWN_WORDS:
            known.clear()
        return out


@lru_cache(maxsize=2)
def counter_of(text: str) -> Counter:
    """The counter of a vocabulary file; a worker process keeps it from task to task."""
    return Counter(text)


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text; ``vocabulary`` is the path of the file on the driver.

    Special strings inside a text are one token each; no others are added.
    """
    with open(vocabulary, encoding="utf-8") as f:
        rules = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.LongType())])

    def run(batches):
        counter = counter_of(rules.value)
        for whole in batches:
            for batch in small_batches(whole, text):
                found = counter.counts(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found)], names=[*kept, out])

    return df.mapInArrow(run, schema)
