"""Collocations of every language from a weighted de Bruijn graph of word grams.

Edges are the longest grams: from every word, the following words up to ``longest`` within its piece. Their weights
are summed once; a gram that the piece's end makes shorter is that end's correction. What flows out of a node along
its edges, plus the pieces that end there, is the node's own count, so the counts of all shorter phrases follow from
the edges by one sum for each length, without another look at the texts. A node whose whole flow passes through one
edge lies inside a unary path and is compacted into that edge: the longer phrase says all it says.

Only phrases counted ``least`` times or more matter, and neighbours of such a phrase are frequent pairs. So pairs are
counted first, by hash, and an edge ends where a pair is too rare, which counts as the end of a piece. The frequent
hashes travel as a bitmap of a fixed size; a false hit keeps an edge longer than needed and changes no result.

Null texts are empty, null languages count as ``und``. Empty texts give nothing, repeated rows count again, an empty
table gives no rows. Columns other than text and language are not looked at. Equal scores are ordered by count, then
by the phrase's bytes. Piece marks and blanks are ASCII; only A to Z are lower-cased.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.llm.common import hash_bitmap, in_bitmap, renamed, small_batches
from reqlens.session import cut_lineage

#: Bytes that end a piece, and the blanks between words.
MARKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A byte that no UTF-8 text holds stands for a piece's end.
END = b"\xff"
FOLD = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + MARKS + BLANKS, bytes(range(ord("a"), ord("z") + 1)) + END * len(MARKS) + b" " * len(BLANKS)
)
#: Words a worker remembers; hashes it holds before it counts them.
KNOWN_WORDS, HELD = 1_000_000, 4_000_000
#: Parts in which a language's best phrases are found before they are put in one order.
PARTS = 16


class Words(dict):
    """Numbers and hashes of the words met; number 0 is a piece's end."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.words, self.new, self.hashes = [END], [], np.zeros(1, np.uint64)
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.new.append(xxhash.xxh64_intdigest(word))
        return number

    def hash_of(self, ids: np.ndarray) -> np.ndarray:
        if self.new:
            self.hashes, self.new = np.concatenate([self.hashes, np.array(self.new, np.uint64)]), []
        return self.hashes[ids]

    def numbers(self, texts: list[bytes | None]) -> np.ndarray:
        """The words of the texts' pieces, with an end after each piece."""
        folded = (END.join(t for t in texts if t) + END).translate(FOLD)
        found = folded.replace(END, b" " + END + b" ").split(b" ")
        return np.fromiter(map(self.__getitem__, filter(None, found)), np.int64)


def pair_hashes(ids: np.ndarray, known: Words, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the next one, and whether both are in one piece."""
    h = known.hash_of(ids)
    with np.errstate(over="ignore"):
        mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(xxhash.xxh64_intdigest(lang.encode())))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29)), (ids[:-1] > 0) & (ids[1:] > 0)


def _by_language(batches):
    """(language, texts) of every small batch."""
    for whole in batches:
        for batch in small_batches(whole, "_text"):
            langs = batch.column("_lang")
            for lang in langs.unique().to_pylist():
                yield lang, batch.column("_text").filter(pc.equal(langs, lang)).cast(pa.binary()).to_pylist()


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(h, c): occurrences of pairs by hash, and with h null and a language its number of words."""

    def run(batches):
        known, held, n = Words(), [], {}

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            step = 200_000
            for k in range(0, len(h), step):
                part = pa.array(h[k : k + step].view(np.int64)), pa.array(c[k : k + step])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part[0]), pa.string()), *part], names=["lang", "h", "c"])

        for lang, texts in _by_language(batches):
            ids = known.numbers(texts)
            n[lang] = n.get(lang, 0) + int(np.count_nonzero(ids))
            h, inside = pair_hashes(ids, known, lang)
            held.append(h[inside])
            if sum(map(len, held)) > HELD:
                yield from flush()
            if len(known) > KNOWN_WORDS:
                known.clear()
        if held:
            yield from flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.string()), pa.nulls(len(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["lang", "h", "c"])

    return rows.mapInArrow(run, "lang string, h long, c long")


def _bitmap(pairs: DataFrame, least: int) -> np.ndarray:
    """Map of the frequent pairs' hashes."""
    counted = pairs.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("c").alias("c"))
    return hash_bitmap(counted.where(F.col("c") >= least))


def _edges(rows: DataFrame, bitmap: np.ndarray, longest: int) -> DataFrame:
    """(lang, gram, k, c): the grams of each batch from every word to its piece's end, ``longest`` words at most."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        known, bits = Words(), shared.value
        for lang, texts in _by_language(batches):
            ids = known.numbers(texts)
            h, inside = pair_hashes(ids, known, lang)
            linked = inside & in_bitmap(bits, h)
            at = np.flatnonzero(ids)
            open_ = np.ones(len(at), bool)
            padded = np.concatenate([linked, np.zeros(longest, bool)])
            wide = np.concatenate([ids, np.zeros(longest, np.int64)])
            columns, name = [wide[at]], wide[at]
            for k in range(1, longest):
                open_ = open_ & padded[at + k - 1]
                columns.append(np.where(open_, wide[at + k], 0))
                name = pd.factorize(name << 32 | columns[-1])[0]
            if len(at):
                first = np.full(int(name.max()) + 1, -1)
                first[name[::-1]] = np.arange(len(name))[::-1]
                size = sum((c[first] > 0).astype(np.int64) for c in columns)
                words = np.array(known.words, object)
                count = np.bincount(name)
                for k in range(1, longest + 1):
                    here = np.flatnonzero(size == k)
                    grams = [b" ".join(g) for g in zip(*(words[c[first[here]]] for c in columns[:k]), strict=True)]
                    if grams:
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(lang, len(grams)), pa.array(grams, pa.binary()).cast(pa.string()), pa.repeat(k, len(grams)).cast(pa.int32()),
                             pa.array(count[here])], names=["lang", "gram", "k", "c"])
            if len(known) > KNOWN_WORDS:
                known.clear()

    return rows.mapInArrow(run, "lang string, gram string, k int, c long").groupBy("lang", "gram", "k").agg(F.sum("c").alias("c"))


def _first_words(gram: Column, k: Column) -> Column:
    return F.call_function("substring_index", gram, F.lit(" "), k)


def phrase_counts(edges: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, gram, k, c) of all phrases counted ``least`` times or more, from the edges."""
    edges = cut_lineage(edges, "edges")
    level = edges.where(F.col("k") == longest)
    out = level.where(F.col("c") >= least)
    for k in range(longest - 1, 0, -1):
        flow = level.select("lang", F.substring_index("gram", " ", k).alias("gram"), F.lit(k).alias("k"), "c")
        ends = edges.where(F.col("k") == k)
        level = flow.unionByName(ends).groupBy("lang", "gram", "k").agg(F.sum("c").alias("c"))
        level = cut_lineage(level, f"grams-{k}") if k > 1 else level
        out = out.unionByName(level.where(F.col("c") >= least))
    return cut_lineage(out, "phrases")


def collocations(
    df: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang: str = "lang", text: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    a is the phrase's count, l and r those of the parts of its lowest-scoring cut, n the language's number of words;
    the score is floor(1000 a n / (l r)).
    """
    rows = renamed(df, {lang: "_lang", text: "_text"}).withColumn("_lang", F.coalesce(F.col("_lang").cast("string"), F.lit("und")))
    pairs = cut_lineage(_pair_counts(rows), "pairs")
    sizes = pairs.where(F.col("h").isNull()).groupBy("lang").agg(F.sum("c").alias("n"))
    phrases = phrase_counts(_edges(rows, _bitmap(pairs, least), longest), longest, least)

    # A node through one of whose edges its whole flow passes is inside a unary path.
    long = phrases.where("k > 1")
    rest = F.expr("substring(gram, length(substring_index(gram, ' ', 1)) + 2)")
    inner = (
        long.where("k > 2").select("lang", F.explode(F.array(_first_words(F.col("gram"), F.col("k") - 1), rest)).alias("gram"), "c")
        .groupBy("lang", "gram").agg(F.max("c").alias("through"))
    )
    candidates = long.join(inner, ["lang", "gram"], "left").where("through is null or through < c").drop("through")

    cuts = candidates.select("lang", F.col("gram").alias("phrase"), F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", _first_words(F.col("phrase"), F.col("cut")))
    cuts = cuts.withColumn("last", F.expr("substring(phrase, length(first) + 2)"))
    for part, count in (("first", "l"), ("last", "r")):
        known = phrases.select("lang", F.col("gram").alias(part), F.col("c").alias(count))
        cuts = cuts.join(known, ["lang", part])
    whole = "decimal(38,0)"
    cuts = cuts.join(sizes, "lang").withColumn(
        "score", F.expr(f"cast((cast(a * 1000 as {whole}) * cast(n as {whole})) as {whole}) div cast(cast(l as {whole}) * cast(r as {whole}) as {whole})"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("m")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.hash("phrase"), F.lit(PARTS))
    best = scored.withColumn("_at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
