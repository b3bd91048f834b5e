"""Scan of texts for a signature catalog of any size.

A pattern that can only match a text holding some literal is filed under that literal, in lower case. One automaton over
all literals reads each lower-cased text once and names the patterns whose literal it holds; only those are run on the
text, by the JVM's regular expressions, in the row itself: nothing is joined or shuffled. Patterns without such a literal
are run on every text, as ``rules.prefilter`` runs all of them.

A catalog table is prepared where its rows lie; the driver only puts the prepared patterns in order. Workers get them as
one broadcast and keep their automaton from task to task.

The literals are found on the tree that Python's ``re`` makes of a pattern. Where that tree could differ from what Java
reads, the pattern counts as one without a literal, so the result is always that of running every pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from re import _constants as code
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.operators.rules import CHUNK, Signature, request_text
from reqlens.session import spread

#: Patterns of one automaton. All automata of a scan are in each worker, and each of them reads every text again.
SLICE = 5_000_000
LEAST = 2
#: Catalog rows that one task prepares, and texts that a worker takes out of a batch at once.
SIGNATURES_A_TASK = 10_000
TEXTS_AT_ONCE = 256
PATTERNS = pa.schema([("pos", pa.int32()), ("id", pa.string()), ("pattern", pa.string()), ("texts", pa.list_(pa.string()))])
CANDIDATES = "array<struct<pos:int,id:string,pattern:string>>"
#: Forms that the two expression languages read differently: flags u, U and x, octal and two-digit escapes, quoting,
#: braces after a word edge, nested classes, class operators and classes that start with a bracket.
UNSURE = re.compile(r"\(\?[a-zA-Z]*[uUx]|\\[0-9]{2}|\\0|\\[QE]|\\b\{|\[[^\]]*\[|\[\^?\]|&&")


def rarity(text: str) -> int:
    """Length of a text where a character other than a letter or digit, rare in prose, counts as four."""
    return sum(1 if c.isalnum() else 4 for c in text)


def _better(left: tuple[str, ...] | None, right: tuple[str, ...] | None, weigh: Callable[[str], int]) -> tuple[str, ...] | None:
    """Of two lists of alternatives the one whose lightest weighs more, then the shorter list."""
    def worth(texts):
        return (min(map(weigh, texts)), -len(texts)) if texts else (0, 0)

    return left if worth(left) >= worth(right) else right


def _plain(number: int) -> bool:
    """Printable ASCII; other characters may change with their neighbours in lower case."""
    return 32 <= number < 127


def _needed(parts, weigh: Callable[[str], int]) -> tuple[str, ...] | None:
    """Texts of which any match of a sequence holds one, or nothing."""
    best, run = None, ""
    for kind, value in [*parts, (None, None)]:
        if kind is code.LITERAL and _plain(value):
            run += chr(value).lower()
            continue
        best, run = _better(best, (run,) if run else None, weigh), ""
        if kind is code.IN and all(item is code.LITERAL and _plain(number) for item, number in value):
            best = _better(best, tuple(sorted({chr(number).lower() for _, number in value})), weigh)
        elif kind is code.SUBPATTERN:
            best = _better(best, _needed(value[3], weigh), weigh)
        elif kind is code.ATOMIC_GROUP:
            best = _better(best, _needed(value, weigh), weigh)
        elif kind in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _needed(value[2], weigh), weigh)
        elif kind is code.BRANCH:
            sides = [_needed(side, weigh) for side in value[1]]
            if all(sides):
                best = _better(best, tuple(sorted({text for side in sides for text in side})), weigh)
    return best


def needed_texts(pattern: str, literal: bool = False, least: int = LEAST, weigh: Callable[[str], int] = len) -> tuple[str, ...] | None:
    """Lower-case texts of which every matching text, in lower case, holds at least one; nothing where none is sure."""
    if literal:
        runs = re.findall(r"[ -~]+", pattern)
        texts = (max(runs, key=len).lower(),) if runs else None
    elif UNSURE.search(pattern):
        texts = None
    else:
        try:
            texts = _needed(parser.parse(pattern), weigh)
        except (re.error, OverflowError, RecursionError):
            texts = None
    return texts if texts and min(map(len, texts)) >= least else None


def guard_of(patterns: Iterable[str]) -> tuple[str, ...]:
    """Lower-case texts of which every text that one of the patterns matches holds one; empty where none is sure."""
    needed = [needed_texts(p, least=1, weigh=rarity) for p in patterns]
    return tuple(sorted({text for texts in needed for text in texts})) if needed and all(needed) else ()


def _quoted(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def worker_part(patterns: pa.Table) -> dict:
    """What a worker needs of patterns (pos, id, pattern, texts): the distinct texts, and by text where its patterns stand."""
    lists = patterns["texts"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owners = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.bincount(numbers, minlength=len(coded.dictionary))
    return {
        "patterns": pa.StructArray.from_arrays([patterns[c].combine_chunks() for c in ("pos", "id", "pattern")], names=["pos", "id", "pattern"]),
        "texts": coded.dictionary, "places": owners[np.argsort(numbers, kind="stable")],
        "starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
    }


def machine_of(part: dict):
    """The automaton over the texts of a part, made once in a process and kept with the part."""
    if "machine" not in part:
        import ahocorasick

        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, text in enumerate(part["texts"].to_pylist()):
            machine.add_word(text, number)
        machine.make_automaton()
        part["machine"] = machine
    return part["machine"]


def places_of(part: dict, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the patterns that need the texts ``numbers``, of which each row holds ``sizes``: offsets by row, and places in order."""
    starts, total = part["starts"], max(1, len(part["patterns"]))
    counts = starts[numbers + 1] - starts[numbers]
    shift = np.repeat(starts[numbers] - (np.cumsum(counts) - counts), counts)
    rows = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
    keys = np.unique(rows * total + part["places"][np.arange(len(shift)) + shift])
    return np.concatenate([[0], np.cumsum(np.bincount(keys // total, minlength=len(sizes)))]), keys % total


def candidates(df: DataFrame, patterns: pa.Table, lower: Column) -> Column:
    """Patterns (pos, id, pattern) whose literal the lower-cased text holds, in the order of the catalog."""
    shared = df.sparkSession.sparkContext.broadcast(worker_part(patterns))

    @F.arrow_udf(CANDIDATES)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        part = shared.value
        machine = machine_of(part)
        for batch in batches:
            numbers, sizes = [], []
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                for text in batch.slice(at, TEXTS_AT_ONCE).to_pylist():
                    held = {number for _, number in machine.iter(text or "")}
                    numbers.extend(held)
                    sizes.append(len(held))
            offsets, taken = places_of(part, np.array(numbers, np.int64), np.array(sizes, np.int64))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), part["patterns"].take(pa.array(taken, pa.int64())))

    return found(lower)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _texts_of(patterns: pa.Array) -> pa.Array:
    return pa.array([needed_texts(p) for p in patterns.to_pylist()], pa.list_(pa.string()))


def catalog_patterns(catalog: DataFrame) -> pa.Table:
    """Patterns of a catalog table in its order, without those that do not compile, and the texts that they need.

    Rows are numbered in the table's order and prepared by many tasks; Java itself compiles each pattern there.
    """
    rows = catalog.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("string"), "patterns")
    each = spread(rows, SIGNATURES_A_TASK).select("row", "id", F.posexplode("patterns").alias("n", "pattern"))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern"))
    found = each.where(compiled.isNotNull()).withColumn("texts", _texts_of("pattern")).toArrow()
    found = found.sort_by([("row", "ascending"), ("n", "ascending")])
    pos = np.unique(found["row"].to_numpy(), return_inverse=True)[1]
    return pa.table([pa.array(pos, pa.int32()), *[found[c].cast(PATTERNS.field(c).type) for c in ("id", "pattern", "texts")]], schema=PATTERNS)


def scan_signatures(df: DataFrame, signatures: Iterable[Signature], slice_size: int = SLICE) -> DataFrame:
    """Add ``matched_signatures``, ids in catalog order, to a request table; equal to ``rules.prefilter``.

    ``signatures`` may be a generator. Guards and words of a signature are shortcuts of the other form and not used.
    A null text matches like an empty one, an empty catalog gives empty lists, an id that stands twice is returned twice
    where both match.
    """
    rows = [
        (pos, signature.id, _quoted(pattern) if signature.literal else pattern, needed_texts(pattern, signature.literal))
        for pos, signature in enumerate(signatures) for pattern in signature.patterns
    ]
    columns = list(zip(*rows, strict=True)) or [()] * len(PATTERNS)
    return _scan(df, pa.table([pa.array(c, f.type) for c, f in zip(columns, PATTERNS, strict=True)], schema=PATTERNS), slice_size)


def scan_catalog(df: DataFrame, catalog: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """The same for a catalog table; patterns that do not compile are dropped, as ``signatures_of`` does."""
    return _scan(df, catalog_patterns(catalog), slice_size)


def _scan(df: DataFrame, patterns: pa.Table, slice_size: int) -> DataFrame:
    sure = pc.is_valid(patterns["texts"])
    filed, always = patterns.filter(sure), patterns.filter(pc.invert(sure)).select(["pos", "id", "pattern"]).to_pylist()
    text = request_text(*[F.col(c) for c in ("method", "uri", "body", "headers")])
    out = df.withColumn("_text", text).withColumn("_lower", F.lower("_text"))
    slices = []
    for at in range(0, filed.num_rows, slice_size):
        slices.append(f"_c{len(slices)}")
        out = out.withColumn(slices[-1], candidates(df, filed.slice(at, slice_size), F.col("_lower")))

    def hit(pos: Column, name: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), name.alias("id"))

    hits = [
        F.transform(F.filter(name, lambda c: F.rlike("_text", c["pattern"])), lambda c: hit(c["pos"], c["id"]))
        for name in slices
    ]
    for at in range(0, len(always), CHUNK):
        tests = [F.when(F.col("_text").rlike(p["pattern"]), hit(F.lit(p["pos"]), F.lit(p["id"]))) for p in always[at : at + CHUNK]]
        hits.append(F.array_compact(F.array(*tests)))
    if not hits:
        return out.drop("_text", "_lower").withColumn("matched_signatures", F.array().cast("array<string>"))
    ordered = F.array_sort(F.array_distinct(F.concat(*hits)))
    return out.withColumn("matched_signatures", F.transform(ordered, lambda s: s["id"])).drop("_text", "_lower", *slices)
