"""Preference formatting of conversation pairs.

Two conversations, one chosen and one rejected, share a prefix of turns. It is rendered once as the prompt; the rest of
each is a completion with a mask: the spans of its text that a loss counts, which are the assistant's turns.

Turns are aligned by their number; a number that a conversation has several times stands for all these turns, sorted
by role and text. The prefix ends at the first number at which the two differ or which only one has. A null role,
turn or text is an empty one (a null turn comes first). Rows without a pair are not used. Pairs that are alike give
two empty completions, and a pair of which one side is missing an empty prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: role, then text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _turns(df: DataFrame, side: str) -> DataFrame:
    """(pair, turn, side): the sorted turns of each number."""
    one = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = df.where("pair_id is not null").select(F.col("pair_id").alias("_pair"), F.coalesce("turn", F.lit(-1)).cast("long").alias("_turn"), one.alias("_one"))
    return rows.groupBy("_pair", "_turn").agg(F.array_sort(F.collect_list("_one")).alias(side))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: render(x["role"], x["text"])), "")


def _mask(turns: Column) -> Column:
    """[start, end) in characters of the assistant's texts in the rendered turns."""
    def step(state, x):
        start = state["at"] + F.length(x["role"]) + len(OPEN) + len(MIDDLE)
        end = start + F.length(x["text"])
        spans = F.when(x["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, begin, step, lambda s: s["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask); inputs: pair_id, turn, role, text."""
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["_pair", "_turn"], "full")
    fork = F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("_turn")))
    numbered = lambda name: F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("_turn", F.col(name).alias("t")))))
    pairs = both.groupBy("_pair").agg(fork.alias("_fork"), numbered("c").alias("c"), numbered("r").alias("r"))

    def turns(name: str, test) -> Column:
        return F.flatten(F.transform(F.filter(name, test), lambda x: x["t"]))

    cut = pairs.select(
        "_pair",
        turns("c", lambda x: F.col("_fork").isNull() | (x["_turn"] < F.col("_fork"))).alias("p"),
        turns("c", lambda x: x["_turn"] >= F.col("_fork")).alias("c"),
        turns("r", lambda x: x["_turn"] >= F.col("_fork")).alias("r"),
    )
    return cut.select(
        F.col("_pair").alias("pair_id"), F.size("p").cast("long").alias("prompt_turns"), _joined(F.col("p")).alias("prompt"),
        _joined(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
    )
