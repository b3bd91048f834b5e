"""Mixing sources to target weights by budgets that run down a tree of domain, language and source.

A node's budget is split among its children by weight. A child that holds less than its share gives what it lacks to
its siblings, by weight, and only what all of them together cannot hold is missing at the parent, whose own siblings
take it. Capacities are summed from the leaves, so filling every level from the top does exactly that. Whole tokens
are dealt out by running sums, so the children's budgets add up.

A leaf's budget is spent on seeded epochs: whole passes over its documents, then a prefix of tokens of one more
pass, whose order is the digest of seed, epoch and document. The prefix is found from sums of digest ranges, then of
finer ranges in the range of the cut; only documents of the last range are put in order.

Null keys are values of their own. Null and empty texts have no tokens and are never taken. Children of weight 0 get
nothing. A leaf without tokens gets nothing. Rows that share a doc_id are ordered by a hash of their texts and taken
each by its own plan; rows with the same text too are alike, so it does not matter which of them is cut. A null doc_id
is a number like any other. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.llm.common import WORD, identity, join_same, renamed, text_key
from reqlens.session import cut_lineage

#: Hexadecimal digits of a digest range at each level.
DIGITS, LEVELS = 3, 2
LEVEL_NAMES = ["domain", "lang", "source"]


def word_tokens(text: Column) -> Column:
    """Number of words, the measure of the budgets."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """Weight of a key; 1 if none is given."""
    out = F
    for key, weight in weights.get(level, {}).items():
        out = out.when(F.col(level) == key, F.lit(weight))
    return (F.lit(1) if out is F else out.otherwise(F.lit(1))).cast("decimal(38,0)")


def fill_level(nodes: DataFrame, parents: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Budgets of the children; nodes: parents, level, capacity, parent_budget (the same for all siblings)."""
    whole = "decimal(38,0)"
    rows = nodes.withColumn("_w", _weight(level, weights)).withColumn("_c", F.when(F.col("_w") > 0, F.col("capacity")).otherwise(0).cast(whole))
    rows = rows.withColumn("_b", F.col("parent_budget").cast(whole))
    family = Window.partitionBy(*parents)
    full = family.orderBy(F.when(F.col("_w") > 0, F.col("_c").cast("double") / F.col("_w").cast("double")).asc_nulls_last(), level)
    rows = rows.withColumn("_held", F.coalesce(F.sum("_c").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(whole))
    rows = rows.withColumn("_left", F.sum("_w").over(full.rowsBetween(0, Window.unboundedFollowing)).cast(whole))
    rows = rows.withColumn("_full", (F.col("_w") == 0) | (
        (F.col("_c") * F.col("_left")).cast(whole) <= (F.col("_w") * (F.col("_b") - F.col("_held"))).cast(whole)))
    rows = rows.withColumn("_u", F.when(F.col("_full"), 0).otherwise(F.col("_w")).cast(whole))
    rows = rows.withColumn("_rest", (F.col("_b") - F.sum(F.when(F.col("_full"), F.col("_c")).otherwise(0)).over(family)).cast(whole))
    rows = rows.withColumn("_all", F.sum("_u").over(family).cast(whole))
    rows = rows.withColumn("_run", F.sum("_u").over(family.orderBy(level).rowsBetween(Window.unboundedPreceding, 0)).cast(whole))
    share = F.expr("cast(_run * _rest as decimal(38,0)) div _all - cast((_run - _u) * _rest as decimal(38,0)) div _all")
    budget = F.when(F.col("_full"), F.col("_c").cast("long")).otherwise(share.cast("long"))
    return rows.withColumn("budget", budget).select(*parents, level, "capacity", "budget")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int) -> DataFrame:
    """Budget in tokens of every leaf; leaves: domain, lang, source, tokens. The root gets percent of all tokens."""
    base = leaves.withColumn("capacity", F.col("tokens") * epochs)
    root = leaves.agg(F.expr(f"coalesce(cast(sum(tokens) as decimal(38,0)) * {percent} div 100, 0)").cast("long").alias("parent_budget"))
    done: list[str] = []
    known = root
    for level in LEVEL_NAMES:
        nodes = base.groupBy(*done, level).agg(F.sum("capacity").alias("capacity"))
        if done:
            nodes = join_same(nodes, known, done)
        else:
            nodes = nodes.crossJoin(F.broadcast(root))  # one row
        filled = fill_level(nodes, done, level, weights)
        done.append(level)
        known = filled.select(*done, F.col("budget").alias("parent_budget"))
    return known.withColumnRenamed("parent_budget", "budget")


def _digest(seed: int, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), ident.cast("string")))


def mix(
    df: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int = 2, seed: int = 1,
    doc: str = "doc_id", text: str = "text", keys: dict[str, str] | None = None,
) -> DataFrame:
    """(doc_id, text_key, domain, lang, source, n_tokens, epochs, part_tokens) of every row.

    A row is taken whole ``epochs`` times and once more with its first ``part_tokens`` tokens.
    """
    keys = keys or {k: k for k in LEVEL_NAMES}
    rows = renamed(df, {doc: "_doc", text: "_text", **{v: k for k, v in keys.items()}})
    rows = rows.select("_doc", identity("_doc", "_text").alias("_id"), text_key("_text").alias("text_key"), *LEVEL_NAMES, word_tokens(F.col("_text")).alias("n_tokens"))
    rows = cut_lineage(rows, "tokens")
    leaves = rows.groupBy(*LEVEL_NAMES).agg(F.sum("n_tokens").alias("tokens"))
    leaves = cut_lineage(leaves, "leaves")
    plan = budgets(leaves, weights, percent, epochs)
    plan = join_same(leaves, plan, LEVEL_NAMES).select(
        *LEVEL_NAMES, "tokens", "budget",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("epochs"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("leaf", F.monotonically_increasing_id())
    plan = cut_lineage(plan, "budgets")
    dealt = join_same(rows, plan, LEVEL_NAMES).drop("tokens", "budget")
    dealt = dealt.withColumn("_digest", _digest(seed, F.col("epochs"), F.col("_id")))
    names = [f"_range{k}" for k in range(LEVELS)]
    for k, name in enumerate(names):
        dealt = dealt.withColumn(name, F.substring("_digest", 1 + k * DIGITS, DIGITS))
    dealt = cut_lineage(dealt, "dealt")
    open_rows, done = dealt, None
    columns = ["_doc", "text_key", *LEVEL_NAMES, "n_tokens", "epochs"]
    for k in range(LEVELS):
        at = ["leaf", *names[:k]]
        sums = open_rows.groupBy(*at, names[k]).agg(F.sum("n_tokens").alias("_sum"), F.first("rest").alias("_rest"))
        before = F.sum("_sum").over(Window.partitionBy(*at).orderBy(names[k]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
        sums = sums.withColumn("_before", before).withColumn(
            "_verdict", F.when(F.col("_before") + F.col("_sum") <= F.col("_rest"), 2).when(F.col("_before") < F.col("_rest"), 1).otherwise(0))
        sums = cut_lineage(sums.select(*at, names[k], "_verdict", (F.col("_rest") - F.col("_before")).alias("_next")), "ranges")
        judged = open_rows.join(sums, [*at, names[k]])
        settled = judged.where("_verdict <> 1").select(*columns, F.when(F.col("_verdict") == 2, F.col("n_tokens")).otherwise(0).alias("part_tokens"))
        done = settled if done is None else done.unionByName(settled)
        open_rows = judged.where("_verdict = 1").withColumn("rest", F.col("_next")).drop("_verdict", "_next")
    last = Window.partitionBy("leaf", *names).orderBy("_digest", "_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("n_tokens").over(last) - F.col("n_tokens")
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - before))
    done = done.unionByName(open_rows.withColumn("part_tokens", part).select(*columns, "part_tokens"))
    return done.withColumnRenamed("_doc", "doc_id").withColumn("part_tokens", F.col("part_tokens").cast("long"))


def prefix_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, with the white space before it."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, n.cast("int")), "")


def taken_rows(df: DataFrame, plan: DataFrame, doc: str = "doc_id", text: str = "text", keys: dict[str, str] | None = None) -> DataFrame:
    """The mixed rows of ``df``: a row for each epoch that takes it, the last one cut to its prefix.

    Plans and rows meet by number, text and the leaf's columns that ``df`` has, null equal to null. Of rows alike in
    these one stands for all, with as many copies as they are taken together; at most one of them is cut.
    """
    keys = keys or {k: k for k in LEVEL_NAMES}
    leaf = [k for k in LEVEL_NAMES if keys[k] in df.columns]
    took = plan.where("n_tokens > 0")
    cut = (F.col("part_tokens") > 0) & (F.col("part_tokens") < F.col("n_tokens"))
    took = took.groupBy(F.col("doc_id").alias("_k_doc"), F.col("text_key").alias("_k_text"), *[F.col(k).alias(f"_k_{k}") for k in leaf]).agg(
        F.count(F.lit(1)).alias("_copies"), F.sum(F.col("epochs") + F.when(F.col("part_tokens") == F.col("n_tokens"), 1).otherwise(0)).alias("_whole"),
        F.max(F.when(cut, F.col("part_tokens"))).alias("_cut")).where("_whole > 0 or _cut is not null")
    names = ["_k_doc", "_k_text", *[f"_k_{k}" for k in leaf]]
    own = df.withColumns({"_k_doc": F.col(doc), "_k_text": text_key(text), **{f"_k_{k}": F.col(keys[k]) for k in leaf}})
    joined = join_same(own, took, names)
    one = joined.where("_copies = 1").unionByName(joined.where("_copies > 1").dropDuplicates(names))
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("_whole").cast("int"))
    last = F.when(F.col("_cut").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("_cut"))
    out = one.withColumn("_take", F.explode(F.concat(whole, last)))
    shown = F.when(F.col("_take") < 0, F.col(text)).otherwise(prefix_words(F.col(text), F.col("_take")))
    return out.withColumn(text, shown).select(df.columns)
