import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reqlens.llm import mixing

WEIGHTS = {"domain": {"d0": 1, "d1": 4}, "lang": {"en": 3, "xx": 0}, "source": {"src1": 5}}


def with_domain(df):
    return df.withColumn("domain", F.concat(F.lit("d"), (F.coalesce("doc_id", F.lit(0)) % 3).cast("string")))


def fill(budget, children, weight):
    """Water level by hand: children that hold less than their share are filled first."""
    left, out, rest = dict(children), {}, budget
    for c in list(left):
        if weight(c) == 0:
            out[c] = 0
            del left[c]
    while True:
        total = sum(weight(c) for c in left)
        full = [c for c, cap in left.items() if cap * total <= weight(c) * rest]
        if not full:
            break
        for c in full:
            out[c] = left.pop(c)
        rest = budget - sum(out.values())
    run, total = 0, sum(weight(c) for c in left)
    for c in sorted(left, key=lambda c: (c is not None, c)):
        out[c] = (run + weight(c)) * rest // total - run * rest // total
        run += weight(c)
    return out


@pytest.mark.parametrize("percent, epochs", [(30, 1), (90, 2), (500, 3)])
def test_budgets_and_prefixes_equal_brute_force(spark, make_docs, prose, percent, epochs):
    r = random.Random(5)
    docs = with_domain(make_docs([(k, prose(r.randint(0, 60), k)) for k in range(120)]))
    rows = docs.collect()
    got = {x.doc_id: x for x in mixing.mix(docs, WEIGHTS, percent, epochs, 9).collect()}
    assert len(got) == len(rows)
    leaves = defaultdict(list)
    for x in rows:
        leaves[x.domain, x.lang, x.source].append((x.doc_id, len(x.text.split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda level: lambda c: WEIGHTS[level].get(c, 1)
    held = lambda *at: sum(n * epochs for k, n in tokens.items() if k[: len(at)] == at)
    budget = {}
    for d, b in fill(sum(tokens.values()) * percent // 100, {d: held(d) for d, _, _ in tokens}, weight("domain")).items():
        for lang, b2 in fill(b, {x: held(d, x) for k, x, _ in tokens if k == d}, weight("lang")).items():
            for s, b3 in fill(b2, {y: held(d, lang, y) for k, x, y in tokens if (k, x) == (d, lang)}, weight("source")).items():
                budget[d, lang, s] = b3
    for leaf, members in leaves.items():
        whole, rest = divmod(budget[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        for i, n in sorted(members, key=lambda m: (hashlib.md5(f"9:{whole}:{m[0]}".encode()).hexdigest(), m[0])):
            part = min(n, rest)
            rest -= part
            assert (got[i].n_tokens, got[i].epochs, got[i].part_tokens) == (n, whole, part)
    assert all(x.epochs * x.n_tokens + x.part_tokens <= epochs * x.n_tokens for x in got.values())


def test_taken_rows_are_prefixes(spark, make_docs, prose):
    docs = with_domain(make_docs([(k, "  " + prose(20, k)) for k in range(30)], extra=True))
    plan = mixing.mix(docs, WEIGHTS, 130, 3, 4)
    text = {x.doc_id: x.text for x in docs.collect()}
    want = {x.doc_id: x.epochs * x.n_tokens + x.part_tokens for x in plan.collect()}
    got = defaultdict(int)
    for x in mixing.taken_rows(docs, plan).collect():
        assert text[x.doc_id].startswith(x.text)
        got[x.doc_id] += len(x.text.split())
    assert got == {i: n for i, n in want.items() if n}


def test_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c d e"), (4, "w " * 50_000)]
    docs = with_domain(make_docs(rows, extra=True)).withColumn("lang", F.lit(None).cast("string"))
    got = mixing.mix(docs, WEIGHTS, 100, 1, 1).collect()
    assert len(got) == len(rows) and all(x.epochs == 0 and x.part_tokens == 0 for x in got if x.n_tokens == 0)
    assert sum(x.epochs * x.n_tokens + x.part_tokens for x in got) == 50_007
    assert mixing.mix(docs.limit(0), WEIGHTS, 100).collect() == []
