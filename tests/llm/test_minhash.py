import re
from collections import Counter

import numpy as np

from reqlens.llm import minhash_dedup as m
from reqlens.llm.common import WORD


def bag(text):
    words = re.findall(WORD, text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_groups(rows, least=0.8):
    ids, bags = [i for i, _ in rows], [bag(t) for _, t in rows]
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = {}
    for k, b in enumerate(bags):
        for s in b:
            holders.setdefault(s, []).append(k)
    for x, y in {(p, q) for h in holders.values() for p in h for q in h if p < q}:
        if similarity(bags[x], bags[y]) >= least:
            a, b = find(ids[x]), find(ids[y])
            group[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(3):
        pool = rng.integers(0, 2**64, 60, dtype=np.uint64)
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sets = [(pool[c > 0], c[c > 0]) for c in (a, b)]
        marks = m.bag_minhash(sets, 6000)
        assert abs((marks[0] == marks[1]).mean() - true) < 0.03


def test_groups_equal_brute_force(spark, make_docs, prose):
    import random
    r = random.Random(1)
    rows = []
    for k in range(40):
        base = prose(r.randint(3, 400), k).split(" ")
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randint(0, 6)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = "edit%d" % r.randrange(1000)
            rows.append((len(rows), " ".join(words)))
    r.shuffle(rows)
    want = brute_groups(rows)
    got = {x.doc_id: (x.component_id, x.kept) for x in m.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: (g, i == g) for i, g in want.items()}


def test_crowded_buckets_are_compared_alike(spark, make_docs, prose, monkeypatch):
    import random
    r = random.Random(8)
    monkeypatch.setattr(m, "CHUNK", 7)
    base = prose(120, 99).split(" ")
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = "edit%d" % r.randrange(1000)
        rows.append((k, " ".join(words)))
    r.shuffle(rows)
    want = brute_groups(rows)
    assert {x.doc_id: x.component_id for x in m.near_duplicates(make_docs(rows)).collect()} == want


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [(np.arange(30, dtype=np.uint64)[c > 0], c[c > 0]) for c in rng.integers(0, 4, (9, 30))]
    full = np.array([[sum(min(dict(zip(*a, strict=True)).get(e, 0), c) for e, c in zip(*b, strict=True)) for b in sets] for a in sets])
    np.fill_diagonal(full, 0)
    got = m.overlaps(sets)
    np.fill_diagonal(got, 0)
    assert (got == full).all()


def test_edges(spark, make_docs):
    rows = [(4, None), (3, ""), (2, " \n"), (9, "one two"), (7, "one two"), (8, "one  two\n"), (None, "one two"), (5, "x " * 30_000), (6, "x " * 30_000), (6, "x " * 30_000)]
    out = m.near_duplicates(make_docs(rows, extra=True)).collect()
    assert len(out) == len(rows)
    by = {}
    for x in out:
        by.setdefault(x.doc_id, set()).add((x.component_id, x.kept))
    smallest = next(c for c, k in by[None])
    assert smallest < 0 and by[None] == {(smallest, True)}
    assert by[7] == by[8] == by[9] == {(smallest, False)}
    assert by[4] == {(4, True)} and by[3] == {(3, True)} and by[2] == {(2, True)}
    assert by[5] == {(5, True)} and by[6] == {(5, False)}
    assert m.near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from reqlens.llm.queries import op3_bagminhash_dedup
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_groups(rows)
    got = {x.doc_id: x.component_id for x in op3_bagminhash_dedup(spark, sf).collect()}
    assert got == want
