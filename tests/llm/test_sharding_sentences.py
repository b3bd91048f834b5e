import itertools
import re
from collections import defaultdict

import numpy as np

from reqlens.llm import sharding
from reqlens.llm.sentence_dedup import remove_repeated_spans


def test_curve_visits_every_cell_in_steps_of_one():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = sharding.hilbert_distance(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_runs_of_the_curve(spark):
    rows = [(k % 13, None if k % 5 == 0 else k * k % 64, k % 7) for k in range(205)] + [(1, 1, 1)] * 90
    df = spark.createDataFrame(rows, "a int, b int, id long").fillna(0).repartition(5)
    got = sharding.hilbert_shards(df, ["a", "b"], ["id"]).collect()
    shards = defaultdict(list)
    for x in got:
        shards[x.shard].append((x.slot, x.hilbert_index, x.id))
    assert sorted(shards) == list(range(24)) and {len(v) for v in shards.values()} <= {12, 13}
    assert all([s for s, _, _ in sorted(v)] == list(range(len(v))) for v in shards.values())
    run = [x[1:] for s in range(24) for x in sorted(shards[s])]
    assert run == sorted(run)
    assert sharding.hilbert_shards(df.limit(0), ["a", "b"], ["id"]).collect() == []


def cut(text):
    return re.sub(r"([.!?])([ \t-\r])", "\\1\x01\\2", text or "").replace("\n", "\n\x01").split("\x01")


def brute_spans(rows, span=3):
    seen, gone = {}, defaultdict(set)
    for i, text in sorted(rows, key=lambda r: r[0]):
        s = [p.strip(" \t\n\x0b\x0c\r") for p in cut(text)]
        s = [p for p in s if p]
        for k in range(len(s) - span + 1):
            if tuple(s[k : k + span]) in seen:
                gone[i] |= set(range(k, k + span))
            seen.setdefault(tuple(s[k : k + span]), (i, k))
    out = {}
    for i, text in rows:
        k, left, n = 0, [], 0
        for p in cut(text):
            blank = not p.strip(" \t\n\x0b\x0c\r")
            if blank or k not in gone[i]:
                left.append(p)
            n += not blank
            k += not blank
        out[i] = (n, len(gone[i]), "".join(left))
    return out


def test_spans_equal_brute_force(spark, make_docs, prose):
    shared = prose(80, 1)
    rows = [(k, prose(30, 100 + k) + "\n" + (shared if k % 2 else "") + " " + prose(30, 200 + k % 4)) for k in range(30)]
    rows += [(40, "One. Two. Three. One. Two. Three. One. Two. Three."), (41, "A.  B!\n\nC?\tD."), (42, "A. B! C? D. E.")]
    got = {x.doc_id: (x.n_sentences, x.n_removed, x.text) for x in remove_repeated_spans(make_docs(rows, extra=True)).collect()}
    assert got == brute_spans(rows)


def test_span_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One. Two."), (5, "One. Two."), (6, "Long one. " * 20_000)]
    got = {x.doc_id: (x.n_sentences, x.n_removed) for x in remove_repeated_spans(make_docs(rows)).collect()}
    # the first span of three stays, so its sentences are removed only where a later span covers them
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (2, 0), 5: (2, 0), 6: (20_000, 19_999)}
    assert remove_repeated_spans(make_docs(rows).limit(0)).collect() == []


def brute_runs(rows, span, least, within):
    """All runs by trying every start and end; the first document keeps a run."""
    texts = {}
    for i, text in rows:
        s = [" ".join(p.split()) for p in re.split(r"(?<=[.!?])(?=[ \t-\r])|(?<=\n)", text or "")]
        texts[i] = [p for p in s if p]
    size = lambda s: len(s) >= span and sum(len(p.split()) for p in s) >= least
    found = {}
    for i, s in texts.items():
        every = [(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if size(s[a:b])]
        found[i] = [(a, b) for a, b in every if (a, b - 1) not in every or (a + 1, b) not in every]
    first = {}
    for i in sorted(found):
        for a, b in found[i]:
            first.setdefault(tuple(texts[i][a:b]), i)
    out = {}
    for i, s in texts.items():
        gone, seen = set(), set()
        for a, b in sorted(found[i]):
            run = tuple(s[a:b])
            if first[run] != i or (within and run in seen):
                gone |= set(range(a, b))
            seen.add(run)
        out[i] = (len(s), len(gone))
    return out


def test_runs_of_least_words_equal_brute_force(spark, make_docs):
    r = np.random.default_rng(4)
    pool = [" ".join(r.choice(list("abcdefgh"), r.integers(1, 7))) + r.choice([".", "!", "?"]) for _ in range(14)]
    rows = [(k, r.choice([" ", "\n", "  "]).join(r.choice(pool, r.integers(0, 12)))) for k in range(60)]
    for span, least, within in ((2, 6, False), (2, 9, True), (1, 5, False), (3, 0, False)):
        got = {x.doc_id: (x.n_sentences, x.n_removed) for x in remove_repeated_spans(
            make_docs(rows, extra=True), span, least_words=least, within=within).collect()}
        assert got == brute_runs(rows, span, least, within)


def test_shared_passage_goes_and_other_sentences_stay(spark, make_docs, prose):
    passage = "Here is one that many texts hold, word for word. It has a second sentence of some length. And then it ends."
    rows = [(k, f"{prose(40, 300 + k)} w{k} so it begins {passage} {prose(40, 400 + k)}") for k in range(1, 20)]
    rows += [(50, f"Refrain of one text only, sung again and again. {prose(9, 7)}. " * 4), (None, passage), (60, "A sentence. " + "Long sentence of a long text. " * 20_000)]
    got = {x.doc_id: x for x in remove_repeated_spans(make_docs(rows), 2, least_words=10, within=False).collect()}
    assert all("second sentence of some length" not in got[k].text for k in range(1, 20))
    assert got[None].n_removed == 0 and got[50].n_removed == 0 and got[60].n_removed == 0
    assert all(got[k].n_removed == 2 and got[k].text.startswith(prose(40, 300 + k)) for k in range(1, 20))


def test_rows_of_one_number_are_cut_by_their_own_texts(spark, make_docs):
    rows = [(1, "One two. Three four. Five."), (2, "One two. Three four. Five."), (2, "X. One two. Three four. Y."), (2, "X. One two. Three four. Y.")]
    got = sorted((x.doc_id, x.n_removed, x.text) for x in remove_repeated_spans(make_docs(rows), 2, least_words=4, within=False).collect())
    assert got == [(1, 0, "One two. Three four. Five."), (2, 2, "X. Y."), (2, 2, "X. Y."), (2, 3, "")]
