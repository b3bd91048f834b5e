import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reqlens.llm import periodic_runs, queries


def brute(words, least=12):
    """All runs by comparing every word with the one q further on, for every q."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(s == i and m == length and q % p == 0 for s, m, p in out):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(docs, least):
    words = np.array([w for d in docs for w in d], np.int64)
    return periodic_runs.runs_of(words, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least)


def expected(docs, least):
    out, before = [], 0
    for d in docs:
        out += [(s + before, n, q) for s, n, q in brute(d, least)]
        before += len(d)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=3), st.sampled_from([2, 5, 8, 12, 13]))
def test_any_words_equal_brute_force(docs, least):
    assert found(docs, least) == expected(docs, least)


def test_planted_periods_equal_brute_force():
    r = random.Random(5)
    for _ in range(400):
        n, letters = r.randint(1, 300), r.choice([2, 5, 40, 1000])
        words = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randint(1, 3)):
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(2, 9)
            end = r.randint(a, n)
            words = [words[a + (i - a) % p] if a <= i < end else w for i, w in enumerate(words)]
        assert found([words], 12) == expected([words], 12)


def test_long_texts():
    assert found([[7] * 300_000], 12) == [(0, 300_000, 1)]
    base = list(range(50_000))
    assert found([base + base + base[:9] + [-5 % 99_999]], 12) == [(0, 100_009, 50_000)]


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_operator(spark, make_docs):
    texts = [
        (1, "a b c " * 6 + "d"), (2, None), (3, ""), (4, " \n\t "), (None, "x " * 12), (6, "x " * 11), (7, "é\x1c \x0bé\x1c " * 8),
        (8, "one\xa0two three\xa0four " * 7), (9, "no word here comes twice or does it"), (9, "a b " * 9), (9, "a b " * 9),
    ]
    df = make_docs(texts, extra=True).withColumn("runs", queries.F.lit("mine"))
    out = periodic_runs.periodic_runs(df).collect()
    assert len(out) == len(texts)

    def wanted(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute(words)
        return (len(words), tuple(runs), collapse(words, runs))

    got = sorted((r.doc_id or -1, (r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed)) for r in out)
    assert got == sorted((i or -1, wanted(t)) for i, t in texts)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words) if n <= 3000 else None
        row = got[d.doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 5


def test_planted_period_of_missing_numbers_and_texts(spark, make_docs):
    rows = [(None, "a b c"), (12, None), (12, ""), (12, "  ")]
    out = queries.with_planted_period(make_docs(rows)).collect()
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in out) == [(0, "a b c"), (12, ""), (12, ""), (12, "")]
