import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from reqlens.llm import collocations, common, queries


def brute(docs, least, longest, top):
    """Straight counts of all phrases; docs: (language, text)."""
    out = []
    for lang in {d[0] or "und" for d in docs}:
        f, n = Counter(), 0
        for own, text in docs:
            if (own or "und") != lang:
                continue
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in candidates.items()):
                continue
            score, cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, longest, top", [(2, 5, 1000), (3, 3, 7), (1, 5, 40), (5, 2, 3)])
def test_equals_brute_force(spark, least, longest, top):
    r = random.Random(least)
    words = ["a", "B", "b", "zu", "Été", "été", "x1", "the", "\x01", "q\xa0r", "the\x1cof"]
    docs = []
    for i in range(60):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "?!"]) for _ in range(r.randint(0, 60)))
        docs.append((r.choice(["en", "de", None, "und"]), text))
    docs += [("en", None), ("en", ""), ("fr", ". , "), ("es", "solo"), ("en", docs[0][1]), ("en", "the zu the zu " * 400)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, n long, phrase string").repartition(4)
    got = sorted(tuple(x) for x in collocations.collocations(df, least, longest, top).collect())
    assert got == brute(docs, least, longest, top)


def test_empty_table(spark, make_docs):
    assert collocations.collocations(make_docs([(1, "a b")]).limit(0)).collect() == []


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """A map in which every pair hits keeps the edges whole; counts are the same."""
    docs = [("en", "one two three. four five " * 3 + "six"), ("en", "two three four")] * 2
    df = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(collocations, "_bitmap", lambda pairs, least: np.full(common.MAP_BITS // 64, -1))
    assert sorted(tuple(x) for x in collocations.collocations(df, 4, 5, 50).collect()) == brute(docs, 4, 5, 50)


def test_counts_past_32_bits_stay_exact(spark):
    """a n and l r beyond 64 bits; the flow of the edges is given."""
    big = 3_000_000_000_000
    edges = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 7), ("en", "b", 1, big + 11)], "lang string, gram string, k int, c long")
    counts = {r.gram: r.c for r in collocations.phrase_counts(edges, 5, 100).collect()}
    assert counts == {"a b": big, "a": big + 7, "b": big + 11}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in queries.op13_collocations(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got and got == sorted(con.execute(queries.SQL["op13_collocations"]).fetchall())
