import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reqlens.llm import queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
CASES = [
    "", " ", "Hello, world!  It's we'll I'M you'd 'S '", "naïve café École İstanbul ΣΑΣ ς ǅ", "a b c\x1cd\x85e​f   \n\n x \t",
    "12345 6,789.0", "<|endoftext|>mid<|startoftext|> x<|endoftext|>", "<|ENDOFTEXT|>", "日本語テキスト 한국어 🙂🙃 👩‍👩‍👧", "\x00\x01﻿ a",
    "x" * 3000, "aaaa" * 501, "!!!???...###", "tab\tnl\ncr\r", "ﬁ ½ Ⅷ ① ٣", "e  e\x1f\x1f  ", "\xa0\xa0 b",
]


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def own(path):
    with open(path, encoding="utf-8") as f:
        return token_counts.Counter(f.read())


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cases_equal_library(own, library):
    assert own.counts([*CASES, None]).tolist() == expected(library, [*CASES, None])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs", "Cn"]), max_size=60), max_size=4))
def test_any_text_equals_library(own, library, texts):
    assert own.counts(texts).tolist() == expected(library, texts)


def test_long_pretoken_equals_library(own, library):
    r = random.Random(3)
    texts = ["".join(r.choice("abcdehinorst") for _ in range(60_000)), "ab" * 20_000]
    assert own.counts(texts).tolist() == expected(library, texts)


def test_merges_out_of_order_take_the_leftmost_alone():
    """Merging b with c opens the pair (a, bc), whose rank is lower than that of its own part."""
    letters = token_counts.byte_characters()
    merges = [["a", "bc"], ["b", "c"], ["c", "a"]]
    vocab = {c: i for i, c in enumerate([*letters, "bc", "abc", "ca"])}
    merged = token_counts.RankMerges({"model": {"vocab": vocab, "merges": merges}})
    assert not merged.ordered

    def plain(word):
        parts = [chr(b) for b in word]
        while True:
            found = [(merges.index([a, b]), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if [a, b] in merges]
            if not found:
                return len(parts)
            i = min(found)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    r = random.Random(1)
    words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(500)]
    assert merged.counts(words).tolist() == [plain(w) for w in words]


def test_operator(spark, make_docs, path, library):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, "no number"), (3, None), (3, CASES[3]), (99, "word " * 50_000)]
    out = token_counts.token_counts(make_docs(rows, extra=True).withColumn("n_tokens", queries.F.lit("x")), path)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out.collect()) == sorted(
        (i or -1, n) for (i, _), n in zip(rows, expected(library, [t for _, t in rows]), strict=True))
    assert token_counts.token_counts(make_docs(rows).limit(0), path).count() == 0


def test_query_equals_library(spark, library):
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d, n in zip(docs, expected(library, [d.text for d in docs]), strict=True):
        row = got[d.doc_id]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((d.text or "").encode()), n, n > 1024)
    assert np.all([r.n_tokens <= r.n_bytes for r in got.values()])
