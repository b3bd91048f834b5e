import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reqlens.llm import bpe
from reqlens.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
CASES = [
    "", " ", "Hello, world!", "It's we'll I'M you'd 'S '", "naïve café École İstanbul ΣΑΣ ς ǅ", "a b c\x1cd\x85e​f",
    "12345 6,789.0", "<|endoftext|>mid<|startoftext|> x<|endoftext|>", "<|ENDOFTEXT|>", "日本語テキスト 한국어 🙂🙃 👩‍👩‍👧", "\x00\x01﻿", "x" * 3000,
    "!!!???...###", "tab\tnl\ncr\r", "ﬁ ½ Ⅷ ① ٣",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    with open(vocabulary(), encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def check(own, library, text):
    ids = list(own.encode(text))
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert " ".join(own.tokens[i] for i in ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_cases_equal_library(own, library, text):
    check(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs", "Cn"]), max_size=60))
def test_any_text_equals_library(text):
    global _own, _library
    if "_own" not in globals():
        with open(vocabulary(), encoding="utf-8") as f:
            _own = bpe.WordBpe(f.read())
        _library = tokenizers.Tokenizer.from_file(vocabulary())
    check(_own, _library, text)


def plain_merge(ids, ranks):
    ids = list(ids)
    while True:
        pairs = [a << bpe.PAIR | b for a, b in zip(ids, ids[1:], strict=False)]
        found = [(ranks[p][0], i) for i, p in enumerate(pairs) if p in ranks]
        if not found:
            return ids
        i = min(found)[1]
        ids[i : i + 2] = [ranks[pairs[i]][1]]


def test_tree_equals_repeated_scans(own):
    r = random.Random(5)
    for _ in range(200):
        ids = [own.vocab[r.choice("abcehinorst")] for _ in range(r.randint(1, 60))]
        assert bpe.merge_word(ids, own.ranks) == plain_merge(ids, own.ranks)


def test_columns_nulls_and_round_trip(spark, make_docs, library):
    rows = [(1, None), (2, ""), (3, "Some text, twice."), (3, "Some text, twice."), (None, "z " * 5000), (5, "<|endoftext|>")]
    out = bpe.decode(bpe.encode(make_docs(rows, extra=True), vocabulary()), vocabulary())
    assert "rank" in out.columns
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(make_docs(rows).limit(0), vocabulary()).count() == 0


def test_unknown_ids_are_left_out(spark):
    df = spark.createDataFrame([([320, -1, 999_999, 321],), (None,), ([],)], "ids array<int>")
    with open(vocabulary(), encoding="utf-8") as f:
        tokens = bpe.WordBpe(f.read()).tokens
    assert sorted(r.decoded for r in bpe.decode(df, vocabulary()).collect()) == ["", "", f"{tokens[320]} {tokens[321]}"]


def test_query_equals_library(spark, library):
    import hashlib

    from reqlens.llm.queries import op9_segment_tree_bpe
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_segment_tree_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, back)


def test_words_side_by_side_equal_single_trees(own):
    r = random.Random(6)
    words = ["".join(r.choice("abcehinorstéß") for _ in range(r.choice([1, 2, 3, 5, 8, 9, 17, 40, 70]))) for _ in range(800)]
    for word, ids in zip(words, own.merged(words), strict=True):
        raw = word.encode()
        symbols = own.symbols[[0] * (len(raw) - 1) + [1], list(raw)].tolist()
        assert list(ids) == bpe.merge_word(symbols, own.ranks) == plain_merge(symbols, own.ranks)
    assert own.merged([]) == []


def test_special_strings_in_other_case_are_words(own, library):
    texts = ["<|ENDOFTEXT|> a", "<|endoftext|><|endoftext|>", "a<|startoftext|>b", None, "", "long" * 200, "<|endoftext|>"]
    got = [list(x) for x in own.encode_all(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
