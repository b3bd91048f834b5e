"""The whole chain over planted documents, each stage against what brute force gives for its own input."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from reqlens.llm import queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):
    """Good documents of words, bad ones of one repeated mark; copies, near copies, passages, missing numbers."""
    passage = prose(70, 9_000)
    rows = []
    for k in range(60):
        rows.append((k, prose(60, k) + f" unique{k}", "en", "src1", 1))
    for k in range(60, 100):
        rows.append((k, "$ # buy now " * 20 + f"{k}", "de", "src2", 0))
    rows += [(200 + k, rows[k][1], "en", "src1", 1) for k in range(5)]
    rows += [(300 + k, rows[10 + k][1].replace(f"unique{10 + k}", "other"), "en", "src1", 1) for k in range(5)]
    rows += [(400 + k, f"{prose(40, 500 + k)} {passage} {prose(40, 600 + k)}", "en", "src1", 1) for k in range(5)]
    rows += [(None, prose(50, 700), "en", "src1", 1), (None, prose(50, 701), "en", "src1", 1), (500, prose(50, 702), "en", "src1", 1),
             (500, prose(50, 703), "en", "src1", 1), (501, "", "en", "src1", 1), (502, None, "en", "src1", 1), (503, prose(30_000, 704), "en", "src1", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, q, 0) for i, _, _, _, q in rows if i is not None and i < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows after each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder), f"test-{name}")
        out[name] = docs.collect()
    return out


def texts(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_keep_the_columns_of_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name] and set(stages[name][0].asDict()) == set(corpus_pipeline.COLUMNS)


def test_quality_drops_bad_documents_only(stages):
    gone = texts(stages["input"]) - texts(stages["quality"])
    assert {i for i, _ in gone} >= set(range(60, 100))
    assert all(60 <= i < 100 or not t for i, t in gone)
    assert sum(1 for r in stages["quality"] if r.doc_id is None) == 2


def test_one_document_of_each_group_stays(stages):
    def bag(text):
        words = (text or "").split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    rows = stages["quality"]
    order = lambda r: (r.doc_id is not None, r.doc_id or 0)
    kept = []
    for r in sorted(rows, key=order):
        mine = bag(r.text)
        alike = [o for o in kept if mine and o.doc_id != r.doc_id and sum((mine & bag(o.text)).values()) >= 0.8 * sum((mine | bag(o.text)).values())]
        if not alike:
            kept.append(r)
    assert texts(stages["near_dedup"]) == texts(kept)
    assert {200, 300}.isdisjoint(r.doc_id for r in stages["near_dedup"])


def test_repeated_strings_go(stages):
    def cut(rows):
        """Bytes covered by a 50-byte string that starts in a document before."""
        first, out = {}, Counter()
        order = sorted(rows, key=lambda r: r.doc_id)
        for r in order:
            raw = (r.text or "").encode()
            for i in range(len(raw) - 49):
                first.setdefault(raw[i : i + 50], r.doc_id)
        for r in order:
            raw = (r.text or "").encode()
            gone = bytearray(len(raw))
            for i in range(len(raw) - 49):
                if first[raw[i : i + 50]] < r.doc_id:
                    gone[i : i + 50] = b"\1" * 50
            out[r.doc_id, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode()] += 1
        return out

    named = lambda rows: [r for r in rows if r.doc_id is not None]
    assert texts(named(stages["repeated_strings"])) == cut(named(stages["near_dedup"]))
    assert len(stages["repeated_strings"]) == len(stages["near_dedup"])
    assert all(r.n_chars == len(r.text) for r in stages["repeated_strings"])


def test_mixture_takes_every_row_by_its_own_plan(spark, stages, folder):
    from reqlens.llm import mixing

    docs = spark.createDataFrame(stages["repeated_strings"], "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix(queries.with_domain(docs), queries.MIX_WEIGHTS, corpus_pipeline.PERCENT, queries.MIX_EPOCHS, queries.MIX_SEED).collect()
    want = sum(p.epochs * p.n_tokens + p.part_tokens for p in plan)
    assert sum(len(r.text.split()) for r in stages["mixture"]) == want
    whole = Counter({i: n for i, n in Counter(p.doc_id for p in plan if p.n_tokens and p.epochs + p.part_tokens).items()})
    assert {r.doc_id for r in stages["mixture"]} == set(whole)
    assert sum(1 for r in stages["mixture"] if r.doc_id is None) >= 2


def test_mixed_rows_of_one_number_are_their_own(spark, make_docs):
    """Rows without a number, with a shared one, and repeated ones: every token that is planned is taken."""
    from reqlens.llm import mixing

    rows = [(None, "a b c d e"), (None, "f g h"), (7, "i j k l"), (7, "m n"), (8, "o p q"), (8, "o p q"), (9, ""), (9, None)]
    docs = queries.with_domain(make_docs(rows, extra=True))
    for percent, epochs in ((100, 1), (100, 2), (250, 3), (63, 1)):
        plan = mixing.mix(docs, {}, percent, epochs, 3)
        want = Counter()
        for p in plan.collect():
            want[p.doc_id] += p.epochs * p.n_tokens + p.part_tokens
        got = Counter()
        for r in mixing.taken_rows(docs, plan).collect():
            assert any(t and t.startswith(r.text) for i, t in rows if i == r.doc_id)
            got[r.doc_id] += len(r.text.split())
        assert got == +want


def test_encoding_equals_library(stages):
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    want = Counter()
    for r in stages["mixture"]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in stages["encoding"]) == want


def test_run_equals_the_stages(spark, folder, stages):
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in stages["encoding"])


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
