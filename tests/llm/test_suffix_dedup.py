import hashlib
import random

import numpy as np

from reqlens.llm import suffix_dedup as sd


def brute(rows, length=50):
    """(n_bytes, n_removed, n_spans, digest) of each row, by a table of the first owner of every string."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, raw in raws:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted(
        (r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed) // 2, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def planted(seed, n=60, alphabet="ab cé"):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 6))]
        rows.append((i * 7 % n + 1000, " ".join(parts)))
    rows += [(5, rows[3][1]), (9000, rows[3][1]), (9001, "a" * 500), (9002, "a" * 300), (9003, "ab" * 200), (2, "x" * 49), (3, "x" * 49), (4, "y" * 50), (6, "y" * 50)]
    return rows


def test_window_names_depend_on_the_window_only():
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 400).astype(np.uint8)
    names = sd.window_names(data)
    assert len(names) == 351
    for p in (0, 7, 350):
        assert sd.window_names(data[p : p + 50])[0] == names[p]


def test_merged_transforms_find_all_repeats():
    r = random.Random(2)
    sd_bytes, sd.SHARD_BYTES = sd.SHARD_BYTES, 300
    try:
        base = bytes(r.choice(b"abc") for _ in range(400))
        pieces = []
        for _ in range(40):
            a = r.randrange(300)
            pieces.append(base[a : a + r.randint(50, 100)] if r.random() < 0.7 else bytes(r.choice(b"ab") for _ in range(70)))
        pieces += [b"a" * 80, b"a" * 50]
        pieces = list(dict.fromkeys(pieces))
        owners = np.array([r.randrange(1000) for _ in pieces])
        want = {}
        for p, o in zip(pieces, owners, strict=True):
            for k in range(len(p) - 49):
                want[p[k : k + 50]] = min(want.get(p[k : k + 50], 10**9), o)
        for p, runs in zip(pieces, sd.least_owner(pieces, owners), strict=True):
            got = [o for n, o in runs for _ in range(n)]
            assert got == [want[p[k : k + 50]] for k in range(len(p) - 49)]
    finally:
        sd.SHARD_BYTES = sd_bytes


def test_equals_brute_force(spark, make_docs):
    for seed in (1, 2):
        rows = planted(seed)
        assert digests(sd.repeated_bytes(make_docs(rows))) == brute(rows)


def test_edges(spark, make_docs):
    text = "some words that are long enough to be one string of fifty bytes or more"
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (7, "z " + text), (8, "q" * 200_000)]
    out = {r.doc_id: r for r in sd.repeated_bytes(make_docs(rows, extra=True)).collect()}
    assert len(sd.repeated_bytes(make_docs(rows, extra=True)).collect()) == len(rows)
    assert out[None].kept.decode() == text and out[3].kept == b"" and out[7].kept == b"z " and out[1].n_bytes == 0
    assert out[8].kept == b"q" * 200_000
    assert sd.repeated_bytes(make_docs(rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from reqlens.llm.queries import op5_merged_bwt_dedup
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_merged_bwt_dedup(spark, sf).collect())
    assert got == brute(rows)
