import math
import random

from reqlens.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        n = math.sqrt(sum(float(x) ** 2 for x in v))
        return [float(x) / n for x in v]

    units = {i: (label, unit(v)) for i, v, label in rows}
    links = {i: set() for i in units}
    for a, (la, ua) in units.items():
        for b, (lb, ub) in units.items():
            if a < b and la is not None and la == lb and ua and ub and len(ua) == len(ub) and sum(x * y for x, y in zip(ua, ub, strict=True)) >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in sorted(units):
        if i in out:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in out:
                out[k] = (len(links[k]), i, k == i)
                todo += links[k]
    return out


def vectors(seed, dims=16, n=150):
    import numpy as np
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 5)):
            v = (base + rng.standard_normal(dims) * rng.choice([0, 0.05, 0.2, 0.28, 0.35])).astype("float32") * np.float32(rng.choice([1, 3]))
            rows.append((len(rows), [float(x) for x in v], int(i % 3) if i % 10 else None))
    random.Random(seed).shuffle(rows)
    return rows


def result(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_vectors(df, **options).collect()}


def test_equals_brute_force(spark):
    rows = vectors(1) + vectors(2, dims=3, n=40)
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(df) == brute(rows)


def test_crowded_cells_are_cut_alike(spark, monkeypatch):
    monkeypatch.setattr(ed, "GROUP", 12)
    rows = [(k, v, 1) for k, (_, v, _) in enumerate(vectors(5, dims=6, n=40))]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0], 1), (12, [-1.0, 0.0], 1), (13, [1e-30, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as n", "'x' as cell")
    assert result(df) == brute(rows)
    assert ed.near_vectors(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from reqlens.llm.queries import op2_subspace_pigeonhole
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op2_subspace_pigeonhole(spark, sf).collect()}
    assert got == brute(rows)
