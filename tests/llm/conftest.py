import random

import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark, docs_schema):
    """Documents from (doc_id, text) pairs, in several partitions."""

    def make(rows, extra=False):
        full = [(i, t, "en" if (i or 0) % 3 else "de", f"src{(i or 0) % 4}", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, docs_schema).repartition(3)
        if extra:
            for name in ("_id", "_text", "rank", "shard", "ids", "h", "n", "component_id", "kept", "text_b", "words"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Reproducible sentences of made-up words."""

    def make(n_words, seed):
        r = random.Random(seed)
        words = ["".join(r.choice("aeioubcdrst") for _ in range(r.randint(1, 8))) for _ in range(n_words)]
        out = []
        for k, w in enumerate(words):
            out.append(w + (". " if r.random() < 0.15 else "\n" if r.random() < 0.03 else " "))
        return "".join(out)

    return make
