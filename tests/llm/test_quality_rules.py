import random
import re
from collections import Counter

import numpy as np

from reqlens.llm import cotraining, outliers


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def base(df):
    return {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)
            for x in outliers.base_statistics(df).collect()}


def test_base_statistics_equal_brute_force(spark, make_docs, prose):
    rows = [(k, prose(10 + k, k) + "\n" + prose(9, k % 3) + "# | <b>\n" + prose(12, k) * (k % 3)) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\x0b\n"), (103, "a " * 20_000), (104, "é ü x\n\nx\nx"), (105, "one\r\none\r\n")]
    assert base(make_docs(rows, extra=True)) == {i: brute_base(t) for i, t in rows}


def test_outliers_are_rejected_and_the_rest_stays(spark, make_docs, prose):
    rows = [(k, prose(60 + k % 80, k)) for k in range(900)]
    odd = {k: prose(60, k).replace(" ", " ##|| ").upper() for k in range(900, 912)}
    rows += list(odd.items()) + [(2000, None), (2001, ""), (2002, "short")]
    got = {x.doc_id: x for x in outliers.outliers(outliers.base_statistics(make_docs(rows)).drop("text")).collect()}
    assert len(got) == len(rows)
    assert not any(got[k].kept for k in odd)
    assert not any(got[k].kept or not got[k].base_failed for k in (2000, 2001, 2002))
    plain = [k for k in range(900) if not got[k].base_failed]
    assert np.mean([got[k].kept for k in plain]) > 0.99


def test_outliers_of_small_and_empty_tables(spark, make_docs, prose):
    docs = make_docs([(1, prose(40, 1)), (1, prose(40, 1)), (None, prose(50, 2)), (3, None)])
    got = outliers.outliers(outliers.base_statistics(docs)).collect()
    assert len(got) == 4 and sum(x.kept for x in got) == 3
    assert outliers.outliers(outliers.base_statistics(docs.limit(0))).collect() == []


def test_chi_square_quantile():
    assert abs(outliers.chi_square_quantile(0.05, 6) - 12.5916) < 1e-3


def test_held_out_accuracy(spark, make_docs, prose):
    r = random.Random(2)
    good = {k: r.random() < 0.6 for k in range(600)}
    rows = [(k, prose(50, k) if g else prose(50, k).replace(" ", r.choice([" buy!! ", " $$ win "]))) for k, g in good.items()]
    labels = spark.createDataFrame([(k, int(g)) for k, g in good.items() if k % 3] + [(None, 1), (5_000, 0), (0, None)], "doc_id long, quality int")
    got = cotraining.classify(make_docs(rows + [(700, None), (None, "x " * 30_000)], extra=True), labels).collect()
    assert len(got) == 602 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id in good and x.doc_id % 3 == 0]
    assert np.mean([x.kept == good[x.doc_id] for x in held]) > 0.97


def test_one_class_and_no_labels(spark, make_docs, prose):
    docs = make_docs([(k, prose(5, k)) for k in range(6)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(x.kept for x in cotraining.classify(docs, none).collect())
    bad = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int")
    assert not any(x.kept for x in cotraining.classify(docs, bad).collect())
    assert cotraining.classify(docs.limit(0), bad).collect() == []
