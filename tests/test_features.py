"""Feature columns against a plain statement of the same definitions."""

import math
from collections import Counter
from urllib.parse import parse_qs, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reqlens.functions import features, url
from reqlens.session import spread

TEXT = st.text(alphabet="ab%=&?/#;+ <'\"{\\xu04é😀\n", max_size=60)


def entropy(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXT, TEXT), min_size=20, max_size=60))
def test_payload_statistics(spark, rows):
    rows = [("/" + u.lstrip("/"), b) for u, b in rows]
    df = spark.createDataFrame(rows, "uri string, body string")
    got = df.select("uri", "body", *[c.alias(n) for n, c in features.payload_columns(F.col("uri"), F.col("body")).items()],
                    features.query_param_count(F.col("uri")).alias("params")).collect()
    for r in got:
        both = r.uri + r.body
        assert math.isclose(r.shannon_entropy, entropy(both), abs_tol=1e-9)
        assert math.isclose(r.special_char_ratio, sum(c in "%'\"<>{}" for c in both) / len(both), abs_tol=1e-12)
        assert r.non_printable_count == sum(ord(c) < 32 or ord(c) == 127 for c in both)
        # The standard splitter drops line breaks from a URL; keep to URLs without them.
        if "\n" in r.uri:
            continue
        values = parse_qs(urlsplit(r.uri).query, keep_blank_values=True)
        body = parse_qs(r.body, keep_blank_values=True)
        longest = max([len(v) for vs in [*values.values(), *body.values()] for v in vs], default=0)
        assert r.params == len(values)
        assert r.max_param_value_length == longest


def test_long_text_entropy(spark):
    text = "abc" * 5000 + "😀"
    df = spark.createDataFrame([(text,), ("",), ("aa",)], "t string")
    got = [r[0] for r in df.select(features.shannon_entropy(F.col("t"))).collect()]
    assert [round(x, 9) for x in got] == [round(entropy(text), 9), 0.0, 0.0]


def test_header_features(spark):
    df = spark.createDataFrame(
        [({"Content-Type": "Text/HTML; charset=x"},), ({"content-type": "application/pdf"},), ({"A": "b"},), (None,)],
        "h map<string,string>",
    )
    got = df.select(features.content_type_code(F.col("h")), features.header_count(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(4.0, 1.0), (-1.0, 1.0), (-2.0, 1.0), (-2.0, 0.0)]
    raw = spark.createDataFrame([("Host: a\r\nContent-Type: text/plain; x\r\nbroken",)], "h string")
    assert tuple(raw.select(features.content_type_code_raw(F.col("h")), features.header_count_raw(F.col("h"))).first()) == (3.0, 2.0)


def test_rule_details_zip_truncates_and_last_wins(spark):
    df = spark.createDataFrame(
        [([942100, 1, 942100], ["CRITICAL", "NOTICE", "WARNING"], ["m1"])], "i array<int>, s array<string>, m array<string>"
    )
    d = df.select(features.rule_details(F.col("i"), F.col("s"), F.col("m")).alias("d"))
    assert [tuple(x) for x in d.first().d] == [("942100", "WARNING", "m1"), ("1", "NOTICE", ""), ("942100", "WARNING", "m1")]
    assert d.select(features.severity_weighted_sum(F.col("d"))).first()[0] == 5.0


def test_malformed_escapes_stay(spark):
    df = spark.createDataFrame([("a%zz%4+b%41",)], "t string")
    assert df.select(url.decode(F.col("t"))).first()[0] == "a%zz%4 bA"


def test_uri_depth_edge_cases(spark):
    uris = ["http://h/a//b;x=1?q", "//h/a", "/", "", "//[h/a", "a:b/c"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert [r[0] for r in df.select(features.uri_depth(F.col("u"))).collect()] == [2.0, 1.0, 0.0, 0.0, 0.0, 2.0]


def test_rows_of_one_file_are_dealt_out(spark, tmp_path):
    """A row group is never divided, so a scan's partitions may all be empty but one."""
    path = str(tmp_path / "one.parquet")
    spark.range(0, 40_000, 1, 1).selectExpr("id", "sha2(cast(id as string), 512) as t").write.parquet(path)
    size, cost = (spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in spread(scan, 1_000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sum(sizes) == 40_000 and len(sizes) == 40 and max(sizes) < 1_500
    assert spread(scan.where("id < 3")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_entropy_counts_any_characters(spark):
    texts = ["ab" * 200, "a\u0e3fb" * 200, "\u3fff\u4000" * 200, "\U0001f600x" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.e for r in df.select(features.shannon_entropy(F.col("t")).alias("e")).collect()]
    assert got == pytest.approx([1.0, math.log2(3), 1.0, 1.0])


def test_rule_indicator_takes_numbers_and_nulls(spark):
    df = spark.createDataFrame([([7, None, 8],), ([8],), (None,)], "ids array<int>")
    assert [r.x for r in df.select(features.rule_indicator(F.col("ids"), "7").alias("x")).collect()] == [1.0, 0.0, 0.0]


def test_rule_details_align_by_id(spark):
    rows = [
        (["1", "2"], ["A", "B"], ["m"]), (["1", "1", "2"], ["A", "B"], ["m", "n", "o", "p"]), ([None, "2"], ["A", None], ["m", "n"]),
        ([None, None], ["A", "B"], None), ([], ["A"], []), (None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r array<string>, s array<string>, m array<string>")
    got = df.select("i", features.rule_details(F.col("r"), F.col("s"), F.col("m")).alias("d")).collect()

    def plain(ids, values):
        last = {k: v for k, v in zip(ids or [], values or [], strict=False) if k is not None}
        return [last.get(k) or "" for k in ids or []]

    for g in got:
        ids, severities, messages = rows[g.i]
        assert [(d.rule_id, d.severity, d.message) for d in g.d] == list(zip(ids or [], plain(ids, severities), plain(ids, messages), strict=True))


def test_only_the_side_needed_of_a_pair_is_decoded(spark):
    df = spark.createDataFrame([("/a?x%41=1%42&xA=2&y",)], "uri string")
    shown = df.select(features.query_param_count(F.col("uri")).alias("n"))
    assert shown.first().n == 2
    assert shown._jdf.queryExecution().analyzed().toString().count("url_decode(") <= 1


def test_entropy_of_short_texts_is_the_sum_by_first_appearance(spark):
    """Short texts are counted together; the value is the sum in order of first appearance, to the last bit."""
    texts = [None, "", "a", "abca", "\U0001f600x\U0001f600", "q=%27+or+1", "z" * 256, "ab" * 128, "ab" * 129]
    df = spark.createDataFrame(list(enumerate(texts * 600)), "i int, t string").repartition(2)

    def shares(c):
        return F.transform(F.array_distinct(F.split("t", "")), lambda x: (F.char_length("t") - F.char_length(F.replace(c, x, F.lit("")))) / F.char_length("t"))

    plain = F.when(F.col("t") == "", 0.0).otherwise(F.aggregate(shares(F.col("t")), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))
    got = df.select("t", features.shannon_entropy(F.col("t")).alias("e"), plain.alias("p")).collect()
    assert len(got) == 5400 and all(r.e == r.p for r in got if r.t != "ab" * 129)
    assert {r.e for r in got if r.t == "ab" * 129} == {1.0}


def test_short_texts_are_counted_together():
    counts, sizes = features._short_counts(["", "abca", "", "zz", "\U0001f600x\U0001f600"])
    assert counts.tolist() == [2, 1, 1, 2, 2, 1] and sizes.tolist() == [0, 3, 0, 1, 2]
