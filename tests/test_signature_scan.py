import re

import pytest
from pyspark.sql import functions as F

from reqlens.operators import rules
from reqlens.operators import signature_scan as scan
from reqlens.operators.rules import Signature
from reqlens.operators.signature_scan import guard_of, needed_texts, scan_catalog, scan_signatures
from reqlens.sources.signatures import signatures_of

REQUEST = "request_id int, method string, uri string, body string, headers map<string,string>"

TEXTS = [
    "GET /a?q=UNION  SELECT 1", "/etc/passwd", "<SCRIPT>alert (1)</script>", "x | whoami; rm -rf", "${jndi:ldap://x}", "{{7*7}}",
    "a==b and '==", "' or 1 = 1", "http://169.254.169.254/", "windows\\system32 WINDOWS/SYSTEM32", "a\r\nb", "onLoad =1", "", None,
    "İstanbul UNİON SELECT", "sleep (5) waitfor  delay", "javascript: FTP://", "İΣ select\tfrom", "café=1 $where $ne",
]


def requests(spark, texts):
    rows = [(i, "POST", "/x", text, {"Host": "h", "Cookie": "union select"}) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, REQUEST)


def matches(df):
    return {r.request_id: r.matched_signatures for r in df.collect()}


@pytest.mark.parametrize(("pattern", "texts"), [
    ("union\\s+select", ("select",)),
    ("(?i)<SCRIPT|<iframe", ("iframe", "script")),
    ("(?:ab|cd)?xyz", ("xyz",)),
    ("a(?=bcd)e+", None),
    ("ab*cde", ("cde",)),
    ("(abc){0,2}de", ("de",)),
    ("(abc){1,2}.", ("abc",)),
    ("[a-z]+", None),
    ("a|bcd", None),
    ("(?iu)straße", None),
    ("(?x) a b c", None),
    ("[a&&[b]]cdef", None),
    ("\\Qabc\\E", None),
    ("\\101bcd", None),
    ("\\p{L}abc", None),
    ("é=12é", ("=12",)),
    ("", None),
])
def test_texts_a_pattern_needs(pattern, texts):
    got = needed_texts(pattern)
    assert got == texts or (texts and got and set(got) == set(texts))


def test_needed_texts_are_in_every_match():
    for rule in rules.RULES:
        needed = needed_texts(rule.pattern, rule.literal)
        pattern = re.escape(rule.pattern) if rule.literal else rule.pattern
        for text in filter(None, TEXTS):
            if needed and re.search(pattern, text, re.ASCII):
                assert any(n in text.lower() for n in needed)


def test_three_forms_agree_on_every_rule(spark):
    df = requests(spark, TEXTS)
    signatures = rules.default_signatures()
    plain = [Signature(s.id, s.patterns, literal=s.literal) for s in signatures]
    expected = matches(rules.prefilter(df, plain))
    assert sum(map(len, expected.values())) > 20
    assert matches(rules.prefilter(df, signatures)) == expected
    assert matches(scan_signatures(df, signatures)) == expected
    assert matches(scan_signatures(df, signatures, slice_size=3)) == expected


def test_order_repeats_and_empty_catalogs(spark):
    df = requests(spark, ["abc xyz", None])
    catalog = [Signature("z", ("xyz", "abc")), Signature("a", ("[a-c]+",)), Signature("z", ("(?i)ABC",)), Signature("none", ())]
    assert matches(scan_signatures(df, catalog)) == {0: ["z", "a", "z"], 1: []}
    assert matches(scan_signatures(df, [])) == {0: [], 1: []}
    assert matches(scan_signatures(df.limit(0), catalog)) == {}


def test_twenty_thousand_signatures(spark):
    catalog = (Signature(f"s{n}", (f"(?i)key{n}=\\d+(?:&|\\s|$)",)) for n in range(20_000))
    texts = [f"Key{n}=1&KEY{n * 7}=2 key{n}x=3" for n in range(0, 4000, 5)]
    found = scan_signatures(requests(spark, texts), catalog)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "key19999" not in plan and plan.lower().count("rlike") <= 2
    got = matches(found)
    for i, n in enumerate(range(0, 4000, 5)):
        assert got[i] == [f"s{k}" for k in sorted({n, n * 7}) if k < 20_000]


def test_scan_uses_the_text_once(spark):
    found = scan_signatures(requests(spark, TEXTS), rules.default_signatures()).select(F.size("matched_signatures"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_loaded_signatures_run_only_where_a_needed_text_is(spark):
    rows = [(r.id, [re.escape(r.pattern) if r.literal else r.pattern]) for r in rules.RULES]
    rows += [("two", ["[;|]\\s*ls", "(?i)K=\\d"]), ("any", ["[a-c]+", "xyz"])]
    catalog = spark.createDataFrame(rows, "id string, patterns array<string>").selectExpr(
        "id", "'' as name", "'' as category", "'' as severity", "patterns", "'' as description")
    loaded = list(signatures_of(catalog.coalesce(1)))
    guards = {s.id: s.word_guard for s in loaded}
    assert guards["two"] == (";", "k=", "|") and guards["any"] == () and guards["990023"] == guards["990031"] == ("=",)
    df = requests(spark, [*TEXTS, "a;  ls", "\u212a=1 K=2", "k=", "| LS"])
    expected = matches(rules.prefilter(df, [Signature(i, tuple(p)) for i, p in rows]))
    assert sum(map(len, expected.values())) > 20
    assert matches(rules.prefilter(df, loaded)) == expected
    assert guard_of([]) == ()


def test_signature_file_scans_each_text_once(spark, tmp_path):
    """The scan stands in one projection and in no filter below or above it."""
    from reqlens.plans.sink_queries import signature_file

    page = spark.createDataFrame([(4, "http://a.b/x?q=union select", "<p>" + "a;ls " * 9)], "page_id long, url string, html string")
    page.write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("select 1L event_id, timestamp_ntz'2024-01-01 00:00:00' ts, 2L user_id, 'view' event_type, 1d value, '{\"k\": 3}' props").write.parquet(str(tmp_path / "events.parquet"))
    found = signature_file(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if " Filter " in f" {line} " and "RLIKE" in line.upper()]
    assert found.count() > 0


def test_a_catalog_table_is_scanned_as_its_signatures_are(spark):
    rows = [(r.id, [re.escape(r.pattern) if r.literal else r.pattern]) for r in rules.RULES]
    rows += [("broken", ["(a", "x{2", "[", "*ls", "sleep"]), ("z", ["(?i)SCRIPT", None, "whoami"]), ("a", ["[a-c]+"]), ("z", ["rm|SELECT"]), ("none", []), ("null", None), ("eq", ["=="])]
    catalog = spark.createDataFrame(rows, "id string, patterns array<string>").selectExpr(
        "id", "'' as name", "'' as category", "'' as severity", "patterns", "'' as description").coalesce(1)
    df = requests(spark, TEXTS)
    expected = matches(rules.prefilter(df, list(signatures_of(catalog))))
    assert sum(map(len, expected.values())) > 20 and any("z" in ids and "eq" in ids for ids in [sum(expected.values(), [])])
    assert matches(scan_catalog(df, catalog)) == expected
    assert matches(scan_catalog(df, catalog, slice_size=3)) == expected
    assert matches(scan_catalog(df, catalog.limit(0))) == dict.fromkeys(expected, [])


def test_a_large_catalog_is_not_walked_by_the_driver(spark, monkeypatch):
    """Its order is kept, all of its texts are in one automaton, and that is made once."""
    from pyspark.sql.classic.dataframe import DataFrame

    from reqlens.plans import request_queries

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows taken one by one"))
    made, candidates = [], scan.candidates
    monkeypatch.setattr(scan, "candidates", lambda df, patterns, lower: made.append(patterns) or candidates(df, patterns, lower))
    ids = spark.range(0, 60_000, 1, 12).withColumn("n", 60_000 - F.col("id")).orderBy("n")
    catalog = ids.select(F.concat(F.lit("s"), "n").alias("id"), F.array(F.concat(F.lit("(?i)Key"), "n", F.lit(r"=\d")), F.concat(F.lit("k"), "n", F.lit("#"))).alias("patterns"))
    found = scan_catalog(requests(spark, ["key7=1 KEY59999=2 key8=x k10#", "k3 key60001=1"]), catalog)
    assert len(made) == 1 and made[0].num_rows == 120_000
    assert matches(found) == {0: ["s7", "s10", "s59999"], 1: []}
    part = scan.worker_part(scan.catalog_patterns(catalog.limit(3)))
    assert scan.machine_of(part) is scan.machine_of(part) and len(part["patterns"]) == 6
    assert request_queries.signature_scan_many(spark, "/root/testdata/sf0.001").columns == ["request_id", "matched_signatures"]
