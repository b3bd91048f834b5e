from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from reqlens.functions import features
from reqlens.sources import files


def test_folder_of_three_encodings(spark, tmp_path):
    """Each file is read in its own encoding; over-long rows come back as skipped, columns may differ."""
    text = 'Sentence,Label\n"caf\xe9 {0}, \'1\'",1\n"two\nlines {0}",0\n1,2,3,4\n'
    for name, encoding in (("a b.csv", "utf-8"), ("b.csv", "utf-16"), ("c.csv", "latin-1")):
        (tmp_path / name).write_bytes(text.format(encoding).encode(encoding))
    (tmp_path / "d.csv").write_text("Label,Sentence,Note\n1,swapped,n\n")
    rows, skipped = files.csv_parts(spark, str(tmp_path))
    got = sorted((r.Sentence, r.Label, r.Note) for r in rows.collect())
    want = [(f"caf\xe9 {e}, '1'", "1", None) for e in ("utf-8", "utf-16", "latin-1")] + [(f"two\nlines {e}", "0", None) for e in ("utf-8", "utf-16", "latin-1")]
    assert got == sorted([*want, ("swapped", "1", "n")])
    assert sorted(r.file.rsplit("/", 1)[1] for r in skipped.collect()) == ["a%20b.csv", "b.csv", "c.csv"]
    assert {(r.Sentence, r.Label, r.skip_reason) for r in skipped.collect()} == {("1", "2", "too many fields")}
    good, bad = files.sentence_requests(rows, "sqli")
    assert good.count() == 7 and bad.count() == 0


def test_empty_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    rows, skipped = files.csv_parts(spark, str(tmp_path))
    assert rows.count() == 0 and skipped.count() == 0


URIS = [
    "/a/b?x=1&y=22", " \x01/a/b/c", "/a\tb/c\n/d?k\r=v\tv&z=", "\n\n//host/p?q=1", "ht\ntp://h/a/b;p?x=%41", "/a?x=1\n2&&y", "\t", "", "/p\r\n/q;r/s;t?u=v;w",
    "/e?=\t1", "http://h\t/x?y=\n", "\x1f?a=1", "/\x0b/\x0c?v=\x0b\x0c",
]


@pytest.mark.parametrize("uri", URIS)
def test_targets_with_control_characters_as_the_strict_parser_sees_them(spark, uri):
    parts = urlparse(uri)
    query = parse_qs(parts.query, keep_blank_values=True) if parts.query else {}
    c = F.lit(uri)
    row = spark.range(1).select(
        features.uri_depth(c).alias("d"), features.query_param_count(c).alias("n"), features.max_param_value_length(c, F.lit("")).alias("m")).first()
    want = len([s for s in parts.path.split("/") if s]), len(query), max((len(v) for vs in query.values() for v in vs), default=0)
    assert (row.d, row.n, row.m) == want
