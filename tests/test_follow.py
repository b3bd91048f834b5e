import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reqlens.sources import follow
from reqlens.streaming import flows


@pytest.fixture
def log(tmp_path):
    return tmp_path / "logs" / "audit.json"


def write(path, text, mode="a"):
    path.parent.mkdir(exist_ok=True)
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)


def reader(log, **options):
    return follow.FollowReader({"path": str(log), **options})


def take(r, before, after):
    """Lines of a micro-batch."""
    return [line for p in r.partitions(before, after) for line, _, _ in r.read(p)]


def test_lines_from_the_end_on(log):
    write(log, "old 1\nold 2\nhalf")
    r = reader(log)
    a = r.initialOffset()
    write(log, " is now whole\nnew 1\r\nnew")
    b = r.latestOffset()
    assert take(r, a, b) == ["half is now whole", "new 1"]
    write(log, " 2\n\n")
    c = r.latestOffset()
    assert take(r, b, c) == ["new 2", ""]
    assert take(r, c, r.latestOffset()) == []


def test_rotation_loses_and_repeats_nothing(log):
    write(log, "0\n")
    r = reader(log)
    a = r.initialOffset()
    write(log, "1\n2\n")
    b = r.latestOffset()
    write(log, "3\nlast of the old file")
    os.rename(log, f"{log}.1")
    write(log, "4\n")
    c = r.latestOffset()
    assert take(r, a, b) == ["1", "2"]
    assert take(r, b, c) == ["3", "last of the old file", "4"]
    write(log, "5\n")
    os.rename(f"{log}.1", f"{log}.2")
    os.rename(log, f"{log}.1")
    write(log, "6\n")
    d = r.latestOffset()
    assert take(r, c, d) == ["5", "6"]
    # a replay of an old batch reads the same lines under the files' new names
    assert take(reader(log), b, c) == ["3", "last of the old file", "4"]


def test_two_rotations_between_two_looks(log):
    write(log, "0\n")
    r = reader(log)
    a = r.initialOffset()
    write(log, "1\n")
    os.rename(log, f"{log}.1")
    write(log, "2\n")
    os.utime(log, ns=(os.stat(f"{log}.1").st_mtime_ns + 10**9,) * 2)
    os.rename(f"{log}.1", f"{log}.2")
    os.rename(log, f"{log}.1")
    write(log, "3\n")
    assert take(r, a, r.latestOffset()) == ["1", "2", "3"]


def test_truncation_starts_again(log):
    write(log, "a\nb\nc\n")
    r = reader(log)
    a = r.initialOffset()
    write(log, "d\n")
    b = r.latestOffset()
    assert take(r, a, b) == ["d"]
    write(log, "x\n", "w")
    c = r.latestOffset()
    assert take(r, b, c) == ["x"]
    write(log, "y\n")
    assert take(r, c, r.latestOffset()) == ["y"]


def test_file_that_appears_later_is_read_whole(log):
    r = reader(log)
    a = r.initialOffset()
    assert take(r, a, r.latestOffset()) == []
    write(log, "first\n")
    b = r.latestOffset()
    assert take(r, a, b) == ["first"]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50])
def test_splits_share_no_line_and_miss_none(log, split):
    lines = ["", "a", "long line é 日本", "", "x" * 20, "tail"]
    write(log, "\n".join(lines) + "\n")
    r = reader(log, start="beginning", splitBytes=str(split))
    a = r.initialOffset()
    assert take(r, a, r.latestOffset()) == lines


def test_offsets_survive_a_restart(log):
    write(log, "0\n")
    first = reader(log)
    a = first.initialOffset()
    write(log, "1\n")
    b = first.latestOffset()
    write(log, "2\n")
    again = reader(log)
    c = again.latestOffset()
    assert take(again, a, b) == ["1"] and take(again, b, c) == ["2"]
    assert json.loads(c["files"])[-1][0] == follow.identity(str(log))


def test_stream_over_rotations(spark, log, tmp_path):
    """A stream that is stopped and started again between writes, rotation and truncation, into a table."""
    write(log, "before the stream\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        rows = follow.follow_file(spark, str(log)).select("value")
        flows.run_once(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark))

    run()
    want = Counter()
    for k in range(4):
        write(log, "".join(f"line {k} {i}\n" for i in range(50)))
        want.update(f"line {k} {i}" for i in range(50))
        if k == 1:
            os.rename(log, f"{log}.1")
            write(log, "after the rotation\n   \n")
            want["after the rotation"] += 1
        run()
    write(log, "short\n", "w")
    want["short"] += 1
    run()
    run()
    assert Counter(r.value for r in spark.read.parquet(out).where(F.col("value") != "").collect()) == want
