"""Following a growing log file as a stream: a data source whose offset is a file and a byte.

The offset names the file by what it is, not by its name: the file that had the watched name keeps its offset when
it is renamed, is read to its end there, and the stream goes on with the file that now has the name. Python's stat
gives that identity (device and inode). A file shorter than its offset was truncated and is read again from its start; one that
was truncated and has grown past its offset between two looks cannot be told from one that has only grown.

Only whole lines are taken; a line without its end waits for more, except in a file that was rotated away, whose
last line is whole as it is. A batch is split by bytes, so a large backlog is read by many tasks: a task reads the
lines that begin in its range. The source needs a file system that driver and executors both see under the path.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINE = "value string, file string, position long"
#: Bytes a task reads, and bytes read at once.
SPLIT_BYTES, BLOCK = 64 << 20, 1 << 20


def identity(path: str) -> str | None:
    """Device and inode of a file, None while there is none."""
    try:
        found = os.stat(path)
    except FileNotFoundError:
        return None
    return f"{found.st_dev}:{found.st_ino}"


def places(path: str) -> dict[str, str]:
    """Present names of the files that have or had the watched name: the file itself and its rotated siblings.

    A sibling has the name and a suffix of digits, dots and dashes; compressed ones were read before they were packed.
    """
    watched = Path(path)
    names = [n for n in watched.parent.glob(f"{glob.escape(watched.name)}*") if re.fullmatch(r"[-.0-9]*", n.name[len(watched.name):])] if watched.parent.is_dir() else []
    return {i: str(n) for n in names if n.is_file() and (i := identity(str(n)))}


def last_line_end(path: str, start: int, end: int) -> int:
    """Byte after the last line end in a range, its start if there is none."""
    with open(path, "rb") as f:
        while end > start:
            low = max(start, end - BLOCK)
            f.seek(low)
            found = f.read(end - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            end = low
    return start


class Range(InputPartition):
    """Lines of a file that begin in [start, end); ``whole`` is where the batch's part of the file starts."""

    def __init__(self, file: str, start: int, end: int, whole: int, limit: int) -> None:
        self.file, self.start, self.end, self.whole, self.limit = file, start, end, whole, limit


def lines_of(part: Range, path: str) -> Iterator[tuple[str, str, int]]:
    """The lines of a range with their places; the file is found by identity, whatever its name is now."""
    name = places(path).get(part.file)
    if name is None:
        raise FileNotFoundError(f"{part.file} is neither at {path} nor a rotated file beside it")
    with open(name, "rb") as f:
        at = part.start
        f.seek(at if at == part.whole else at - 1)
        if at > part.whole:
            at += len(f.readline()) - 1  # the line that began before belongs to the range before
        while at < part.end:
            raw = f.readline(part.limit - at)
            if not raw:
                return
            yield raw.rstrip(b"\r\n").decode("utf-8", "replace"), part.file, at
            at += len(raw)


class FollowReader(DataSourceStreamReader):
    """Offset: every file that has or had the watched name, with the byte up to which it counts as seen.

    An offset is made from what is there alone, so a restarted stream needs nothing but its checkpoint: a file that
    the start offset lists is read on from there, one that it does not list is new and read from its beginning.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.from_start = options.get("start", "end") == "beginning"

    def initialOffset(self) -> dict:
        return {"files": "[]"} if self.from_start else self.latestOffset()

    def latestOffset(self) -> dict:
        """The files, oldest first; of the live one only whole lines, a rotated one ends where it ends."""
        live, out = identity(self.path), []
        for file, name in places(self.path).items():
            found = os.stat(name)
            end = last_line_end(name, 0, found.st_size) if file == live else found.st_size
            out.append([file != live, found.st_mtime_ns, file, end])
        return {"files": json.dumps([[file, end] for _, _, file, end in sorted(out, key=lambda x: (not x[0], x[1]))])}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges of bytes from where the start offset was to where the end offset is."""
        before, out = dict(json.loads(start["files"])), []
        for file, stop in json.loads(end["files"]):
            begin = before.get(file, 0)
            begin = 0 if stop < begin else begin  # truncated
            out += [Range(file, at, min(at + self.split, stop), begin, stop) for at in range(begin, stop, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, str, int]]:
        return lines_of(partition, self.path)


class FollowSource(DataSource):
    """``spark.readStream.format("follow").option("path", ...)``; option ``start`` is ``end`` or ``beginning``."""

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options)


def follow_file(spark: SparkSession, path: str, start: str = "end") -> DataFrame:
    """Non-blank lines written to a file from now on (or from its beginning), across rotation and truncation."""
    spark.dataSource.register(FollowSource)
    rows = spark.readStream.format("follow").option("start", start).load(path)
    return rows.where(F.trim("value") != "")
