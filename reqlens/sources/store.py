"""Keyed table of Parquet batches with atomic commits and merge on read.

Every write goes to a fresh attempt folder, split by a hash bucket of the key. It becomes part of the table by one
manifest version that names the folders in force, oldest first, and the last batch each writer committed. A version
is created by a rename that fails if the version exists; who loses reads the new one and tries again. So

* an attempt that dies before its commit is never seen, and its replay writes another one;
* a replay of a committed batch changes nothing, also after a compaction, and a reader in the replay does not meet
  rows of its own first try;
* a writer with a name of its own starts its own count of batches;
* compaction and clearing replace just the folders they have read; batches committed meanwhile stay.

A batch adds folders of its own size; readers keep the newest value of each key, and a lookup of some keys reads only
their buckets. Manifests are small: one entry for each batch since the last compaction.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table; each is a folder in an attempt.
BUCKETS = 8
EMPTY = {"version": 0, "folders": [], "writers": {}}


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = key
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.buckets = buckets

    # ---- manifest ----

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, fs = self._hadoop(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def manifest(self) -> dict:
        """The newest version: its number, the folders in force, and the last batch of every writer."""
        versions = [n for n in self._names(f"{self.path}/log") if n.endswith(".json")]
        if not versions:
            return EMPTY
        target, fs = self._hadoop(f"{self.path}/log/{versions[-1]}")
        stream = fs.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, manifest: dict) -> bool:
        """Write a version; False when it exists already."""
        name = f"{manifest['version']:020d}.json"
        draft, fs = self._hadoop(f"{self.path}/log/.{name}.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        target, _ = self._hadoop(f"{self.path}/log/{name}")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        plain = self.spark.sparkContext._gateway.new_array(rename, 1)
        plain[0] = rename.NONE
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), plain)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception.toString()):
                return False
            raise
        return True

    def commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Make the next version from the newest; ``change`` gives its new parts, or None to leave all as it is."""
        while True:
            now = self.manifest()
            new = change(now)
            if new is None:
                return False
            if self._create({**now, **new, "version": now["version"] + 1}):
                return True

    def applied(self, batch: int, writer: str = "") -> bool:
        """Whether a writer's batch is part of the table."""
        return self.manifest()["writers"].get(writer, -1) >= batch

    # ---- writes ----

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write_attempt(self, rows: DataFrame) -> str:
        """Rows in a fresh folder that no version names yet."""
        name = uuid.uuid4().hex
        dealt = rows.withColumn("bucket", self._bucket(F.col(self.key))).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/data/attempt={name}")
        return name

    def newest_rows(self, df: DataFrame, order: str | None) -> DataFrame:
        """One row for each key of a batch: that with the largest ``order``, else the last one."""
        names = [f.name for f in self.schema if f.name in df.columns]
        newest = F.max_by(F.struct(*names), F.col("_order")).alias("_r")
        placed = df.withColumn("_order", F.monotonically_increasing_id() if order is None else F.col(order))
        return placed.groupBy(F.col(self.key).alias("_key")).agg(newest).select("_r.*")

    def upsert_after(self, seen: dict, df: DataFrame) -> bool:
        """Insert or update by key if ``seen`` is still the newest version, for rows that depend on what was read."""
        folder = self.write_attempt(self.newest_rows(df, None))
        return self._create({**seen, "folders": [*seen["folders"], folder], "version": seen["version"] + 1})

    def upsert(self, df: DataFrame, batch: int | None = None, order: str | None = None, writer: str = "") -> bool:
        """Insert or update by key; within the batch the row with the largest ``order`` wins, else the last one.

        A batch with a number is taken once per writer, in rising numbers; False if it was taken before.
        """
        if batch is not None and self.applied(batch, writer):
            return False
        folder = self.write_attempt(self.newest_rows(df, order))

        def add(now: dict) -> dict | None:
            if batch is not None and now["writers"].get(writer, -1) >= batch:
                return None
            writers = now["writers"] if batch is None else {**now["writers"], writer: batch}
            return {"folders": [*now["folders"], folder], "writers": writers}

        return self.commit(add)

    def compact(self) -> bool:
        """Merge the folders in force into one; batches committed meanwhile stay behind it."""
        read = self.manifest()["folders"]
        if len(read) < 2:
            return False
        folder = self.write_attempt(self._merged(read))

        def replace(now: dict) -> dict | None:
            if now["folders"][: len(read)] != read:
                return None  # compacted or cleared by another
            return {"folders": [folder, *now["folders"][len(read) :]]}

        return self.commit(replace)

    def clear(self) -> int:
        """Empty the table; returns how many keys there were. What is committed meanwhile is counted and cleared too."""
        gone = 0
        while True:
            now = self.manifest()
            gone = self._merged(now["folders"]).count()
            if self._create({**now, "folders": [], "version": now["version"] + 1}):
                return gone

    def sweep(self, older_than_seconds: float) -> int:
        """Delete attempt folders that the newest version does not name and that are older; returns how many.

        Choose an age beyond the longest write and the longest read.
        """
        named = set(self.manifest()["folders"])
        folder, fs = self._hadoop(f"{self.path}/data")
        if not fs.exists(folder):
            return 0
        limit = self.spark._jvm.java.lang.System.currentTimeMillis() - older_than_seconds * 1000
        old = [s.getPath() for s in fs.listStatus(folder) if s.getModificationTime() <= limit]
        old = [p for p in old if p.getName().removeprefix("attempt=") not in named]
        return sum(bool(fs.delete(p, True)) for p in old)

    # ---- reads ----

    def _scan(self, folders: list[str]) -> DataFrame:
        """Rows of the folders with their place in the order of commits, and their bucket."""
        fields = T.StructType([*self.schema.fields, T.StructField("attempt", T.StringType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.path}/data/attempt={f}" for f in folders]
        held = [p for p in paths if any(n.startswith("bucket=") for n in self._names(p))]  # an empty batch has no buckets
        if not held:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("_at", T.LongType())]))
        rows = self.spark.read.schema(fields).option("basePath", f"{self.path}/data").parquet(*held)
        place = F.create_map(*[F.lit(x) for k, f in enumerate(folders) for x in (f, k)])
        return rows.withColumn("_at", place[F.col("attempt")].cast("long")).drop("attempt")

    def _merged(self, folders: list[str], merge_fields: bool = True, buckets: list[int] | None = None) -> DataFrame:
        rows = self._scan(folders)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        names = [f.name for f in self.schema if f.name != self.key]
        if not names:
            return rows.select(self.key).distinct()
        if merge_fields:
            newest = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_at"))).alias(n) for n in names]
            merged = rows.groupBy(self.key).agg(*newest)
        else:
            merged = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), F.col("_at")).alias("_r")).select(self.key, "_r.*")
        return merged.select(*self.schema.fieldNames())

    def current(self, merge_fields: bool = True) -> DataFrame:
        """One row per key: the newest non-null value of each field, or whole newest rows when
        ``merge_fields`` is off."""
        return self._merged(self.manifest()["folders"], merge_fields)

    def lookup(self, keys: DataFrame, merge_fields: bool = True) -> DataFrame:
        """The rows of some keys; only buckets that hold one of them are read. ``keys`` has the key column."""
        wanted = [r[0] for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()]  # at most BUCKETS
        found = self._merged(self.manifest()["folders"], merge_fields, wanted)
        return found.join(keys.select(self.key).distinct(), self.key, "left_semi")
