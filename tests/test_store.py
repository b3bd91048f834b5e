import pytest
from pyspark.sql import functions as F

from reqlens.sources.store import KeyedStore
from reqlens.streaming import flows

FIELDS = "alert_key string, ai_status string, v int, m map<string,int>"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/s", "alert_key", FIELDS)


@pytest.fixture
def rows(spark):
    def make(*keys, v=1, status="enriched"):
        return spark.createDataFrame([(k, status, v, {"n": v}) for k in keys], FIELDS)

    return make


def keys(df):
    return sorted((r.alert_key, r.v) for r in df.collect())


def test_replayed_batch_keeps_its_keys(store, rows):
    """A replay meets its own first try as stored and must not put the rest in its place."""
    score = lambda df: df
    for _ in range(3):
        if not store.applied(0, "w"):
            store.upsert(flows.enrich_batch(rows("a", "b"), store, score), 0, writer="w")
    assert keys(store.current()) == [("a", 1), ("b", 1)]
    assert not store.upsert(rows("c"), 0, writer="w")
    assert keys(store.current()) == [("a", 1), ("b", 1)]


def test_attempt_that_dies_before_its_commit_is_not_seen(store, rows, monkeypatch):
    store.upsert(rows("a"), 0)

    def dies(change):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", dies)
        with pytest.raises(RuntimeError):
            store.upsert(rows("b", v=9), 1)
    assert keys(store.current()) == [("a", 1)] and not store.applied(1)
    assert store.upsert(rows("b", v=2), 1)
    assert keys(store.current()) == [("a", 1), ("b", 2)]
    assert store.sweep(3600) == 0 and store.sweep(-60) == 1
    assert keys(store.current()) == [("a", 1), ("b", 2)]


def test_compaction_between_and_a_new_writer(store, rows):
    store.upsert(rows("a", "b"), 0, writer="first")
    store.upsert(rows("b", v=2), 1, writer="first")
    assert store.compact() and not store.compact()
    assert not store.upsert(rows("z"), 1, writer="first")
    assert store.upsert(rows("c"), 0, writer="second")
    assert keys(store.current()) == [("a", 1), ("b", 2), ("c", 1)]


def test_batch_committed_during_compaction_stays(store, rows, monkeypatch):
    store.upsert(rows("a"))
    store.upsert(rows("a", "b", v=2))
    plain = store.write_attempt

    def meanwhile(merged):
        folder = plain(merged)
        monkeypatch.setattr(store, "write_attempt", plain)
        store.upsert(rows("b", "c", v=3))
        return folder

    monkeypatch.setattr(store, "write_attempt", meanwhile)
    assert store.compact()
    assert keys(store.current()) == [("a", 2), ("b", 3), ("c", 3)] and len(store.manifest()["folders"]) == 2


def test_compaction_gives_way_to_another_and_to_clear(store, rows, monkeypatch):
    store.upsert(rows("a"))
    store.upsert(rows("b"))
    plain = store.write_attempt

    def cleared(merged):
        folder = plain(merged)
        store.clear()
        return folder

    monkeypatch.setattr(store, "write_attempt", cleared)
    assert not store.compact()
    assert keys(store.current()) == []


def test_two_writers_take_turns(store, rows, monkeypatch):
    """Another version appears between reading the newest and making the next: the commit is tried again."""
    other = KeyedStore(store.spark, store.path, "alert_key", FIELDS)
    plain, raced = store._create, []

    def race(manifest):
        if not raced:
            raced.append(1)
            other.upsert(rows("x"))
        return plain(manifest)

    monkeypatch.setattr(store, "_create", race)
    assert store.upsert(rows("y"))
    assert keys(store.current()) == [("x", 1), ("y", 1)] and store.manifest()["version"] == 2


def test_clear_counts_what_it_clears(store, rows, monkeypatch):
    store.upsert(rows("a", "b"))
    plain, raced = store._create, []

    def race(manifest):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(store, "_create", plain)
            store.upsert(rows("c"))
        return plain(manifest)

    monkeypatch.setattr(store, "_create", race)
    assert store.clear() == 3 and keys(store.current()) == []
    store.upsert(rows("d"))
    assert keys(store.current()) == [("d", 1)]


def test_one_row_of_a_key_wins_whole(store, spark):
    both = spark.createDataFrame([("a", None, 1, {"x": 1}), ("a", "new", None, None)], FIELDS).coalesce(1)
    store.upsert(both)
    assert [(r.ai_status, r.v, r.m) for r in store.current().collect()] == [("new", None, None)]
    store.upsert(both.withColumn("at", F.coalesce("v", F.lit(0))), order="at")
    assert [(r.ai_status, r.v, r.m) for r in store.current().collect()] == [("new", 1, {"x": 1})]
    assert [(r.ai_status, r.v) for r in store.current(merge_fields=False).collect()] == [(None, 1)]


def test_lookup_reads_only_the_keys_buckets(store, rows, spark):
    store.upsert(rows(*[f"k{i}" for i in range(200)]))
    store.upsert(rows("k7", v=5))
    found = store.lookup(spark.createDataFrame([("k7",), ("nobody",)], "alert_key string"))
    assert keys(found) == [("k7", 5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_empty_batches_and_tables(store, rows):
    assert store.current().count() == 0 and store.clear() == 0 and not store.compact()
    store.upsert(rows("a").limit(0), 0)
    assert store.current().count() == 0 and store.applied(0)
    store.upsert(rows("a"), 1)
    assert keys(store.current()) == [("a", 1)]
    assert store.lookup(rows("a").limit(0)).count() == 0


def test_stream_restarted_from_its_checkpoint_and_a_new_one(spark, store, rows, tmp_path):
    source = f"{tmp_path}/in"
    rows("a", "b").write.parquet(source)
    stream = lambda: spark.readStream.schema(FIELDS).parquet(source)
    mark = lambda df: df.withColumn("v", F.col("v") + 10)
    flows.run_available(flows.into_store(stream(), store, f"{tmp_path}/c1", mark))
    rows("c").write.mode("append").parquet(source)
    flows.run_available(flows.into_store(stream(), store, f"{tmp_path}/c1", mark))
    assert keys(store.current()) == [("a", 11), ("b", 11), ("c", 11)]
    rows("d", "a", v=50).write.mode("append").parquet(source)
    flows.run_available(flows.into_store(stream(), store, f"{tmp_path}/c2", mark))
    assert keys(store.current()) == [("a", 11), ("b", 11), ("c", 11), ("d", 60)]
