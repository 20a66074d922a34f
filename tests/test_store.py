"""The keyed store: replays, restarts, two writers, pruning."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.sources.store import Saved, Store

SCHEMA = "k string, ts timestamp, v int"
DAY = datetime(2024, 3, 1)


def rows(spark, *made):
    return spark.createDataFrame([(k, DAY + timedelta(days=d), v) for k, d, v in made], SCHEMA)


def read(store, *days):
    return sorted((r.k, (r.ts - DAY).days, r.v) for r in store.read(*days).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", SCHEMA, ["k", "ts"], arrival="v")


def test_keys_are_stored_once_and_counted(spark, store):
    assert store.read().count() == 0
    assert store.save(rows(spark, ("a", 0, 2), ("a", 0, 1), ("b", 1, 1)), "s", 0) == Saved(2, 1)
    assert store.save(rows(spark, ("a", 0, 9), ("c", 1, 1)), "s", 1) == Saved(1, 1)
    assert store.save(rows(spark), "s", 2) == Saved(0, 0)
    assert read(store) == [("a", 0, 1), ("b", 1, 1), ("c", 1, 1)] and read(store, "2024-03-02") == [("b", 1, 1), ("c", 1, 1)]


def test_a_replay_adds_nothing_and_a_second_stream_loses_nothing(spark, store, tmp_path):
    log = Store(spark, f"{tmp_path}/log", SCHEMA, [])
    for s in (store, log):
        s.save(rows(spark, ("a", 0, 1), ("b", 0, 1)), "one", 0)
        again = Store(spark, s.path, SCHEMA, s.keys)
        again.save(rows(spark, ("x", 0, 1)), "one", 0)
        again.save(rows(spark, ("c", 0, 1), ("c", 0, 1)), "two", 0)
    assert read(store) == [("a", 0, 1), ("b", 0, 1), ("c", 0, 1)]
    assert read(log) == [("a", 0, 1), ("b", 0, 1), ("c", 0, 1), ("c", 0, 1)]


def test_rows_of_a_writer_that_failed_are_not_seen(spark, store, monkeypatch):
    def lost(self, entry):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_committed", lost)
        with pytest.raises(RuntimeError):
            store.save(rows(spark, ("a", 0, 1)), "s", 0)
    assert read(store) == []
    assert store.save(rows(spark, ("a", 0, 2)), "s", 0) == Saved(1, 0) and read(store) == [("a", 0, 2)]


def test_of_two_writers_at_once_the_later_one_leaves_the_others_keys(spark, store, monkeypatch):
    other, whole = Store(spark, store.path, SCHEMA, ["k", "ts"]), Store._committed
    calls = []

    def meanwhile(self, entry):
        if self is store and not calls:
            calls.append(other.save(rows(spark, ("a", 0, 7), ("d", 0, 7)), "other", 0))
        return whole(self, entry)

    monkeypatch.setattr(Store, "_committed", meanwhile)
    assert store.save(rows(spark, ("a", 0, 1), ("b", 0, 1)), "s", 0) == Saved(1, 1)
    assert calls == [Saved(2, 0)] and read(store) == [("a", 0, 7), ("b", 0, 1), ("d", 0, 7)]
    assert [c["version"] for c in store.log()] == [0, 1]


def test_only_the_days_of_a_batch_are_read(spark, store):
    store.save(rows(spark, *(("a", d, 1) for d in range(20))), "s", 0)
    days = store.read("2024-03-05", "2024-03-06")
    files = days.select(F.input_file_name().alias("f")).distinct().collect()
    assert days.count() == 2 and all("day=2024-03-0" in r.f for r in files)
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:200]


def test_a_stream_goes_on_from_its_checkpoint(spark, store, tmp_path):
    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = source.writeStream.foreachBatch(store.sink("s")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    rows(spark, ("a", 0, 1)).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    run()
    rows(spark, ("a", 0, 5), ("b", 3, 1)).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run()
    run()
    assert read(store) == [("a", 0, 1), ("b", 3, 1)]
    assert [(c["batch"], c["inserted"], c["skipped"]) for c in store.log()] == [(0, 1, 0), (1, 1, 1)]
