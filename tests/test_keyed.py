"""Holds on streams and in batches: cooldowns, duplicate triggers, as-of values over chunks."""

import random
import tracemalloc
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from candlewick.operators import checks, decisions
from candlewick.streaming import keyed

START = datetime(2024, 1, 1)


def passed(times, hold):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last >= hold:
            last = t
            out.append(t)
    return out


def triggers(spark, rows):
    table = [(i, k, START + timedelta(seconds=t)) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(table, "event_id long, key string, ts timestamp")


@pytest.fixture(scope="module")
def many():
    pick = random.Random(8)
    dense = [("dense", t) for t in range(0, 40_000, 7)]
    return dense + [(k, pick.randrange(0, 500_000)) for k in ("a", "b") for _ in range(300)] + [("a", 1000), ("a", 1000), ("once", 5)]


def want(rows, hold):
    return sorted((k, t) for k in {k for k, _ in rows} for t in passed([t for x, t in rows if x == k], hold))


def seconds(frame):
    return sorted((r.key, int((r.ts - START).total_seconds())) for r in frame.collect())


def test_cooldown_by_pointers(spark, many):
    found = checks.cooldown(triggers(spark, many), 300)
    assert seconds(found) == want(many, 300)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_cooldown_of_an_empty_table(spark):
    assert checks.cooldown(triggers(spark, []).filter("false"), 5).collect() == []


def run(frame, path, session):
    with keyed.keyed_state(session):
        q = frame.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return session.read.schema(frame.schema).parquet(f"{path}/rows")


def test_cooldown_on_a_stream_equals_the_batch(spark, tmp_path, many):
    rows = sorted(many, key=lambda r: r[1])
    step = len(rows) // 3 + 1
    for k in range(3):  # in order of time: each file is a micro-batch
        triggers(spark, rows[k * step : (k + 1) * step]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("event_id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert seconds(run(keyed.cooled_down(source, 300), str(tmp_path), spark)) == want(many, 300)


CONTEXT = """n long, bar_time timestamp, symbol string, strategy_id long, strategy_type string, trigger_type string, ind_code string, ind_value double,
 ind_extra map<string,double>, px_last double, sig_intent_id long, sig_received_at timestamp, sig_valid boolean, state_side string, param_capital double, param_ratio double"""


def contexts(spark, rows):
    """Rows (seconds, trigger, intent) of one strategy; state, indicator and price are there."""
    made = [(n, START + timedelta(seconds=t), "s", 1, "SIGNAL_DRIVEN", kind, "SMA", 1.0, None, price, intent, START + timedelta(seconds=t - 1), True, side, 100.0, 0.5) for n, (t, kind, intent, price, side) in enumerate(rows)]
    return spark.createDataFrame(made, CONTEXT)


def test_a_key_is_refused_expires_and_is_taken_again_on_a_stream(spark, tmp_path):
    rows = [
        (10, "SIGNAL", 7, 1.0, "FLAT"), (20, "SIGNAL", 7, 1.0, "FLAT"), (25, "SIGNAL", 8, -1.0, "FLAT"), (30, "SIGNAL", 8, 1.0, "FLAT"), (40, "SIGNAL", 9, 1.0, None),
        (2000, "SIGNAL", 7, 1.0, "FLAT"), (3609, "SIGNAL", 7, 1.0, "FLAT"), (3610, "SIGNAL", 7, 1.0, "FLAT"), (3620, "OTHER", 7, 1.0, "FLAT"), (3621, "OTHER", 7, 1.0, "FLAT"),
        (9000, "SIGNAL", 7, 1.0, "FLAT"), (9001, "BAR", None, 1.0, "FLAT"), (9001, "BAR", None, 1.0, "FLAT"),
    ]
    table = contexts(spark, rows)
    for k, some in enumerate(("n < 5", "n between 5 and 9", "n > 9")):
        table.filter(some).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = {r.n: r.reject for r in run(keyed.guarded(stream, "bar_time").select("n", "reject"), str(tmp_path), spark).collect()}
    repeated = decisions.REPEATED
    assert found == {0: None, 1: repeated, 2: "SanityGate: price", 3: repeated, 4: "PhaseGate: no state", 5: repeated, 6: repeated, 7: None, 8: None, 9: None, 10: None, 11: None, 12: repeated}
    whole = {r.n: r.reject for r in decisions.guarded(table, "bar_time").collect()}
    assert sorted(map(str, whole.values())) == sorted(map(str, found.values())) and all(whole[n] == found[n] for n in range(11))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_as_of_carries_over_chunks(spark):
    pick = random.Random(3)
    left = [(i, pick.choice(["a", "b", None]), pick.randrange(10_000)) for i in range(300)]
    right = [(pick.choice(["a", "b", None]), pick.choice([pick.randrange(200), pick.randrange(5000, 5100)]), v) for v in range(80)]
    at = lambda t: START + timedelta(seconds=t)
    a = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "i int, k string, t timestamp")
    b = spark.createDataFrame([(k, at(t), (at(t), v)) for k, t, v in right], "k string, u timestamp, v struct<u:timestamp,x:int>")
    expected = {i: max(((u, v) for kk, u, v in right if kk == k and u <= t), default=(None, None))[1] for i, k, t in left}
    for span in (50_000, 10**12):
        assert {r.i: r.x for r in decisions.as_of(a, b, ["k"], "t", "u", "v", span_ms=span).select("i", F.col("v.x").alias("x")).collect()} == expected


class Handle:
    """The state and timers of one key, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    getValueState = lambda self, name, schema: self
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, value: setattr(self, "value", value)
    listTimers = lambda self: iter(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)


def test_a_key_with_many_rows_is_not_held_in_memory():
    row, pick, n = Row("event_id", "key", "_us", "_ttl"), random.Random(5), 300_000
    hold = keyed.Hold("event_id", passed=True)
    hold.init(handle := Handle())
    times = {}

    def rows():
        for i in range(n):
            us = pick.randrange(10**9)
            times[i] = us
            yield row(i, "hot", us, 10**6)

    list(map(times.get, rows()))  # the times themselves are no part of what is measured
    pick.seed(5)
    tracemalloc.start()
    found = list(hold.handleInputRows(("hot",), rows(), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["_us"] for r in found] == passed(times.values(), 10**6) and all(r.taken for r in found)
    assert handle.value == (found[-1]["_us"], 10**6) and len(handle.timers) == 1
    assert peak < 50 << 20


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 57])
def test_rows_in_order_by_runs(n):
    rows = [(random.Random(i).randrange(9), i) for i in range(n)]
    assert list(keyed.in_order(iter(rows), lambda r: r[0], 10, 3)) == sorted(rows, key=lambda r: r[0])


def test_rows_without_a_key_pass_and_are_dealt_to_parts(spark, tmp_path):
    table = spark.createDataFrame([(i, None if i % 2 else "k", START + timedelta(seconds=i)) for i in range(40)], "event_id long, key string, ts timestamp")
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    found = run(keyed.cooled_down(source, 10), str(tmp_path), spark).collect()
    assert sorted((r.event_id, r.key) for r in found) == sorted([(i, None) for i in range(1, 40, 2)] + [(i, "k") for i in range(0, 40, 10)])
