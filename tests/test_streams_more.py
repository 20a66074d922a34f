"""Streams that measure themselves, keep series, and meet tables."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from candlewick.operators import indicators
from candlewick.plans import streams
from candlewick.streaming import fanout, keyed, monitor, series

START = datetime(2024, 1, 1)


def test_a_listener_raises_each_alert(spark, tmp_path):
    cases = {"fine": (lambda i: True, lambda i: 10.0), "slow": (lambda i: True, lambda i: 11.0 if i == 7 else 1.0), "lossy": (lambda i: i % 50 > 0, lambda i: 1.0), "both": (lambda i: i > 30, lambda i: float(i))}
    found = monitor.Metrics(*cases)
    spark.streams.addListener(found)
    try:
        for name, (written, ms) in cases.items():
            for part in range(2):
                rows = [(written(i), ms(i)) for i in range(part * 50, part * 50 + 50)]
                spark.createDataFrame(rows, "written boolean, latency_ms double").coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{part}")
            source = spark.readStream.schema("written boolean, latency_ms double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
            query = monitor.observed(source, name).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            until = time.monotonic() + 30
            while found.sums.get(name, (0,))[0] < 100 and time.monotonic() < until:
                time.sleep(0.1)
            before = found.sums[name]
            for progress in query.recentProgress:  # told already: they count once
                found.add(progress)
            assert found.sums[name] == before
    finally:
        spark.streams.removeListener(found)
    table = {r.stream: r for r in monitor.alerts(found.table(spark)).collect()}
    assert {n: r.alerts for n, r in table.items()} == {"fine": "", "slow": "LATENCY", "lossy": "WRITE_RATE", "both": "LATENCY,WRITE_RATE"}
    assert (table["lossy"].total, table["lossy"].written, table["both"].max_ms, table["both"].mean_ms) == (100, 98, 99.0, 49.5)


def test_series_on_a_stream_equal_the_batch(spark, tmp_path):
    pick, rows = random.Random(2), []
    for s in ("a", "b"):
        rows += [(s, START + timedelta(hours=i), pick.randint(1, 400) / 8) for i in range(420)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    for part, hours in enumerate((0, 100, 101, 390)):
        end = (100, 101, 390, 420)[part]
        bars.filter(f"ts >= timestamp'2024-01-01' + interval '{hours}' hour and ts < timestamp'2024-01-01' + interval '{end}' hour").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    bars.limit(5).coalesce(1).write.parquet(f"{tmp_path}/in/9")  # old ones again
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with keyed.keyed_state(spark):
        query = series.indicators(source).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.symbol, r.ts): tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    want = indicators.ema(bars).withColumnRenamed("value", "ema").join(indicators.rsi(bars).withColumnRenamed("value", "rsi"), ["symbol", "ts"]).join(indicators.macd(bars), ["symbol", "ts"])
    assert got == {(r.symbol, r.ts): tuple(r)[2:] for r in want.collect()} and len(got) == 840


def test_subscribers_and_configured_signals(spark):
    bars = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "symbol string, n int")
    subs = spark.createDataFrame([("a", 1, 12, 1), ("a", 1, 11, 1), ("a", 1, 13, 0), ("a", 2, 21, 1), ("b", 2, 22, 0)], "symbol string, user_id int, config_id int, enabled int")
    assert sorted((r.symbol, r.user_id, list(r.configs)) for r in fanout.subscribers(bars, subs).collect()) == [("a", 1, [11, 12]), ("a", 2, [21])]
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, signal_key string").withColumn("payload", F.lit('{"action": "buy", "qty": "2"}'))
    configs = spark.createDataFrame([("x", 7, 1, 1), ("y", 8, 1, 0)], "signal_key string, signal_config_id int, user_id int, enabled int")
    assert sorted((r.i, r.direction, r.quantity, r.signal_config_id) for r in fanout.configured(rows, configs).collect()) == [(1, "LONG", 2.0, 7), (2, "LONG", 2.0, None), (3, "LONG", 2.0, None)]


def test_the_log_has_every_tick_as_it_came(spark, tmp_path):
    rows = [(i, START + timedelta(hours=i % 50), ("error", "view", None)[i % 3], float(i), f'{{"k": {i}}}' if i % 4 else "{}") for i in range(90)]
    spark.createDataFrame(rows + rows[:3], "event_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = [tuple(r) for r in streams.log_append(spark, str(tmp_path)).select("event_id", "symbol", "ts", "price", "volume").collect()]
    assert sorted(found, key=str) == sorted(((i, kind, ts, price, float(i) if i % 4 else None) for i, ts, kind, price, _ in rows + rows[:3]), key=str)
