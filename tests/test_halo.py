"""Windows in chunks with a halo give what windows by symbol give, in many tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewick.operators import checks, halo, indicators, scan

HOUR = 3_600_000
NAMES = "sma sma_strict ema wma rsi atr bollinger macd stochastic stochastic_smoothed momentum".split()


@pytest.fixture(scope="module")
def bars(spark):
    """Hourly bars of two symbols, with gaps of hours and of weeks."""
    pick, rows = random.Random(4), []
    for symbol in ("a", "b"):
        at = datetime(2024, 1, 1)
        for _ in range(900):
            at += timedelta(hours=1 if pick.random() < 0.97 else pick.choice((2, 5, 700)))
            o, c = pick.randint(10, 99) / 4, pick.randint(10, 99) / 4
            rows.append((symbol, at, o, max(o, c) + 1, min(o, c) - 1, c, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double").cache()


@pytest.mark.parametrize("name", NAMES)
def test_indicators_in_chunks_equal_whole_ones(bars, name):
    f = getattr(indicators, name)
    whole = sorted(map(tuple, f.__wrapped__(bars).collect()))
    for span in (30 * HOUR, 400 * HOUR):
        assert sorted(map(tuple, f(bars, span_ms=span).collect())) == whole


def test_one_symbol_uses_many_tasks(spark, bars):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tasks = lambda rows: len({r.task for r in rows.select("value", F.spark_partition_id().alias("task")).collect()})
        one = bars.filter("symbol = 'a'")
        found, alone = tasks(indicators.ema(one, span_ms=60 * HOUR)), tasks(indicators.ema.__wrapped__(one))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert alone == 1 and found >= 6


def test_halo_copies_the_rows_before_and_no_more(spark):
    rows = spark.createDataFrame([("s", i, i // 10 * 2 if i < 40 else 99) for i in range(60)], "symbol string, i int, c int")
    found = halo.with_rows_before(rows, ("symbol",), F.col("c"), "i", 12)
    parts = {}
    for r in found.collect():
        parts.setdefault(r[halo.PART], []).append(r.i)
    want = {0: range(10), 2: range(20), 4: range(8, 30), 6: range(18, 40), 99: range(28, 60)}
    assert {k: sorted(v) for k, v in parts.items()} == {k: list(v) for k, v in want.items()}


def test_steps_order_and_continuity_in_chunks(spark, bars):
    spans = [scan.step_anomalies(bars, HOUR, span_ms=s) for s in (7 * HOUR, 10**15)]
    assert sorted(map(tuple, spans[0].collect())) == sorted(map(tuple, spans[1].collect()))
    rows = bars.withColumn("seq", F.pmod(F.xxhash64("symbol", "ts"), F.lit(10**12)))
    late = lambda places: sorted((r.symbol, r.ts) for r in checks.out_of_order(rows, "seq", places).collect())
    order = Window.partitionBy("symbol").orderBy("seq")
    plain = rows.withColumn("previous", F.lag("ts").over(order)).filter("ts < previous")
    assert late(10**10) == sorted((r.symbol, r.ts) for r in plain.collect())
    seen = lambda span: sorted(map(tuple, checks.continuity(bars, 600, span).collect()))
    assert seen(5 * HOUR) == seen(10**15)
