"""Bars and checks on small tables with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.functions import timegrid
from candlewick.operators import checks, rollup, scan

START = datetime(2025, 1, 15, 10, 0)


def bars(spark, rows, symbol="BTC-USDT"):
    """rows: (minute, open, high, low, close, volume)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table = [(symbol, (START + timedelta(minutes=m)).isoformat(sep=" "), *map(float, x)) for m, *x in rows]
    return spark.createDataFrame(table, "symbol string, t string, open double, high double, low double, close double, volume double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")


@pytest.mark.parametrize(
    ("time", "tf", "start"),
    [("2025-01-15 10:03", "5m", "2025-01-15 10:00"), ("2025-01-15 10:07", "5m", "2025-01-15 10:05"), ("2025-01-15 10:05", "5m", "2025-01-15 10:05"), ("2025-01-15 10:17", "15m", "2025-01-15 10:15"), ("2025-01-15 10:30", "15m", "2025-01-15 10:30"), ("2025-01-15 10:33", "30m", "2025-01-15 10:30"), ("2025-01-15 10:45", "1h", "2025-01-15 10:00"), ("2025-01-15 11:00", "1h", "2025-01-15 11:00"), ("2025-01-15 14:30", "4h", "2025-01-15 12:00"), ("2025-01-15 04:00", "4h", "2025-01-15 04:00"), ("2025-01-16 00:03", "5m", "2025-01-16 00:00"), ("1969-12-31 23:58", "5m", "1969-12-31 23:55")],
)
def test_alignment(spark, time, tf, start):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = spark.range(1).select(F.date_format(timegrid.align(F.lit(time).cast("timestamp"), timegrid.TIMEFRAMES[tf]), "yyyy-MM-dd HH:mm")).first()[0]
    assert got == start


ONE, TWO, THREE = (0, 100, 105, 99, 103, 1000), (1, 103, 108, 102, 106, 1500), (2, 106, 107, 98, 104, 2000)


@pytest.mark.parametrize(("rows", "want"), [([ONE], (100, 105, 99, 103, 1000, 1)), ([TWO, ONE], (100, 108, 99, 106, 2500, 2)), ([THREE, ONE, TWO], (100, 108, 98, 104, 4500, 3))])
def test_ohlcv(spark, rows, want):
    got = rollup.rollup(bars(spark, rows), {"5m": 300_000}).collect()
    assert [tuple(r)[3:9] for r in got] == [want] and not got[0].is_complete


def test_completeness_and_no_bars(spark):
    rows = [(m, 1, 2, 1, 2, 3) for m in (0, 1, 2, 3, 4, 6, 7, 8, 9)]
    found = {r.ts.minute: r.is_complete for r in rollup.rollup(bars(spark, rows), {"5m": 300_000}).collect()}
    assert found == {0: True, 5: False}
    assert rollup.rollup(bars(spark, rows).limit(0)).collect() == []


def test_rollup_of_rollup_is_the_rollup(spark):
    table = bars(spark, [(m * 3, m % 7, m % 7 + 2, m % 7 - 1, m % 5, m) for m in range(200)])
    direct = rollup.rollup(table).drop("is_complete")
    for tf, found in rollup.cascade(table).items():
        a = sorted(map(str, found.select("symbol", "ts", *rollup.OHLCV, "source_count").collect()))
        assert a == sorted(map(str, direct.filter(F.col("tf") == tf).select("symbol", "ts", *rollup.OHLCV, "source_count").collect()))
    sums = direct.groupBy("tf").agg(F.sum("volume")).collect()
    assert len({r[1] for r in sums}) == 1
    assert direct.filter("low > open or low > close or high < open or high < close").count() == direct.filter("low > least(open, close) or high < greatest(open, close)").count()


def test_duplicates_count_once(spark):
    table = bars(spark, [ONE, ONE, TWO])
    assert rollup.rollup(rollup.deduplicated(table), {"5m": 300_000}).first().source_count == 2
    assert checks.duplicates(table).first().n == 2


def test_ranges(spark):
    table = bars(spark, [(m, 1, 1, 1, m, 1) for m in range(20)])
    closes = lambda **k: [r.close for r in scan.bar_range(table, "BTC-USDT", **k).collect()]
    assert closes(begin="2025-01-15 10:05:00", end="2025-01-15 10:08:00") == [5, 6, 7]
    assert closes(begin="2025-01-15 10:05:00", limit=2) == [5, 6] and closes(limit=2) == [18, 19] and len(closes(limit=0)) == 20
    assert closes(limit=10**9) == list(range(20)) and scan.bar_range(table, "none").collect() == []


def test_gaps_and_existing_make_the_grid(spark):
    table = bars(spark, [(m, 1, 1, 1, 1, 1) for m in (0, 2, 3, 9)])
    lost = {r.ts.minute for r in checks.gaps(table, "2025-01-15 10:00:00", "2025-01-15 10:10:00").collect()}
    assert lost == {1, 4, 5, 6, 7, 8}


def test_data_errors(spark):
    wrong = [(0, -1, 5, -2, 3, 1), (1, 1, 2, 3, 1, 1), (2, 1, 2, 1, 1, -1), (3, 1, 2e6, 1, 1, 1), (4, 1, 2, 1, 1, 1)]
    found = [r[0] for r in bars(spark, wrong).orderBy("ts").select(checks.data_errors()).collect()]
    assert found == ["NEGATIVE_PRICE", "HIGH_LESS_THAN_LOW,LOW_INVALID", "NEGATIVE_VOLUME", "PRICE_TOO_HIGH", ""]


def test_cooldown(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.createDataFrame([("a", s) for s in (0, 299, 300, 301, 599, 600)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r[0] for r in checks.cooldown(rows).select(F.unix_seconds("ts")).collect()) == [0, 300, 600]


def test_intervals():
    assert timegrid.duration_ms("15m") == 900_000 and timegrid.duration_ms("1W") == 604_800_000
    for bad in ("", "m", "0m", "5x", "5"):
        with pytest.raises(ValueError):
            timegrid.duration_ms(bad)
    with pytest.raises(ValueError):
        timegrid.supported("2m")


def test_bars_of_other_intervals_are_ignored(spark):
    from candlewick.operators import rollup

    rows = spark.createDataFrame([("a", 0, "1m"), ("a", 60, "1m"), ("a", 120, "5m")], "symbol string, s long, interval string")
    bars = rows.selectExpr("symbol", "timestamp_seconds(s) AS ts", "1D AS open", "1D AS high", "1D AS low", "1D AS close", "1D AS volume", "interval")
    assert [r.source_count for r in rollup.rollup(bars, {"5m": 300_000}).collect()] == [2]


def test_malformed_candles_go(spark):
    from candlewick.sources import exchange

    good = '["60000","1","3","0.5","2","7","0","0","1"]'
    text = ['{"arg":{"instId":"X"},"data":[%s]}' % c for c in (good, good.replace('"1","3"', '"","3"'), good.replace('"60000"', '"soon"'), good.replace('"2","7"', '"NaN?","7"'))]
    rows = spark.createDataFrame([(t,) for t in text], "message string").selectExpr("message", "timestamp_seconds(90) AS received")
    assert [(r.symbol, r.close) for r in exchange.candles(rows).collect()] == [("X", 2.0)]
