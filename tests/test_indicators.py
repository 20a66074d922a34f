"""Indicators against values worked out by plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from candlewick.operators import indicators as ind

CLOSES = [10.0, 11.0, 12.5, 11.5, 11.5, 13.0, 12.0, 12.75]


def series(spark, closes=CLOSES):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [("s", i * 60, c - 0.5, c + 1, c - 1, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def got(df, column="value"):
    return [r[column] for r in df.orderBy("ts").collect()]


def smoothed(values, a, first):
    out = [first]
    for v in values[1:]:
        out.append(out[-1] + a * (v - out[-1]))
    return out


def near(a, b):
    assert a == pytest.approx(b, abs=1e-8)


def test_averages(spark):
    s = series(spark)
    near(got(ind.sma(s, period=3)), [sum(CLOSES[max(0, i - 2) : i + 1]) / min(3, i + 1) for i in range(8)])
    assert got(ind.sma_strict(s, period=3))[:2] == [None, None]
    near(got(ind.sma_strict(s, period=3))[2:], [sum(CLOSES[i - 2 : i + 1]) / 3 for i in range(2, 8)])
    near(got(ind.ema(s, period=3)), smoothed(CLOSES, 0.5, CLOSES[0]))
    want = [sum((j + 1) * v for j, v in enumerate(w)) / (len(w) * (len(w) + 1) / 2) for w in (CLOSES[max(0, i - 2) : i + 1] for i in range(8))]
    near(got(ind.wma(s, period=3)), want)


def test_rsi_and_atr(spark):
    s = series(spark)
    up = smoothed([0.0] + [max(b - a, 0) for a, b in zip(CLOSES, CLOSES[1:])], 1 / 3, 0.0)
    down = smoothed([0.0] + [max(a - b, 0) for a, b in zip(CLOSES, CLOSES[1:])], 1 / 3, 0.0)
    near(got(ind.rsi(s, period=3)), [(0.0 if u == 0 else 100.0) if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down)])
    true = [2.0] + [max(2.0, abs(b + 1 - a), abs(b - 1 - a)) for a, b in zip(CLOSES, CLOSES[1:])]
    near(got(ind.atr(s, period=3)), smoothed(true, 1 / 3, 2.0))
    assert got(ind.rsi(series(spark, [5.0] * 4)))[-1] == 0.0


def test_bands_macd_stochastic_momentum(spark):
    s = series(spark)
    window = CLOSES[-4:]
    mean = sum(window) / 4
    deviation = math.sqrt(sum((v - mean) ** 2 for v in window) / 4)
    last = ind.bollinger(s, period=4, deviation=2.0).orderBy(F.desc("ts")).first()
    near([last.upper, last.middle, last.lower], [mean + 2 * deviation, mean, mean - 2 * deviation])
    line = [a - b for a, b in zip(smoothed(CLOSES, 2 / 3, CLOSES[0]), smoothed(CLOSES, 2 / 6, CLOSES[0]))]
    rows = ind.macd(s, fast=2, slow=5, signal=3)
    near(got(rows, "macd"), line)
    near(got(rows, "signal"), smoothed(line, 0.5, 0.0))
    low, high = min(CLOSES[-3:]) - 1, max(CLOSES[-3:]) + 1
    k = ind.stochastic(s, period=3).orderBy(F.desc("ts")).first()
    near([k.k, k.d], [(CLOSES[-1] - low) / (high - low) * 100] * 2)
    near(got(ind.momentum(s, period=3)), [(c - CLOSES[max(0, i - 3)]) / CLOSES[max(0, i - 3)] * 100 for i, c in enumerate(CLOSES)])


def test_frame_is_cut(spark):
    closes = [100.0 + (i * 37 % 11) for i in range(380)]
    near(got(ind.ema(series(spark, closes), period=300))[-1], smoothed(closes[-365:], 2 / 301, closes[-365])[-1])


def test_values_and_fingerprint(spark):
    s = series(spark)
    one = ind.values(s, "SMA", period="3").first()
    assert one.value is not None and one.extra_values is None
    more = ind.values(s, "BOLL").first()
    assert more.value is None and set(more.extra_values) == {"upper", "middle", "lower"}
    assert ind.values(s, "KDJ").first().value is None and ind.parameters("BOLL", {"period": "x", "deviation": "3"}) == {"period": 20, "deviation": 3.0}
    make = lambda *kv: ind.fingerprint(F.lit("RSI"), F.lit("v1"), F.create_map(*map(F.lit, kv)), F.lit("e"))
    a, b, c = spark.range(1).select(make("b", "2", "a", "1"), make("a", "1", "b", "2"), F.sha2(F.lit("RSI:v1:a=1,b=2:e"), 256)).first()
    assert a == b == c


def test_registry_names():
    assert ind.parameters("MACD", {"shortPeriod": "5", "longPeriod": 10, "signalPeriod": "3.5"}) == {"shortPeriod": 5, "longPeriod": 10, "signalPeriod": 9}
    assert ind.parameters("Stochastic", {"kPeriod": "x", "dPeriod": None}) == {"kPeriod": 14, "dPeriod": 3}
    assert ind.parameters("BOLL", {"deviation": "2.5"}) == {"period": 20, "deviation": 2.5}


def test_registry_keys(spark):
    bars = spark.createDataFrame([("a", i, 1.0 * i, 2.0 * i + 1, 0.5 * i, 1.5 * i, 1.0) for i in range(8)], "symbol string, ts int, open double, high double, low double, close double, volume double")
    last = lambda *a, **b: ind.values(bars, *a, **b).orderBy(ind.F.desc("ts")).first()
    assert last("Stochastic", kPeriod=3).extra_values["k"] is not None and last("Momentum", period=2).value is not None
    assert last("SMA", period=4).value == last("SMA", engine="custom", period=4).value and last("SMA", engine="custom").value is None
    for odd in ({"code": "STOCH"}, {"code": "SMA", "version": "v2"}, {"code": "SMA", "engine": "none"}, {"code": "KDJ"}):
        row = last(**odd)
        assert row.value is None and row.extra_values is None
