"""Rollups of one-minute bars: one pass for all timeframes, completeness, reports, day statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.timegrid import TIMEFRAMES, align, grid, plus_ms

OHLCV = ("open", "high", "low", "close", "volume")


def deduplicated(bars: DataFrame) -> DataFrame:
    """One row for each (symbol, ts); bars that repeat a minute count once."""
    return bars.dropDuplicates(["symbol", "ts"])


def aggregates(ts: str = "ts") -> list[Column]:
    """Open of the first bar, high, low, close of the last, volume, and at last the count; all have partial sums."""
    return [F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"), F.count("*").cast("int").alias("source_count")]


def rollup(bars: DataFrame, timeframes: dict[str, int] = TIMEFRAMES) -> DataFrame:
    """(symbol, tf, ts, open, high, low, close, volume, source_count, is_complete) of one-minute bars.

    Each bar goes to a window of every timeframe; windows without a bar give no row. A window is complete if it
    has a bar for each minute, its first and last among them. Where bars say their ``interval``, those of others than 1m
    are ignored.
    """
    if "interval" in bars.columns:
        bars = bars.filter("interval = '1m'")
    kinds = F.array(*(F.struct(F.lit(k).alias("tf"), F.lit(v).cast("long").alias("ms")) for k, v in timeframes.items()))
    rows = bars.select("symbol", "ts", *OHLCV, F.explode(kinds).alias("k")).select("symbol", "ts", *OHLCV, "k.tf", "k.ms")
    rows = rows.withColumn("start", align(F.col("ts"), F.col("ms")))
    grouped = rows.groupBy("symbol", "tf", "ms", "start").agg(*aggregates(), F.max((F.col("ts") == F.col("start")).cast("int")).alias("first"), F.max((F.col("ts") == plus_ms(F.col("start"), F.col("ms") - 60_000)).cast("int")).alias("last"))
    complete = (F.col("source_count") == F.col("ms") / 60_000) & (F.col("first") == 1) & (F.col("last") == 1)
    return grouped.select("symbol", "tf", F.col("start").alias("ts"), *OHLCV, "source_count", complete.alias("is_complete"))


def cascade(bars: DataFrame, timeframes: dict[str, int] = TIMEFRAMES) -> dict[str, DataFrame]:
    """The same rollups, each from the one below it: for callers that want single timeframes, or all at great volume."""
    out, below = {}, bars.withColumn("source_count", F.lit(1))
    for tf, ms in timeframes.items():
        start = align(F.col("ts"), ms).alias("start")
        *prices, _ = aggregates()
        below = below.groupBy("symbol", start).agg(*prices, F.sum("source_count").cast("int").alias("source_count")).withColumnRenamed("start", "ts")
        out[tf] = below
    return out


def completeness(bars: DataFrame, tf: str) -> DataFrame:
    """(symbol, ts, source_count, expected, has_first, has_last, is_complete) for the windows of one timeframe."""
    ms = TIMEFRAMES[tf]
    start = align(F.col("ts"), ms)
    grouped = bars.withColumn("start", start).groupBy("symbol", "start").agg(F.count("*").cast("int").alias("source_count"), F.max(F.col("ts") == F.col("start")).alias("has_first"), F.max(F.col("ts") == plus_ms(F.col("start"), ms - 60_000)).alias("has_last"))
    return grouped.select("symbol", F.col("start").alias("ts"), "source_count", F.lit(ms // 60_000).alias("expected"), "has_first", "has_last", ((F.col("source_count") == ms // 60_000) & F.col("has_first") & F.col("has_last")).alias("is_complete"))


def save_report(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(tf, generated, saved, skipped): of ``fresh`` rollups, how many are in ``stored`` already."""
    keys = stored.select("symbol", "tf", "ts").distinct().withColumn("there", F.lit(1))
    met = fresh.join(keys, ["symbol", "tf", "ts"], "left")
    return met.groupBy("tf").agg(F.count("*").alias("generated"), F.count_if(F.col("there").isNull()).alias("saved"), F.count("there").alias("skipped"))


def missing_windows(bars: DataFrame, stored: DataFrame, tf: str) -> DataFrame:
    """(symbol, ts): windows of ``tf`` between a symbol's first and last bar that ``stored`` (symbol, ts) lacks."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spans = ends.select("symbol", F.explode(grid(F.col("lo"), plus_ms(F.col("hi"), 1), TIMEFRAMES[tf])).alias("ts"))
    return spans.join(stored, ["symbol", "ts"], "left_anti")


def backfill(bars: DataFrame, stored: DataFrame, tf: str) -> DataFrame:
    """Rollups for the windows that ``stored`` lacks and bars exist for."""
    whole = rollup(bars, {tf: TIMEFRAMES[tf]})
    return whole.join(missing_windows(bars, stored, tf), ["symbol", "ts"], "left_semi")


def day_stats(bars: DataFrame, day: str) -> DataFrame:
    """(symbol, price, high, low, volume, change_pct) for the UTC day; without bars that day, the latest close and zeros."""
    begin = F.lit(day).cast("timestamp")
    today = bars.filter((F.col("ts") >= begin) & (F.col("ts") < plus_ms(begin, 86_400_000))).groupBy("symbol").agg(*aggregates())
    latest = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("latest"))
    change = F.when(F.col("open") == 0, F.lit(0.0)).otherwise((F.col("close") - F.col("open")) / F.col("open") * 100)
    met = latest.join(today, "symbol", "left")
    return met.select("symbol", *(F.coalesce(c, "latest").alias(n) for c, n in (("close", "price"), ("high", "high"), ("low", "low"))), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.round(F.coalesce(change, F.lit(0.0)), 8).alias("change_pct"))
