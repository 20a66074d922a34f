"""Bars, prices and stores on streams: watermarks instead of clocks, keyed state, sinks that write a key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.timegrid import TIMEFRAMES
from candlewick.operators.signals import fresh


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark; replayed rows go. The state of old keys is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed(ticks: DataFrame, tf: str = "5m", delay: str = "10 minutes", watermarked: bool = False) -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume, source_count) of a stream of ticks, each written when its window closes."""
    rows = ticks if watermarked else ticks.withWatermark("ts", delay)
    span = F.window("ts", f"{TIMEFRAMES[tf] // 1000} seconds")
    bars = rows.groupBy("symbol", span.alias("w")).agg(F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("volume").alias("volume"), F.count("*").cast("int").alias("source_count"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "source_count")


def seen(ticks: DataFrame, minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Ticks in each sliding window of ``minutes`` that moves by a minute: fewer than expected is a gap."""
    w = F.window("ts", f"{minutes} minutes", "1 minute")
    rows = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    return rows.groupBy("symbol", w.alias("w")).agg(F.count("*").alias("seen")).select("symbol", F.col("w.end").alias("ts"), "seen")


def latest_price(ticks: DataFrame) -> DataFrame:
    """Each symbol's latest price (update mode): later ticks win, of equal times the later arrival."""
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


def insert_if_absent(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append the rows whose key the Parquet table at ``path`` lacks; a repeated batch adds nothing.

    One stream alone may write the table, and each batch reads its keys: ``sources.store`` has one for many streams, by day.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        rows = fresh(batch, spark.read.schema(batch.schema).parquet(path), keys) if there else batch.dropDuplicates(keys)
        rows.write.mode("append").parquet(path)

    return write
