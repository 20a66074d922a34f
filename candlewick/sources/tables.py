"""The tables as market data: events are ticks, ticks make one-minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.timegrid import align


def in_utc(df: DataFrame) -> DataFrame:
    """Timestamps without a zone as instants in UTC."""
    df.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its timestamps as instants in UTC."""
    return in_utc(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def as_ticks(events: DataFrame) -> DataFrame:
    """(event_id, symbol, ts, price, volume) from events, of a table or a stream; a volume that doesn't parse is null."""
    volume = F.get_json_object("props", "$.k").try_cast("double")
    return events.select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), volume.alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks."""
    return as_ticks(table(spark, sf_dir, "events"))


def minute_bars(ticks_: DataFrame) -> DataFrame:
    """One-minute bars (symbol, ts, open, high, low, close, volume) of ticks, in event time."""
    bucket = align(F.col("ts"), 60_000).alias("minute")
    bars = ticks_.groupBy("symbol", bucket).agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.withColumnRenamed("minute", "ts")


def bars_1m(spark: SparkSession, sf_dir: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """One-minute bars of all symbols; those of whole minutes from ``begin`` to before ``end`` need ticks of that time alone, which the scan then reads."""
    found = ticks(spark, sf_dir)
    if begin is not None:
        found = found.filter(F.col("ts") >= F.lit(begin).cast("timestamp"))
    if end is not None:
        found = found.filter(F.col("ts") < F.lit(end).cast("timestamp"))
    return minute_bars(found)
