"""Time: timeframes, alignment to the epoch in UTC, and grids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE = 60_000
#: Milliseconds of the timeframes that one-minute bars are rolled up to.
TIMEFRAMES = {"5m": 5 * MINUTE, "15m": 15 * MINUTE, "30m": 30 * MINUTE, "1h": 60 * MINUTE, "4h": 240 * MINUTE}
_UNITS = {"m": MINUTE, "h": 60 * MINUTE, "d": 1440 * MINUTE, "w": 7 * 1440 * MINUTE}


def duration_ms(interval: str) -> int:
    """Milliseconds of ``<n><unit>`` with unit m, h, d or w; anything else is an error."""
    match = re.fullmatch(r"([1-9]\d*)([mhdw])", interval.strip().lower())
    if not match:
        raise ValueError(f"unknown interval {interval!r}")
    return int(match[1]) * _UNITS[match[2]]


def supported(interval: str) -> str:
    """The interval, if it is 1m or one of TIMEFRAMES."""
    if interval != "1m" and interval not in TIMEFRAMES:
        raise ValueError(f"unsupported interval {interval!r}")
    return interval


def align(ts: Column, ms: Column | int) -> Column:
    """The start of the window of ``ms`` milliseconds that ``ts`` lies in."""
    size = (F.lit(ms) if isinstance(ms, int) else ms).cast("long") * 1000
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, size))


def plus_ms(ts: Column, ms: Column | int) -> Column:
    """``ts`` moved by milliseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + (F.lit(ms) if isinstance(ms, int) else ms).cast("long") * 1000)


def grid(start: Column, end: Column, ms: int) -> Column:
    """All window starts from ``start`` (aligned) to before ``end``, as an array."""
    first = F.unix_millis(align(start, ms))
    last = F.unix_millis(end) - 1
    steps = F.when(last >= first, F.sequence(first, last, F.lit(ms).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda x: F.timestamp_millis(x))


def local_time(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """A UTC time as local text."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema))
