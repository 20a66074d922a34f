"""Indicators on streams of bars: each symbol's last bars are keyed state, and each new bar gives its values."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlewick.operators.indicators import FRAME, SCALE

_VALUES = "ema double, up double, down double, fast double, slow double, signal double"


def folded(closes: list[float], ema: int, rsi: int, fast: int, slow: int, signal: int) -> tuple[float, ...]:
    """The recursive averages over a frame of closes, from its oldest on, in the order in which ``indicators`` folds."""
    e = f = s = closes[0]
    up = down = g = 0.0
    a, w, k, m, n = 2.0 / (ema + 1), 1.0 / rsi, 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    before = closes[0]
    for c in closes[1:]:
        change = c - before
        before = c
        e = e + a * (c - e)
        up = up + w * (max(change, 0.0) - up)
        down = down + w * (max(-change, 0.0) - down)
        f, s = f + k * (c - f), s + m * (c - s)
        g = g + n * (f - s - g)
    return e, up, down, f, s, g


class Series(StatefulProcessor):
    """The last FRAME closes of a symbol. Bars of a micro-batch are taken in order; one not after the last is passed over."""

    def __init__(self, periods: dict[str, int]):
        self.periods = periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        pair = T.StructType([T.StructField("us", T.LongType()), T.StructField("close", T.DoubleType())])
        self.bars = handle.getListState("bars", pair)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = [(b[0], b[1]) for b in self.bars.get()]
        for row in sorted(rows, key=lambda r: r["_us"]):
            if held and row["_us"] <= held[-1][0]:
                continue
            held = [*held[-(FRAME - 1) :], (row["_us"], row["close"])]
            ema, up, down, fast, slow, signal = folded([c for _, c in held], **self.periods)
            yield Row(symbol=key[0], us=row["_us"], ema=ema, up=up, down=down, fast=fast, slow=slow, signal=signal)
        self.bars.put(held)

    def close(self) -> None:
        pass


def indicators(bars: DataFrame, ema: int = 20, rsi: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(symbol, ts, ema, rsi, macd, signal, histogram) of a stream of closed bars (symbol, ts, close): the batch's values, as each bar closes.

    Needs ``keyed.keyed_state`` when the stream is started.
    """
    rows = bars.select("symbol", F.unix_micros("ts").alias("_us"), "close")
    periods = {"ema": ema, "rsi": rsi, "fast": fast, "slow": slow, "signal": signal}
    found = rows.groupBy("symbol").transformWithState(Series(periods), f"symbol string, us long, {_VALUES}", "append", "none")
    rounded = lambda c: F.round(c, SCALE)
    line, up, down = F.col("fast") - F.col("slow"), F.col("up"), F.col("down")
    strength: Column = F.when(down == 0, F.when(up == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(100.0 - 100.0 / (1.0 + up / down))
    return found.select("symbol", F.timestamp_micros("us").alias("ts"), rounded("ema").alias("ema"), rounded(strength).alias("rsi"), rounded(line).alias("macd"), rounded("signal").alias("signal"), rounded(line - F.col("signal")).alias("histogram"))
