"""Technical indicators of each bar, over the bars up to it: column expressions alone, no Python on rows.

Frames are a symbol's last 365 bars. Moving indicators take fewer bars at a series' head; recursive ones start at
the frame's oldest bar. Outputs are rounded half up to 8 decimals. A symbol's bars are computed in chunks of time
(``span_ms``), each with the bars before it that its frames need.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.operators import halo

FRAME = 365
SCALE = 8


def _order(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def _tail(keys: tuple[str, ...], n: int) -> WindowSpec:
    return _order(keys).rowsBetween(-(n - 1), 0)


def _rounded(c: Column) -> Column:
    return F.round(c, SCALE)


def _rows(bars: DataFrame, keys: tuple[str, ...], **values: Column) -> DataFrame:
    return bars.select(*keys, "ts", *(c.alias(k) for k, c in values.items()))


def in_chunks(compute: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An indicator whose frames stay within FRAME bars, computed for each chunk of time with its halo."""

    @wraps(compute)
    def run(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), span_ms: int = halo.SPAN_MS, **parameters: float) -> DataFrame:
        return halo.windowed(bars, lambda rows, by: compute(rows, by, **parameters), keys, FRAME - 1, span_ms)

    return run


@in_chunks
def sma(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 20) -> DataFrame:
    """Simple moving average of closes."""
    return _rows(bars, keys, value=_rounded(F.avg("close").over(_tail(keys, min(period, FRAME)))))


@in_chunks
def sma_strict(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 20) -> DataFrame:
    """Moving average of exactly ``period`` closes, in exact decimals; fewer bars give no value."""
    return _rows(bars, keys, value=strict_average(keys, period))


def strict_average(keys: tuple[str, ...] = ("symbol",), period: int = 20) -> Column:
    """The value of ``sma_strict`` as a column beside a bar's others."""
    frame = _tail(keys, period)
    exact = F.sum(F.col("close").cast("decimal(20,8)")).over(frame) / F.lit(period)
    return F.when(F.count("*").over(frame) >= period, F.round(exact, SCALE).cast("double"))


def _folded(bars: DataFrame, keys: tuple[str, ...], values: Column) -> DataFrame:
    """Bars with ``frame``: the values of the last FRAME bars, oldest first."""
    return bars.withColumn("_v", values).withColumn("frame", F.collect_list("_v").over(_tail(keys, FRAME)))


def _ema(frame: Column, alpha: float) -> Column:
    """Exponential average of a frame, from its oldest value on."""
    return F.aggregate(F.slice(frame, 2, FRAME), F.element_at(frame, 1), lambda acc, v: acc + F.lit(alpha) * (v - acc))


@in_chunks
def ema(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 20) -> DataFrame:
    """Exponential moving average of closes, weight 2 / (period + 1)."""
    rows = _folded(bars, keys, F.col("close"))
    return _rows(rows, keys, value=_rounded(_ema(F.col("frame"), 2.0 / (period + 1))))


@in_chunks
def wma(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 20) -> DataFrame:
    """Linearly weighted moving average of closes; the newest weighs most."""
    n = min(period, FRAME)
    rows = bars.withColumn("frame", F.collect_list("close").over(_tail(keys, n)))
    k = F.size("frame")
    weighted = F.aggregate(F.zip_with("frame", F.sequence(F.lit(1), k), lambda v, i: v * i), F.lit(0.0), lambda acc, v: acc + v)
    return _rows(rows, keys, value=_rounded(weighted * 2 / (k * (k + 1))))


@in_chunks
def rsi(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 14) -> DataFrame:
    """Relative strength index with Wilder's averages; without losses 100, or 0 if there are no gains either."""
    change = F.col("close") - F.lag("close").over(_order(keys))
    both = F.struct(F.greatest(F.coalesce(change, F.lit(0.0)), F.lit(0.0)).alias("up"), F.greatest(-F.coalesce(change, F.lit(0.0)), F.lit(0.0)).alias("down"))
    rows = _folded(bars, keys, both)
    # the frame's oldest bar has no change of its own
    first = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    a = F.lit(1.0 / period)
    step = lambda acc, v: F.struct((acc["up"] + a * (v["up"] - acc["up"])).alias("up"), (acc["down"] + a * (v["down"] - acc["down"])).alias("down"))
    rows = rows.withColumn("w", F.aggregate(F.slice("frame", 2, FRAME), first, step))
    value = F.when(F.col("w.down") == 0, F.when(F.col("w.up") == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(100.0 - 100.0 / (1.0 + F.col("w.up") / F.col("w.down")))
    return _rows(rows, keys, value=_rounded(value))


@in_chunks
def atr(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 14) -> DataFrame:
    """Average true range with Wilder's average."""
    previous = F.lag("close").over(_order(keys))
    true = F.struct((F.col("high") - F.col("low")).alias("own"), F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)), F.col("high") - F.col("low")).alias("full"))
    rows = _folded(bars, keys, true)
    value = F.aggregate(F.slice("frame", 2, FRAME), F.element_at("frame", 1)["own"], lambda acc, v: acc + F.lit(1.0 / period) * (v["full"] - acc))
    return _rows(rows, keys, value=_rounded(value))


@in_chunks
def bollinger(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 20, deviation: float = 2.0) -> DataFrame:
    """Moving average and bands ``deviation`` population deviations around it."""
    frame = _tail(keys, min(period, FRAME))
    middle, width = F.avg("close").over(frame), F.stddev_pop("close").over(frame) * deviation
    return _rows(bars, keys, upper=_rounded(middle + width), middle=_rounded(middle), lower=_rounded(middle - width))


@in_chunks
def macd(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two exponential averages, its own average, and their difference: one fold for all."""
    rows = _folded(bars, keys, F.col("close"))
    f, s, g = (2.0 / (n + 1) for n in (fast, slow, signal))
    first = F.struct(F.element_at("frame", 1).alias("f"), F.element_at("frame", 1).alias("s"), F.lit(0.0).alias("g"))

    def step(acc: Column, v: Column) -> Column:
        a, b = acc["f"] + F.lit(f) * (v - acc["f"]), acc["s"] + F.lit(s) * (v - acc["s"])
        return F.struct(a.alias("f"), b.alias("s"), (acc["g"] + F.lit(g) * (a - b - acc["g"])).alias("g"))

    rows = rows.withColumn("w", F.aggregate(F.slice("frame", 2, FRAME), first, step))
    line = F.col("w.f") - F.col("w.s")
    return _rows(rows, keys, macd=_rounded(line), signal=_rounded(F.col("w.g")), histogram=_rounded(line - F.col("w.g")))


@in_chunks
def stochastic(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 14) -> DataFrame:
    """Place of the close between lowest low and highest high; d is k, as the declared operator gives it."""
    frame = _tail(keys, min(period, FRAME))
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    k = F.when(high != low, _rounded((F.col("close") - low) / (high - low) * 100))
    return _rows(bars, keys, k=k, d=k)


@in_chunks
def stochastic_smoothed(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 14, smooth: int = 3) -> DataFrame:
    """The stochastic with d as the average of the last ``smooth`` k, null before there are as many: an extension."""
    rows, frame = stochastic.__wrapped__(bars, keys, period), _tail(keys, smooth)
    return rows.select(*keys, "ts", "k", F.when(F.count("k").over(frame) == smooth, _rounded(F.avg("k").over(frame))).alias("d"))


@in_chunks
def momentum(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), period: int = 10) -> DataFrame:
    """Rate of change in per cent against ``period`` bars before, or the oldest bar at a series' head."""
    then = F.first("close").over(_tail(keys, min(period + 1, FRAME)))
    return _rows(bars, keys, value=F.when(then != 0, _rounded((F.col("close") - then) / then * 100)))


class Definition(NamedTuple):
    """An indicator as it can be asked for: its function, outputs, default parameters, and the function's names for them."""

    compute: Callable[..., DataFrame] | None
    outputs: tuple[str, ...]
    defaults: dict[str, float]
    names: dict[str, str] = {}


_PERIOD = lambda n: {"period": n}
#: Codes, version, outputs and parameters as they are asked for. KDJ is declared but has no computation.
DEFINITIONS: dict[tuple[str, str], Definition] = {
    ("SMA", "v1"): Definition(sma, ("value",), _PERIOD(20)),
    ("EMA", "v1"): Definition(ema, ("value",), _PERIOD(20)),
    ("WMA", "v1"): Definition(wma, ("value",), _PERIOD(20)),
    ("RSI", "v1"): Definition(rsi, ("value",), _PERIOD(14)),
    ("Stochastic", "v1"): Definition(stochastic, ("k", "d"), {"kPeriod": 14, "dPeriod": 3}, {"kPeriod": "period"}),
    ("Momentum", "v1"): Definition(momentum, ("value",), _PERIOD(10)),
    ("ATR", "v1"): Definition(atr, ("value",), _PERIOD(14)),
    ("BOLL", "v1"): Definition(bollinger, ("upper", "middle", "lower"), {"period": 20, "deviation": 2.0}),
    ("MACD", "v1"): Definition(macd, ("macd", "signal", "histogram"), {"shortPeriod": 12, "longPeriod": 26, "signalPeriod": 9}, {"shortPeriod": "fast", "longPeriod": "slow", "signalPeriod": "signal"}),
    ("KDJ", "v1"): Definition(None, ("k", "d", "j"), {"period": 9, "kPeriod": 3, "dPeriod": 3}),
}
#: Engines by name; ``custom`` has an average of its own.
ENGINES: dict[str, dict[tuple[str, str], Definition]] = {
    "ta4j": DEFINITIONS,
    "custom": {("SMA", "v1"): Definition(sma_strict, ("value",), _PERIOD(20))},
}


def parameters(code: str, given: Mapping[str, object], version: str = "v1", engine: str = "ta4j") -> dict[str, float]:
    """A definition's parameters: numbers or their text; what doesn't parse, or is missing, has its default. Whole ones take no text with a fraction."""
    out = {}
    for name, default in ENGINES[engine][code, version].defaults.items():
        value = given.get(name)
        try:
            out[name] = (int(value) if isinstance(default, int) else float(value)) if value is not None else default  # type: ignore[call-overload]
        except (TypeError, ValueError, OverflowError):
            out[name] = default
    return out


def values(bars: DataFrame, code: str, keys: tuple[str, ...] = ("symbol",), version: str = "v1", engine: str = "ta4j", **given: object) -> DataFrame:
    """(keys, ts, code, value, extra_values): one output goes to value, more to a map by name.

    An engine, code or version that isn't registered, or has no computation, gives neither.
    """
    d = ENGINES.get(engine, {}).get((code, version))
    none = F.lit(None).cast("double").alias("value"), F.lit(None).cast("map<string,double>").alias("extra_values")
    if d is None or d.compute is None:
        return bars.select(*keys, "ts", F.lit(code).alias("code"), *none)
    found = parameters(code, given, version, engine)
    known = {d.names.get(k, k): v for k, v in found.items() if not d.names or k in d.names}
    rows = d.compute(bars, keys, **known)
    if len(d.outputs) == 1:
        return rows.select(*keys, "ts", F.lit(code).alias("code"), F.col("value"), none[1])
    pairs = [x for o in d.outputs for x in (F.lit(o), F.col(o))]
    return rows.select(*keys, "ts", F.lit(code).alias("code"), none[0], F.create_map(*pairs).alias("extra_values"))


def fingerprint(code: Column, version: Column, params: Column, engine: Column) -> Column:
    """SHA-256 of ``code:version:k=v,k=v:engine`` with the parameters (a map) in order of their names."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.sha2(F.concat_ws(":", code, version, F.coalesce(pairs, F.lit("")), engine), 256)
