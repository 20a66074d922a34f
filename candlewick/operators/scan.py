"""Reading bars: ranges, points, latest rows, merged sources, series for indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.timegrid import TIMEFRAMES, align, local_time, plus_ms
from candlewick.operators import halo

#: Rows that a range query gives at most when it has a limit.
MOST = 10_000
#: Bars of a series.
SERIES = 365


def bar_range(bars: DataFrame, symbol: str, begin: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars of a symbol with begin <= ts < end, ascending.

    With a positive limit (at most MOST): the first ones if ``begin`` is given, else the latest ones.
    """
    found = bars.filter(F.col("symbol") == symbol)
    if begin is not None:
        found = found.filter(F.col("ts") >= F.lit(begin).cast("timestamp"))
    if end is not None:
        found = found.filter(F.col("ts") < F.lit(end).cast("timestamp"))
    if limit is not None and limit > 0:
        found = found.orderBy("ts" if begin is not None else F.desc("ts")).limit(min(limit, MOST))
    return found.orderBy("ts")


def latest(bars: DataFrame) -> DataFrame:
    """Each symbol's latest bar."""
    columns = [c for c in bars.columns if c not in ("symbol", "ts")]
    return bars.groupBy("symbol").agg(F.max("ts").alias("ts"), *(F.max_by(c, "ts").alias(c) for c in columns))


def at(bars: DataFrame, symbol: str, ts: str) -> DataFrame:
    """The bar of a symbol at an instant."""
    return bars.filter((F.col("symbol") == symbol) & (F.col("ts") == F.lit(ts).cast("timestamp"))).limit(1)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources' bars; where both have (symbol, ts), those of ``first``."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    order = Window.partitionBy("symbol", "ts").orderBy("source")
    return both.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def minutes(rows: DataFrame, begin: str, end: str) -> DataFrame:
    """The distinct minutes in [begin, end) that a symbol has rows for."""
    inside = rows.filter((F.col("ts") >= F.lit(begin).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return inside.select("symbol", align(F.col("ts"), 60_000).alias("ts")).distinct()


def series(bars: DataFrame, ms: int, most: int = SERIES) -> DataFrame:
    """Each symbol's latest ``most`` bars with their closing time; the first row of a repeated time stays."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = bars.dropDuplicates(["symbol", "ts"]).withColumn("nth", F.row_number().over(newest))
    return rows.filter(F.col("nth") <= most).drop("nth").withColumn("bar_time", plus_ms(F.col("ts"), ms))


def series_for(requests: DataFrame, bars: DataFrame, listed: DataFrame, standard: DataFrame, most: int = SERIES) -> DataFrame:
    """(pair_id, tf, symbol, ts, bar_time, open, high, low, close, volume) for each of ``requests`` (pair_id, tf, n): the pair's latest bars.

    ``bars`` are rollups (symbol, tf, ts, ...) of TIMEFRAMES; other timeframes have no series. Bars are stored under the
    exchange's symbol of a pair (``listed``: pair_id, symbol; null and empty ones don't count), else under the ``standard``
    one; a pair without either has none. At most ``n`` and ``most`` bars. Requests are few beside bars, and distinct.
    """
    named = listed.filter("symbol <> ''").select("pair_id", F.col("symbol").alias("_listed"))
    wanted = requests.filter(F.col("tf").isin(*TIMEFRAMES)).join(named, "pair_id", "left").join(standard.select("pair_id", F.col("symbol").alias("_standard")), "pair_id", "left")
    wanted = wanted.select("pair_id", "tf", F.least("n", F.lit(most)).alias("n"), F.coalesce("_listed", "_standard").alias("symbol")).filter("symbol <> ''")
    newest = Window.partitionBy("pair_id", "tf").orderBy(F.desc("ts"))
    # the rank's limit cuts rows before the shuffle; the request's own limit comes after
    rows = bars.join(wanted, ["symbol", "tf"]).withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= most).filter("_nth <= n")
    ms = F.element_at(F.create_map(*(F.lit(x) for kv in TIMEFRAMES.items() for x in kv)), F.col("tf"))
    return rows.select("pair_id", "tf", "symbol", "ts", plus_ms(F.col("ts"), ms).alias("bar_time"), "open", "high", "low", "close", "volume")


def step_anomalies(bars: DataFrame, ms: int, span_ms: int = halo.SPAN_MS) -> DataFrame:
    """(symbol, ts, previous, step_ms) where two bars that follow each other are not ``ms`` apart."""
    previous = lambda rows, by: rows.select(*by, "ts", F.lag("ts").over(Window.partitionBy(*by).orderBy("ts")).alias("previous"))
    rows = halo.windowed(bars.select("symbol", "ts"), previous, ("symbol",), 1, span_ms)
    step = F.unix_millis("ts") - F.unix_millis("previous")
    return rows.withColumn("step_ms", step).filter(F.col("step_ms") != ms)


def before(bars: DataFrame, ts: str) -> DataFrame:
    """Bars whose closing time is before an instant."""
    return bars.filter(F.col("bar_time") < F.lit(ts).cast("timestamp"))


def response(bars: DataFrame) -> DataFrame:
    """Bars as answers show them: epoch milliseconds and local time."""
    return bars.select("symbol", F.unix_millis("ts").alias("timestamp"), local_time(F.col("ts")).alias("time"), "open", "high", "low", "close", "volume")
