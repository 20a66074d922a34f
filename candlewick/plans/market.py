"""Queries over bars: ranges, rollups, checks, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.timegrid import MINUTE, TIMEFRAMES, plain, plus_ms
from candlewick.operators import checks, indicators, rollup, scan
from candlewick.sources.tables import bars_1m, ticks
from candlewick.streaming import bars as streams

SYMBOL, DAY, BEGIN, END = "click", "2024-01-05", "2024-01-05 00:00:00", "2024-01-06 00:00:00"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Ticks, one-minute bars and rollups, in SQL.
WITH = """WITH ticks AS (SELECT event_id, event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events),
b1 AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS ts, arg_min(price, (t, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, event_id)) AS close, sum(volume) AS volume FROM (SELECT *, ts AS t FROM ticks) GROUP BY symbol, date_trunc('minute', ts)),
tfs AS (SELECT tf, ms::BIGINT AS ms FROM (VALUES ('5m', 300000), ('15m', 900000), ('30m', 1800000), ('1h', 3600000), ('4h', 14400000)) v(tf, ms)),
roll AS (SELECT symbol, tf, ms, make_timestamp(epoch_us(ts) // (ms * 1000) * (ms * 1000)) AS start, ts, open, high, low, close, volume FROM b1, tfs),
bars AS (SELECT symbol, tf, start AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*)::INTEGER AS source_count,
 (count(*) = any_value(ms) // 60000 AND bool_or(ts = start) AND bool_or(epoch_us(ts) = epoch_us(start) + (ms - 60000) * 1000)) AS is_complete FROM roll GROUP BY symbol, tf, start),
h1 AS (SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE tf = '1h'),
m5 AS (SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE tf = '5m')
"""
_BAR = "symbol, ts, open, high, low, close, volume"


def query(name: str, sql: str | None = None):
    """Register a query, its timestamps without a zone, with its SQL over WITH."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = WITH + sql
        return f

    return add


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hour bars."""
    return rollup.rollup(bars_1m(spark, sf_dir), {"1h": TIMEFRAMES["1h"]}).select("symbol", "ts", *rollup.OHLCV)


def _ranged(name: str, sql: str, **how: object) -> None:
    query(name, sql)(lambda spark, sf_dir: scan.bar_range(bars_1m(spark, sf_dir, how.get("begin"), how.get("end")), SYMBOL, **how))  # type: ignore[arg-type]


_ranged("kline_range", f"SELECT {_BAR} FROM b1 WHERE symbol = '{SYMBOL}' AND ts >= '{BEGIN}' AND ts < '{END}'", begin=BEGIN, end=END)
_ranged("kline_first_n", f"SELECT {_BAR} FROM b1 WHERE symbol = '{SYMBOL}' AND ts >= '{BEGIN}' ORDER BY ts LIMIT 50", begin=BEGIN, limit=50)
_ranged("kline_latest_n", f"SELECT {_BAR} FROM b1 WHERE symbol = '{SYMBOL}' ORDER BY ts DESC LIMIT 50", limit=50)


@query("kline_latest", f"SELECT {_BAR} FROM b1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def _(spark, sf_dir):
    return scan.latest(bars_1m(spark, sf_dir))


@query("kline_at_ts", f"SELECT {_BAR} FROM bars WHERE tf = '4h' AND symbol = '{SYMBOL}' AND ts = '{BEGIN}'")
def _(spark, sf_dir):
    return scan.at(rollup.rollup(bars_1m(spark, sf_dir), {"4h": TIMEFRAMES["4h"]}).select("symbol", "ts", *rollup.OHLCV), SYMBOL, BEGIN)


@query("kline_response", f"SELECT symbol, epoch_ms(ts) AS timestamp, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS time, open, high, low, close, volume FROM b1 WHERE symbol = '{SYMBOL}' AND ts >= '{BEGIN}' AND ts < '{END}'")
def _(spark, sf_dir):
    return scan.response(scan.bar_range(bars_1m(spark, sf_dir, BEGIN, END), SYMBOL, BEGIN, END))


@query("merge_dedup", f"SELECT {_BAR}, CASE WHEN hour(ts) % 3 = 0 THEN 0 ELSE 1 END::INTEGER AS source FROM b1")
def _(spark, sf_dir):
    bars = bars_1m(spark, sf_dir)
    return scan.merged(bars.filter(F.hour("ts") % 3 == 0), bars)


@query("existing_minutes", f"SELECT DISTINCT symbol, date_trunc('minute', ts)::TIMESTAMP AS ts FROM ticks WHERE ts >= '{BEGIN}' AND ts < '{END}'")
def _(spark, sf_dir):
    return scan.minutes(ticks(spark, sf_dir), BEGIN, END)


@query("series_latest_365", f"SELECT {_BAR}, ts + INTERVAL 1 HOUR AS bar_time FROM h1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 365")
def _(spark, sf_dir):
    return scan.series(hourly(spark, sf_dir), TIMEFRAMES["1h"])


@query("series_step_anomaly", "SELECT * FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS previous, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS step_ms FROM h1) WHERE step_ms <> 3600000")
def _(spark, sf_dir):
    return scan.step_anomalies(hourly(spark, sf_dir), TIMEFRAMES["1h"])


@query("bars_before", f"SELECT {_BAR}, ts + INTERVAL 1 HOUR AS bar_time FROM h1 WHERE ts + INTERVAL 1 HOUR < '{BEGIN}'")
def _(spark, sf_dir):
    return scan.before(hourly(spark, sf_dir).withColumn("bar_time", plus_ms(F.col("ts"), TIMEFRAMES["1h"])), BEGIN)


@query("bars_close_time", "SELECT symbol, tf, ts, ts + ms * INTERVAL 1 MILLISECOND AS bar_time, close FROM bars JOIN tfs USING (tf)")
def _(spark, sf_dir):
    bars = rollup.rollup(bars_1m(spark, sf_dir))
    ms = F.element_at(F.create_map(*(F.lit(x) for kv in TIMEFRAMES.items() for x in kv)), F.col("tf"))
    return bars.select("symbol", "tf", "ts", plus_ms(F.col("ts"), ms).alias("bar_time"), "close")


@query("bars_all_tf", "SELECT * FROM bars")
def _(spark, sf_dir):
    return rollup.rollup(bars_1m(spark, sf_dir))


def _single(tf: str) -> None:
    query(f"bars_{tf}", f"SELECT {_BAR}, source_count FROM bars WHERE tf = '{tf}'")(lambda spark, sf_dir: rollup.rollup(bars_1m(spark, sf_dir), {tf: TIMEFRAMES[tf]}).select("symbol", "ts", *rollup.OHLCV, "source_count"))


for _tf in TIMEFRAMES:
    _single(_tf)


@query("bars_1m", f"SELECT {_BAR} FROM b1")
def _(spark, sf_dir):
    return bars_1m(spark, sf_dir)


@query("bar_completeness", "SELECT symbol, start AS ts, count(*)::INTEGER AS source_count, 5 AS expected, bool_or(ts = start) AS has_first, bool_or(ts = start + INTERVAL 4 MINUTE) AS has_last, count(*) = 5 AND bool_or(ts = start) AND bool_or(ts = start + INTERVAL 4 MINUTE) AS is_complete FROM roll WHERE tf = '5m' GROUP BY symbol, start")
def _(spark, sf_dir):
    return rollup.completeness(bars_1m(spark, sf_dir), "5m")


@query("batch_rollup_report", "SELECT tf, count(*) AS windows, count(*) FILTER (is_complete) AS complete, sum(source_count)::BIGINT AS bars FROM bars GROUP BY tf")
def _(spark, sf_dir):
    return rollup.rollup(rollup.deduplicated(bars_1m(spark, sf_dir))).groupBy("tf").agg(F.count("*").alias("windows"), F.count_if("is_complete").alias("complete"), F.sum("source_count").alias("bars"))


@query("rollup_save_report", f"SELECT tf, count(*) AS generated, count(*) FILTER (ts >= '{BEGIN}') AS saved, count(*) FILTER (ts < '{BEGIN}') AS skipped FROM bars GROUP BY tf")
def _(spark, sf_dir):
    bars = rollup.rollup(bars_1m(spark, sf_dir))
    return rollup.save_report(bars, bars.filter(F.col("ts") < F.lit(BEGIN).cast("timestamp")))


_GRID = "SELECT symbol, unnest(generate_series(min(make_timestamp(epoch_us(ts) // {us} * {us})), max(ts), INTERVAL {step})) AS ts FROM b1 GROUP BY symbol"


@query("missing_windows", f"SELECT symbol, ts FROM ({_GRID.format(us=3600000000, step='1 HOUR')}) g ANTI JOIN h1 USING (symbol, ts)")
def _(spark, sf_dir):
    return rollup.missing_windows(bars_1m(spark, sf_dir), hourly(spark, sf_dir), "1h")


@query("backfill_windows", f"SELECT symbol, tf, ts, open, high, low, close, volume, source_count, is_complete FROM bars WHERE tf = '1h' AND day(ts) % 2 = 0")
def _(spark, sf_dir):
    bars = bars_1m(spark, sf_dir)
    return rollup.backfill(bars, hourly(spark, sf_dir).filter(F.dayofmonth("ts") % 2 == 1), "1h").select("symbol", "tf", "ts", *rollup.OHLCV, "source_count", "is_complete")


@query("day_stats", f"""SELECT symbol, coalesce(close, latest) AS price, coalesce(high, latest) AS high, coalesce(low, latest) AS low, coalesce(volume, 0.0::DOUBLE) AS volume, round(coalesce(CASE WHEN open = 0 THEN 0 ELSE (close - open) / open * 100 END, 0.0::DOUBLE), 8) AS change_pct
FROM (SELECT symbol, arg_max(close, ts) AS latest FROM b1 GROUP BY symbol) LEFT JOIN (SELECT symbol, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b1 WHERE ts >= '{BEGIN}' AND ts < '{END}' GROUP BY symbol) USING (symbol)""")
def _(spark, sf_dir):
    return rollup.day_stats(bars_1m(spark, sf_dir), DAY)


@query("valid_ohlc", f"SELECT {_BAR} FROM h1 WHERE high >= open AND high >= close AND low <= open AND low <= close")
def _(spark, sf_dir):
    return hourly(spark, sf_dir).filter(checks.valid())


@query("drop_flat", f"SELECT {_BAR} FROM b1 WHERE NOT (open = high AND high = low AND low = close)")
def _(spark, sf_dir):
    return bars_1m(spark, sf_dir).filter(~checks.flat())


@query("gap_minutes", f"SELECT symbol, ts FROM (SELECT symbol, unnest(generate_series(TIMESTAMP '{BEGIN}', TIMESTAMP '2024-01-05 23:59:00', INTERVAL 1 MINUTE)) AS ts FROM (SELECT DISTINCT symbol FROM b1)) g ANTI JOIN b1 USING (symbol, ts)")
def _(spark, sf_dir):
    return checks.gaps(bars_1m(spark, sf_dir), BEGIN, END)


def _stored(spark, sf_dir):
    """The bars of nine ticks in ten: a store that lacks some."""
    from candlewick.sources.tables import minute_bars

    return minute_bars(ticks(spark, sf_dir).filter("event_id % 10 != 0"))


_HAS = "SELECT DISTINCT symbol, date_trunc('minute', ts)::TIMESTAMP AS ts FROM ticks WHERE event_id % 10 <> 0"


@query("missing_vs_source", f"SELECT {_BAR} FROM b1 ANTI JOIN ({_HAS}) USING (symbol, ts)")
def _(spark, sf_dir):
    return checks.missing(bars_1m(spark, sf_dir), _stored(spark, sf_dir))


@query("missing_report", f"""SELECT symbol, count(*) AS missing_count, count(there) AS filled_count, CASE WHEN count(*) <= 100 THEN string_agg(strftime(ts, '%Y-%m-%d %H:%M'), ',' ORDER BY ts) END AS minutes
FROM (SELECT symbol, ts FROM (SELECT symbol, unnest(generate_series(TIMESTAMP '2024-01-05 10:00:00', TIMESTAMP '2024-01-05 11:39:00', INTERVAL 1 MINUTE)) AS ts FROM (SELECT DISTINCT symbol FROM ({_HAS}))) g ANTI JOIN ({_HAS}) USING (symbol, ts)) LEFT JOIN (SELECT symbol, ts, 1 AS there FROM b1) USING (symbol, ts) GROUP BY symbol""")
def _(spark, sf_dir):
    return checks.missing_report(bars_1m(spark, sf_dir), _stored(spark, sf_dir), "2024-01-05 10:00:00", "2024-01-05 11:40:00")


@query("verify_duplicates", "SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS ts, count(*) AS n FROM ticks GROUP BY symbol, date_trunc('minute', ts) HAVING count(*) > 1")
def _(spark, sf_dir):
    from candlewick.functions.timegrid import align

    return checks.duplicates(ticks(spark, sf_dir).withColumn("ts", align(F.col("ts"), MINUTE)))


#: Arrival: tick ids with two digits swapped, so that some rows come late.
_ARRIVED = "(event_id // 100 * 100 + event_id % 10 * 10 + event_id // 10 % 10)"


def _arrived(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("seq", F.expr("event_id div 100 * 100 + event_id % 10 * 10 + event_id div 10 % 10"))


@query("verify_out_of_order", f"SELECT * FROM (SELECT symbol, ts, seq, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS previous FROM (SELECT *, {_ARRIVED} AS seq FROM ticks)) WHERE ts < previous")
def _(spark, sf_dir):
    return checks.out_of_order(_arrived(spark, sf_dir), "seq").select("symbol", "ts", "seq", "previous")


def _odd(spark, sf_dir):
    """Ticks as bars with faults: what is high or low depends on the tick's id."""
    p, e = F.col("price"), F.col("event_id")
    return _arrived(spark, sf_dir).select("symbol", "ts", "seq", F.when(e % 17 == 0, -p).otherwise(p).alias("open"), F.when(e % 13 == 0, p - 1).otherwise(p).alias("high"), F.when(e % 11 == 0, p + 2).otherwise(p).alias("low"), F.when(e % 19 == 0, p + 2e6).otherwise(p).alias("close"), F.when(e % 7 == 0, -1.0).otherwise(F.col("volume")).alias("volume"))


_ODD = f"""SELECT symbol, ts, {_ARRIVED} AS seq, CASE WHEN event_id % 17 = 0 THEN -price ELSE price END AS open, CASE WHEN event_id % 13 = 0 THEN price - 1 ELSE price END AS high, CASE WHEN event_id % 11 = 0 THEN price + 2 ELSE price END AS low, CASE WHEN event_id % 19 = 0 THEN price + 2e6 ELSE price END AS close, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE volume END AS volume FROM ticks"""
_ERRORS = """concat_ws(',', CASE WHEN open < 0 OR high < 0 OR low < 0 OR close < 0 THEN 'NEGATIVE_PRICE' END, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN greatest(open, high, low, close) > 1000000 THEN 'PRICE_TOO_HIGH' END,
 CASE WHEN high < low THEN 'HIGH_LESS_THAN_LOW' END, CASE WHEN high < open OR high < close THEN 'HIGH_INVALID' END, CASE WHEN low > open OR low > close THEN 'LOW_INVALID' END)"""


@query("verify_data_errors", f"SELECT symbol, seq, {_ERRORS} AS errors FROM ({_ODD}) WHERE {_ERRORS} <> ''")
def _(spark, sf_dir):
    return _odd(spark, sf_dir).select("symbol", "seq", checks.data_errors().alias("errors")).filter("errors <> ''")


@query("verify_report", f"""SELECT symbol, count(*) AS total, coalesce(any_value(dup), 0)::BIGINT AS duplicates, count(*) FILTER (late) AS out_of_order, count(*) FILTER (errors <> '') AS data_errors, count(*) FILTER (late) + count(*) FILTER (errors <> '') AS error_count,
 coalesce(string_agg(strftime(ts, '%Y-%m-%d %H:%M') || ' ' || errors, ';' ORDER BY rank) FILTER (errors <> '' AND rank <= 100), '') AS details
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, errors <> '' ORDER BY ts, seq) AS rank FROM (SELECT *, ts < lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS late, {_ERRORS} AS errors FROM ({_ODD})))
LEFT JOIN (SELECT symbol, count(*) AS dup FROM (SELECT symbol, ts FROM ticks GROUP BY symbol, ts HAVING count(*) > 1) GROUP BY symbol) USING (symbol) GROUP BY symbol""")
def _(spark, sf_dir):
    return checks.verify_report(_odd(spark, sf_dir), "seq")


@query("continuity_check", "SELECT symbol, ts, n AS seen, n < 60 AS has_gap FROM (SELECT symbol, ts, count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS n FROM b1)")
def _(spark, sf_dir):
    return checks.continuity(bars_1m(spark, sf_dir))


@query("cooldown_filter", """, RECURSIVE o AS (SELECT symbol AS key, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i FROM ticks), r AS (SELECT key, ts, i, ts AS last, true AS pass FROM o WHERE i = 1 UNION ALL
 SELECT o.key, o.ts, o.i, CASE WHEN o.ts >= r.last + INTERVAL 3600 SECOND THEN o.ts ELSE r.last END, o.ts >= r.last + INTERVAL 3600 SECOND FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1) SELECT key, ts FROM r WHERE pass""")
def _(spark, sf_dir):
    return checks.cooldown(ticks(spark, sf_dir).withColumnRenamed("symbol", "key"), 3600)


ORACLES["cooldown_filter"] = ORACLES["cooldown_filter"].replace("WITH ticks", "WITH RECURSIVE ticks", 1).replace(", RECURSIVE o AS", ", o AS")


@query("latest_price", "SELECT symbol, arg_max(price, (ts, event_id)) AS price, max(ts) AS ts FROM ticks GROUP BY symbol")
def _(spark, sf_dir):
    return streams.latest_price(ticks(spark, sf_dir))


_F = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"
_FOLD = _F.format(364)


def _indicator(name: str, f, sql: str) -> None:
    query(f"ind_{name}", sql)(lambda spark, sf_dir: f(hourly(spark, sf_dir)))


def _ema_sql(v: str, alpha: str) -> str:
    return f"list_reduce({v}, lambda acc, x: acc + ({alpha}) * (x - acc))"


_indicator("sma", indicators.sma, f"SELECT symbol, ts, round(avg(close) {_F.format(19)}, 8) AS value FROM h1")
_indicator("ema", indicators.ema, f"SELECT symbol, ts, round({_ema_sql('f', '2.0::DOUBLE / 21')}, 8) AS value FROM (SELECT symbol, ts, list(close) {_FOLD} AS f FROM h1)")
_indicator("wma", indicators.wma, f"SELECT symbol, ts, round(list_sum(list_transform(f, lambda x, i: x * i)) * 2 / (len(f) * (len(f) + 1)), 8) AS value FROM (SELECT symbol, ts, list(close) {_F.format(19)} AS f FROM h1)")
_W = "list_reduce(list_concat([0.0::DOUBLE], list_transform(f[2:], lambda x: x.{0})), lambda acc, x: acc + (1.0::DOUBLE / 14) * (x - acc))"
_indicator("rsi", indicators.rsi, f"""SELECT symbol, ts, round(CASE WHEN d = 0 THEN CASE WHEN u = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + u / d) END, 8) AS value FROM (SELECT symbol, ts, {_W.format('up')} AS u, {_W.format('down')} AS d FROM
 (SELECT symbol, ts, list(struct_pack(up := greatest(coalesce(c, 0.0::DOUBLE), 0.0::DOUBLE), down := greatest(-coalesce(c, 0.0::DOUBLE), 0.0::DOUBLE))) {_FOLD} AS f FROM (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM h1)))""")
_indicator("atr", indicators.atr, f"""SELECT symbol, ts, round(list_reduce(list_concat([f[1].own], list_transform(f[2:], lambda x: x.tr)), lambda acc, x: acc + (1.0::DOUBLE / 14) * (x - acc)), 8) AS value FROM
 (SELECT symbol, ts, list(struct_pack(own := high - low, tr := CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END)) {_FOLD} AS f FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM h1))""")
_indicator("boll", indicators.bollinger, f"SELECT symbol, ts, round(m + 2.0 * s, 8) AS upper, round(m, 8) AS middle, round(m - 2.0 * s, 8) AS lower FROM (SELECT symbol, ts, avg(close) {_F.format(19)} AS m, stddev_pop(close) {_F.format(19)} AS s FROM h1)")
_MACD = """SELECT symbol, ts, round(w.f - w.s, 8) AS macd, round(w.g, 8) AS signal, round(w.f - w.s - w.g, 8) AS histogram FROM (SELECT symbol, ts, list_reduce(list_transform(f, lambda x: struct_pack(f := x, s := x, g := 0.0::DOUBLE)), lambda acc, x: struct_pack(
 f := acc.f + ({fast}) * (x.f - acc.f), s := acc.s + ({slow}) * (x.s - acc.s), g := acc.g + ({signal}) * ((acc.f + ({fast}) * (x.f - acc.f)) - (acc.s + ({slow}) * (x.s - acc.s)) - acc.g))) AS w FROM (SELECT symbol, ts, list(close) {fold} AS f FROM h1))"""
_indicator("macd", indicators.macd, _MACD.format(fast="2.0::DOUBLE / 13", slow="2.0::DOUBLE / 27", signal="2.0::DOUBLE / 10", fold=_FOLD))
query("ind_macd_parameters", _MACD.format(fast="2.0::DOUBLE / 6", slow="2.0::DOUBLE / 11", signal="2.0::DOUBLE / 10", fold=_FOLD))(
    # short and long periods as given, one as text; a signal period that is no whole number has its default
    lambda spark, sf_dir: indicators.values(hourly(spark, sf_dir), "MACD", shortPeriod=5, longPeriod="10", signalPeriod="3.5").select("symbol", "ts", *(F.col("extra_values")[o].alias(o) for o in ("macd", "signal", "histogram")))
)
_indicator("stoch", indicators.stochastic, f"SELECT symbol, ts, k, k AS d FROM (SELECT symbol, ts, CASE WHEN hh <> ll THEN round((close - ll) / (hh - ll) * 100, 8) END AS k FROM (SELECT *, min(low) {_F.format(13)} AS ll, max(high) {_F.format(13)} AS hh FROM h1))")
_indicator("momentum", indicators.momentum, f"SELECT symbol, ts, CASE WHEN p <> 0 THEN round((close - p) / p * 100, 8) END AS value FROM (SELECT *, first(close) {_F.format(10)} AS p FROM h1)")
_indicator("sma_strict", indicators.sma_strict, f"SELECT symbol, ts, CASE WHEN n >= 20 THEN round(s / 20, 8) END::DOUBLE AS value FROM (SELECT symbol, ts, count(*) {_F.format(19)} AS n, (sum(close::DECIMAL(20, 8)) {_F.format(19)})::DOUBLE AS s FROM h1)")
_indicator("kdj_failed", lambda bars: indicators.values(bars, "KDJ").select("symbol", "ts", F.when(F.col("value").isNull() & F.col("extra_values").isNull(), "FAILED").otherwise("SUCCESS").alias("status")), "SELECT symbol, ts, 'FAILED' AS status FROM h1")


def _in_chunks(name: str, f, days: int) -> None:
    """An indicator's query in chunks of some days, each with its halo."""
    query(f"ind_{name}_chunks")(lambda spark, sf_dir: f(hourly(spark, sf_dir), span_ms=days * 86_400_000))
    ORACLES[f"ind_{name}_chunks"] = ORACLES[f"ind_{name}"]


_in_chunks("ema", indicators.ema, 5)
_in_chunks("atr", indicators.atr, 20)
