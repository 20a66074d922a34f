"""Queries over dimensions and messages; the tables stand in for pairs, rules, strategies and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.timegrid import plain
from candlewick.operators import dims, scan, signals
from candlewick.plans.market import WITH, hourly
from candlewick.sources import exchange
from candlewick.sources.tables import bars_1m, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("symbol"), F.col("p_type").alias("market"), (F.col("p_size") % 3 != 0).cast("int").alias("enabled"))


def _rules(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 4 != 0").select(F.col("p_partkey").alias("pair_id"), F.concat("p_name", F.lit("-SWAP")).alias("exchange_symbol"), F.col("p_retailprice").alias("min_price"))


_PAIRS = "SELECT p_partkey AS pair_id, p_name AS symbol, p_type AS market, (p_size % 3 <> 0)::INTEGER AS enabled FROM part"
_RULES = "SELECT p_partkey AS pair_id, p_name || '-SWAP' AS exchange_symbol, p_retailprice AS min_price FROM part WHERE p_partkey % 4 <> 0"


@query("enabled_targets", f"SELECT o_orderkey AS config_id, pair_id, symbol, exchange_symbol FROM orders JOIN ({_PAIRS}) ON pair_id = o_orderkey % 3000 JOIN ({_RULES}) USING (pair_id) WHERE o_orderstatus = 'O'")
def _(spark, sf_dir):
    configs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("config_id"), (F.col("o_orderkey") % 3000).alias("pair_id"), (F.col("o_orderstatus") == "O").cast("int").alias("enabled"))
    return dims.targets(configs, _pairs(spark, sf_dir).drop("enabled"), _rules(spark, sf_dir)).select("config_id", "pair_id", "symbol", "exchange_symbol")


@query("pairs_with_rules", f"SELECT pair_id, symbol, market, enabled, exchange_symbol, min_price FROM ({_PAIRS}) LEFT JOIN ({_RULES}) USING (pair_id)")
def _(spark, sf_dir):
    return dims.with_rules(_pairs(spark, sf_dir), _rules(spark, sf_dir))


@query("resolve_pair", "SELECT name, coalesce(a, b) AS pair_id FROM (SELECT DISTINCT p_name || CASE WHEN p_partkey % 3 = 0 THEN '-SWAP' WHEN p_partkey % 3 = 1 THEN '-FUTURES' ELSE '' END AS name FROM part) LEFT JOIN (SELECT exchange_symbol AS name, min(pair_id) AS a FROM (" + _RULES + ") GROUP BY 1) USING (name) LEFT JOIN (SELECT p_name AS s, min(p_partkey) AS b FROM part GROUP BY 1) ON s = regexp_replace(name, '-(SWAP|FUTURES)$', '')")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    suffix = F.when(F.col("p_partkey") % 3 == 0, "-SWAP").when(F.col("p_partkey") % 3 == 1, "-FUTURES").otherwise("")
    names = part.select(F.concat("p_name", suffix).alias("name")).distinct()
    exact = _rules(spark, sf_dir).groupBy("exchange_symbol").agg(F.min("pair_id").alias("pair_id"))
    standard = _pairs(spark, sf_dir).groupBy("symbol").agg(F.min("pair_id").alias("pair_id"))
    return dims.resolved(names, exact, standard)


@query("symbol_key", "SELECT id, symbol, regexp_replace(symbol, '-(SWAP|FUTURES)$', '') AS base, regexp_replace(symbol, '-(SWAP|FUTURES)$', '') || '-' || market AS standard, CASE WHEN len(string_split(symbol, '-')) >= 3 THEN array_to_string(string_split(symbol, '-')[:-2], '-') ELSE symbol END AS pair FROM (SELECT c_custkey AS id, c_mktsegment AS market, 'C' || c_nationkey || '-USDT' || ['-SWAP', '-FUTURES', '', '-X'][1 + c_custkey % 4] AS symbol FROM customer)")
def _(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, ("-SWAP", "-FUTURES", "", "-X"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("market"), F.concat(F.lit("C"), "c_nationkey", F.lit("-USDT"), ending).alias("symbol"))
    base, standard, pair = exchange.symbol_key(F.col("symbol"), F.col("market"))
    return rows.select("id", "symbol", base.alias("base"), standard.alias("standard"), pair.alias("pair"))


@query("enabled_pairs", f"SELECT pair_id, symbol, market FROM ({_PAIRS}) WHERE enabled = 1 ORDER BY symbol, pair_id")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).filter("enabled = 1").orderBy("symbol", "pair_id").drop("enabled")


@query("definition_search", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'small') OR contains(p_type, 'small')")
def _(spark, sf_dir):
    return dims.search(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "small", ["p_name", "p_type"])


@query("mask_secret", "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '****' ELSE left(c_name, 4) || '****' || right(c_name, 4) END AS masked FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", exchange.masked(F.col("c_name")).alias("masked"))


@query("subscription_fanout", WITH + "SELECT symbol, ts, c_custkey AS user_id FROM h1 JOIN customer ON symbol = ['click', 'view', 'error', 'none'][1 + c_custkey % 4] WHERE c_acctbal > 0")
def _(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("click", "view", "error", "none"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    subs = table(spark, sf_dir, "customer").select(names.alias("symbol"), F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).cast("int").alias("enabled"))
    return dims.fanned_out(hourly(spark, sf_dir).select("symbol", "ts"), subs, ["symbol"])


_DEF = "SELECT c_custkey AS strategy_id, c_mktsegment AS kind, (c_acctbal > 0)::INTEGER AS enabled FROM customer"
_SYM = "SELECT o_custkey AS strategy_id, o_orderpriority AS symbol, (o_orderstatus <> 'F')::INTEGER AS enabled FROM orders"
_CFG = f"""WITH d AS ({_DEF}), p AS (SELECT c_custkey AS strategy_id, c_acctbal AS capital FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT strategy_id, list_sort(list_distinct(list(symbol))) AS symbols FROM ({_SYM}) WHERE enabled = 1 GROUP BY 1), u AS (SELECT o_custkey AS strategy_id, list_sort(list_distinct(list(o_orderkey))) AS configs FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1),
cfg AS (SELECT strategy_id, kind, capital, symbols, configs FROM d JOIN p USING (strategy_id) JOIN s USING (strategy_id) LEFT JOIN u USING (strategy_id) WHERE enabled = 1) """


def _config(spark, sf_dir) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    definitions = c.select(F.col("c_custkey").alias("strategy_id"), F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") > 0).cast("int").alias("enabled"))
    params = c.filter("c_custkey % 5 != 0").select(F.col("c_custkey").alias("strategy_id"), F.col("c_acctbal").alias("capital"))
    symbols = o.select(F.col("o_custkey").alias("strategy_id"), F.col("o_orderpriority").alias("symbol"), (F.col("o_orderstatus") != "F").cast("int").alias("enabled"))
    subscriptions = o.select(F.col("o_custkey").alias("strategy_id"), F.col("o_orderkey").alias("config_id"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("enabled"))
    return dims.strategies(definitions, params, symbols, subscriptions).drop("enabled")


@query("strategy_config", _CFG + "SELECT strategy_id, kind, capital, array_to_string(symbols, ',') AS symbols, array_to_string(configs, ',') AS configs FROM cfg")
def _(spark, sf_dir):
    return _config(spark, sf_dir).select("strategy_id", "kind", "capital", F.array_join("symbols", ",").alias("symbols"), F.array_join(F.transform("configs", lambda x: x.cast("string")), ",").alias("configs"))


_STATES = "SELECT o_custkey AS strategy_id, o_orderpriority AS symbol, arg_max(o_orderstatus, o_orderkey) AS side, arg_max(o_totalprice, o_orderkey) AS qty, 'HELD' AS phase FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL"


@query("strategy_instances", _CFG + f"SELECT strategy_id, symbol, coalesce(side, 'FLAT') AS side, coalesce(qty, 0.0::DOUBLE) AS qty, coalesce(phase, 'IDLE') AS phase FROM (SELECT strategy_id, unnest(symbols) AS symbol FROM cfg) LEFT JOIN ({_STATES}) USING (strategy_id, symbol)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("strategy_id"), F.col("o_orderpriority").alias("symbol"))
    states = rows.agg(F.max_by("o_orderstatus", "o_orderkey").alias("side"), F.max_by("o_totalprice", "o_orderkey").alias("qty")).withColumn("phase", F.lit("HELD"))
    return dims.instances(_config(spark, sf_dir), states)


@query("state_init", "SELECT c_custkey AS strategy_id, coalesce(s, 'FLAT') AS side, coalesce(q, 0.0::DOUBLE) AS qty FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS s, max(o_totalprice) AS q FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("strategy_id")).agg(F.max("o_orderstatus").alias("s"), F.max("o_totalprice").alias("q"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("strategy_id")).join(s, "strategy_id", "left").select("strategy_id", F.coalesce("s", F.lit("FLAT")).alias("side"), F.coalesce("q", F.lit(0.0)).alias("qty"))


@query("strategy_fanout", WITH + f"SELECT symbol, bar_time, strategy_id FROM (SELECT symbol, ts + INTERVAL 1 HOUR AS bar_time FROM h1) JOIN (SELECT c_custkey AS strategy_id, ['click', 'view', 'error'][1 + c_custkey % 3] AS symbol FROM customer WHERE c_acctbal > 5000) USING (symbol)")
def _(spark, sf_dir):
    bars = scan.series(hourly(spark, sf_dir), 3_600_000, most=10**9).select("symbol", "bar_time")
    names = F.element_at(F.array(*map(F.lit, ("click", "view", "error"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return dims.fanned_out(bars, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("strategy_id"), names.alias("symbol"), (F.col("c_acctbal") > 5000).cast("int").alias("enabled")), ["symbol"])


_OLD = "o_orderkey % 3 <> 0"
_NEW = "o_orderkey % 3 <> 1"


@query("dim_upsert", f"SELECT o_orderkey, CASE WHEN {_NEW} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN {_NEW} THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.filter(_NEW).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return signals.upserted(o.filter(_OLD), new, ["o_orderkey"])


@query("pair_upsert_keep_enabled", f"SELECT o_orderkey, CASE WHEN {_NEW} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN {_OLD} THEN o_orderstatus ELSE 'N' END AS o_orderstatus FROM orders")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.filter(_NEW).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return signals.upserted(o.filter(_OLD), new, ["o_orderkey"], keep=("o_orderstatus",))


@query("insert_if_absent", WITH + "SELECT symbol, ts, CASE WHEN day(ts) % 2 = 0 THEN close ELSE close + 1 END AS close FROM b1")
def _(spark, sf_dir):
    bars = bars_1m(spark, sf_dir).select("symbol", "ts", "close")
    stored = bars.filter(F.dayofmonth("ts") % 2 == 0)
    return stored.unionByName(signals.fresh(bars.withColumn("close", F.col("close") + 1), stored, ["symbol", "ts"]))


@query("latest_per_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))


def _messages(spark, sf_dir) -> DataFrame:
    """Events as candle messages: every tick a candle, some flat, unconfirmed, about the connection."""
    e, p = table(spark, sf_dir, "events"), F.col("value")
    number = lambda c: c.cast("decimal(18,2)").cast("string")
    cells = F.array(F.unix_millis("ts").cast("string"), number(p), number(F.when(F.col("event_id") % 4 == 0, p).otherwise(p + 2)), number(F.when(F.col("event_id") % 4 == 0, p).otherwise(p - 1)), number(p), F.get_json_object("props", "$.k"), F.lit("0"), F.lit("0"), F.when(F.col("event_id") % 3 == 0, "0").otherwise("1"))
    data = F.struct(F.struct(F.col("event_type").alias("instId")).alias("arg"), F.array(cells).alias("data"))
    text = F.when(F.col("event_id") % 10 == 9, F.lit('{"event":"subscribe"}')).otherwise(F.to_json(data))
    return e.select("event_id", text.alias("message"), F.timestamp_micros(F.unix_micros(F.date_trunc("minute", "ts")) + F.when(F.col("event_id") % 2 == 0, 59_500_000).otherwise(30_000_000)).alias("received"))


@query("candle_parse", "SELECT event_type AS symbol, date_trunc('minute', ts)::TIMESTAMP AS ts, date_trunc('minute', ts)::TIMESTAMP + INTERVAL 1 MINUTE AS close_time, value AS open, (value::DECIMAL(18, 2) + 2)::DOUBLE AS high, (value::DECIMAL(18, 2) - 1)::DOUBLE AS low, value AS close, json_extract_string(props, '$.k')::DOUBLE AS volume, false AS is_final FROM events WHERE event_id % 10 <> 9 AND event_id % 4 <> 0 AND (event_id % 3 <> 0 OR event_id % 2 = 0)")
def _(spark, sf_dir):
    return exchange.candles(_messages(spark, sf_dir))


@query("ticker_parse", "SELECT event_type AS symbol, value AS price, CASE WHEN event_id % 4 = 0 THEN date_trunc('hour', ts)::TIMESTAMP ELSE make_timestamp(epoch_us(ts) // 1000 * 1000) END AS ts FROM events WHERE event_id % 10 <> 9")
def _(spark, sf_dir):
    one = F.struct(F.col("value").cast("string").alias("last"), F.when(F.col("event_id") % 4 != 0, F.unix_millis("ts").cast("string")).alias("ts"))
    data = F.to_json(F.struct(F.struct(F.col("event_type").alias("instId")).alias("arg"), F.array(one).alias("data")))
    text = F.when(F.col("event_id") % 10 == 9, F.lit('{"event":"error"}')).otherwise(data)
    return exchange.tickers(table(spark, sf_dir, "events").select(text.alias("message"), F.date_trunc("hour", "ts").alias("received")))


@query("instrument_normalize", """SELECT 'B' || p_size || '-' || p_brand || '-SWAP' AS "instId", 'B' || p_size || '-' || p_brand AS symbol, 'B' || p_size AS base, p_brand AS quote, (p_partkey % 4)::INTEGER AS precision, p_size % 2 = 0 AS trading FROM part""")
def _(spark, sf_dir):
    base = F.concat(F.lit("B"), F.col("p_size"))
    tick = F.element_at(F.array(*map(F.lit, ("1", "0.10", "0.01", "0.0050"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    one = F.struct(F.concat_ws("-", base, "p_brand", F.lit("SWAP")).alias("instId"), F.when(F.col("p_partkey") % 2 == 0, base).otherwise("").alias("baseCcy"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("quoteCcy"), tick.alias("tickSz"), F.when(F.col("p_size") % 2 == 0, "live").otherwise("suspend").alias("state"))
    rows = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(one).alias("data"))).alias("message"))
    return exchange.instruments(rows)
