"""Queries of running the service: pages of tasks and logs, counts, alerts, message routes, pages to fetch."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.timegrid import MINUTE, align, plain, plus_ms
from candlewick.operators import checks, dims, indicators, rollup, scan, signals
from candlewick.plans.market import BEGIN, END, WITH, hourly
from candlewick.sources import exchange
from candlewick.sources.tables import bars_1m, table, ticks
from candlewick.streaming import bars as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


@query("pair_info", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def _(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("symbol_set_diff", "SELECT o_custkey, o_orderpriority, CASE WHEN bool_or(o_orderkey % 2 = 0) THEN 'removed' ELSE 'added' END AS change FROM orders GROUP BY 1, 2 HAVING bool_or(o_orderkey % 2 = 0) <> bool_or(o_orderkey % 2 = 1)")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old, new = (o.filter(F.col("o_orderkey") % 2 == k).select("o_custkey", "o_orderpriority").distinct() for k in (0, 1))
    keys = ["o_custkey", "o_orderpriority"]
    return old.join(new, keys, "left_anti").withColumn("change", F.lit("removed")).unionByName(new.join(old, keys, "left_anti").withColumn("change", F.lit("added")))


@query("task_page", "SELECT o_orderkey, o_orderdate, o_orderpriority, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' ORDER BY o_orderdate, o_orderkey LIMIT 30 OFFSET 30")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderdate", "o_orderpriority")
    return signals.page(rows, [F.col("o_orderdate"), F.col("o_orderkey")], page=2, size=30)


@query("tasks_with_pair", "SELECT o_orderkey, o_orderdate, o_custkey AS pair_id, c_name AS symbol, c_mktsegment AS market FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("pair_id"))
    pairs = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return dims.with_pair(tasks, pairs.select(F.col("c_custkey").alias("pair_id"), F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("market")))


_DEFINITIONS = """WITH d AS (SELECT c_custkey AS id, c_mktsegment AS code, c_nationkey AS version, c_acctbal < 0 AS stored FROM customer)
SELECT 0::BIGINT AS user_id, code, version, min(id) AS id FROM d GROUP BY code, version HAVING NOT bool_or(stored)"""


@query("system_definitions", _DEFINITIONS)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    all_ = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("code"), F.col("c_nationkey").alias("version"), F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("stored"))
    kept = all_.filter("stored").withColumn("user_id", F.lit(0).cast("long"))
    return signals.system_definitions(all_, kept, "id").select("user_id", "code", "version", "id")


@query("task_log_page", "SELECT o_orderkey, o_custkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_custkey BETWEEN 10 AND 60 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_custkey between 10 and 60 and o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    return signals.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], size=50)


@query("running_tasks", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS running, bool_or(o_orderstatus = 'P') AS any_running FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("running"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_running"))


@query("enabled_gauge", "SELECT c_mktsegment AS timeframe, count(*) AS enabled FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("timeframe")).agg(F.count("*").alias("enabled"))


@query("active_rows", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey % 2 = 0")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("deleted", F.col("s_nationkey") % 2)
    return rows.filter("deleted = 0").select("s_suppkey", "s_name")


@query("write_stats", "SELECT l_returnflag AS tf, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS written, round(count(*) FILTER (l_linestatus = 'F') * 100.0::DOUBLE / count(*), 6) AS rate, count(*) FILTER (l_linestatus = 'F') * 100.0::DOUBLE / count(*) < 99 AS alert FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tf")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("written"))
    rate = F.col("written") * 100.0 / F.col("total")
    return grouped.select("tf", "total", "written", F.round(rate, 6).alias("rate"), (rate < 99).alias("alert"))


@query("route_messages", "SELECT CASE WHEN event_id % 10 = 9 THEN 'system' WHEN event_type = 'error' THEN 'unknown' WHEN event_id % 2 = 0 THEN 'candle' ELSE 'ticker' END AS channel, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    name = F.when(F.col("event_type") == "error", "other").when(F.col("event_id") % 2 == 0, "candle1m").otherwise("tickers")
    text = F.when(F.col("event_id") % 10 == 9, F.lit('{"event":"login"}')).otherwise(F.to_json(F.struct(F.struct(name.alias("channel")).alias("arg"))))
    rows = table(spark, sf_dir, "events").select(text.alias("message"))
    return rows.groupBy(exchange.channel("message").alias("channel")).agg(F.count("*").alias("n"))


@query("backfill_pages", WITH + f"SELECT symbol, make_timestamp(epoch_us(ts) // 18000000000 * 18000000000) AS page_start, make_timestamp(epoch_us(ts) // 18000000000 * 18000000000) + INTERVAL 300 MINUTE AS page_end, count(*) AS missing FROM (SELECT symbol, unnest(generate_series(TIMESTAMP '{BEGIN}', TIMESTAMP '2024-01-05 23:59:00', INTERVAL 1 MINUTE)) AS ts FROM (SELECT DISTINCT symbol FROM b1)) g ANTI JOIN b1 USING (symbol, ts) GROUP BY ALL")
def _(spark, sf_dir):
    # what a source gives in one page: 300 minutes; only pages with a gap are fetched
    lost = checks.gaps(bars_1m(spark, sf_dir), BEGIN, END).withColumn("page_start", align(F.col("ts"), 300 * MINUTE))
    return lost.groupBy("symbol", "page_start").agg(F.count("*").alias("missing")).select("symbol", "page_start", plus_ms(F.col("page_start"), 300 * MINUTE).alias("page_end"), "missing")


@query("sliding_seen", WITH + "SELECT symbol, w AS ts, count(*) AS seen FROM (SELECT symbol, unnest(generate_series(date_trunc('minute', ts)::TIMESTAMP + INTERVAL 1 MINUTE, date_trunc('minute', ts)::TIMESTAMP + INTERVAL 60 MINUTE, INTERVAL 1 MINUTE)) AS w FROM ticks) GROUP BY ALL")
def _(spark, sf_dir):
    return streams.seen(ticks(spark, sf_dir))


@query("ind_stoch_smoothed", WITH + ", k AS (SELECT symbol, ts, CASE WHEN hh <> ll THEN round((close - ll) / (hh - ll) * 100, 8) END AS k FROM (SELECT *, min(low) OVER w AS ll, max(high) OVER w AS hh FROM h1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))) SELECT symbol, ts, k, CASE WHEN count(k) OVER v = 3 THEN round(avg(k) OVER v, 8) END AS d FROM k WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, sf_dir):
    return indicators.stochastic_smoothed(hourly(spark, sf_dir))


@query("daily_ohlc", "SELECT o_orderdate::DATE AS day, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::INTEGER AS source_count FROM orders GROUP BY 1")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    when = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min_by("o_totalprice", when).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", when).alias("close"), F.count("*").cast("int").alias("source_count"))


@query("incomplete_windows", WITH + "SELECT tf, count(*) AS windows, count(*) FILTER (NOT is_complete) AS incomplete FROM bars GROUP BY tf")
def _(spark, sf_dir):
    return rollup.rollup(bars_1m(spark, sf_dir)).groupBy("tf").agg(F.count("*").alias("windows"), F.count_if(~F.col("is_complete")).alias("incomplete"))


_ARRIVED = "(epoch_us(ts) // 60000000 // 100 * 100 + epoch_us(ts) // 60000000 % 10 * 10 + epoch_us(ts) // 60000000 // 10 % 10)"


@query(
    "continuity_in_order",
    WITH
    + f"""SELECT symbol, ts, n AS seen, n < 60 AS has_gap FROM (SELECT symbol, ts, n, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
FROM (SELECT symbol, ts, {_ARRIVED} AS seq, count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS n FROM b1)) WHERE latest IS NULL OR ts > latest""",
)
def _(spark, sf_dir):
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    arrived = F.floor(minute / 100) * 100 + minute % 10 * 10 + F.floor(minute / 10) % 10
    return checks.continuity(bars_1m(spark, sf_dir).select("symbol", "ts", arrived.alias("seq")), arrival="seq", places=5_000)


@query(
    "series_requests",
    WITH
    + """, r AS (SELECT c_custkey AS pair_id, ['5m', '1h', '4h', '1m', '2h'][1 + c_custkey % 5] AS tf, c_nationkey * 30 AS n, ['click', 'view', '', 'error'][1 + c_custkey % 4] AS listed,
 CASE WHEN c_custkey % 8 = 2 THEN 'view' END AS standard FROM customer WHERE c_custkey <= 60)
SELECT pair_id, tf, symbol, ts::TIMESTAMP AS ts, (ts + tfs.ms * INTERVAL 1 MILLISECOND)::TIMESTAMP AS bar_time, open, high, low, close, volume
FROM (SELECT pair_id, tf, n, CASE WHEN listed <> '' THEN listed ELSE standard END AS symbol FROM r) JOIN bars USING (symbol, tf) JOIN tfs USING (tf)
QUALIFY row_number() OVER (PARTITION BY pair_id, tf ORDER BY ts DESC) <= least(n, 365)""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey <= 60")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    key = F.col("c_custkey").alias("pair_id")
    requests = c.select(key, pick("5m", "1h", "4h", "1m", "2h").alias("tf"), (F.col("c_nationkey") * 30).alias("n"))
    listed = c.select(key, pick("click", "view", "", "error").alias("symbol"))
    standard = c.filter("c_custkey % 8 = 2").select(key, F.lit("view").alias("symbol"))
    return scan.series_for(requests, rollup.rollup(bars_1m(spark, sf_dir)), listed, standard)


@query(
    "pair_lookup",
    """SELECT o_orderkey, o_custkey AS pair_id, c.c_name AS symbol, l.c_mktsegment AS listing, CASE WHEN c.c_custkey IS NULL THEN 'no pair ' || o_custkey WHEN l.c_custkey IS NULL THEN 'pair ' || o_custkey || ' isn''t listed' END AS error
FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_nationkey <> 3 LEFT JOIN customer l ON l.c_custkey = o_custkey AND l.c_acctbal > 0""",
)
def _(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pair_id"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "pair_id")
    pairs, listed = c.filter("c_nationkey <> 3"), c.filter("c_acctbal > 0")
    return dims.pair_info(requests, pairs.select("pair_id", F.col("c_name").alias("symbol")), listed.select("pair_id", F.col("c_mktsegment").alias("listing")))


def _strategies(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("strategy_id"), F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") > 0).cast("int").alias("enabled"))


_STRATEGIES = "SELECT c_custkey AS strategy_id, c_nationkey AS user_id, c_mktsegment AS kind, (c_acctbal > 0)::INTEGER AS enabled FROM customer"


@query("lookup_by_user", f"SELECT * FROM ({_STRATEGIES}) WHERE user_id = 7 AND enabled = 1")
def _(spark, sf_dir):
    return dims.lookup(_strategies(spark, sf_dir), enabled=True, user_id=7)


@query("lookup_by_key", f"SELECT * FROM ({_STRATEGIES}) WHERE user_id = 7 AND strategy_id BETWEEN 1 AND 1000000 AND kind = 'BUILDING'")
def _(spark, sf_dir):
    return dims.matching(dims.lookup(_strategies(spark, sf_dir), user_id=7, kind="BUILDING"), {"enabled": None, "kind": "  "}, since={"strategy_id": 1}, until={"strategy_id": 1_000_000, "user_id": None})


@query("other_intervals", WITH + "SELECT * FROM bars WHERE tf = '1h'")
def _(spark, sf_dir):
    one = bars_1m(spark, sf_dir)
    both = one.withColumn("interval", F.lit("1m")).unionByName(one.withColumn("interval", F.lit("5m")).withColumn("high", F.col("high") + 1))
    return rollup.rollup(both, {"1h": 60 * MINUTE})
