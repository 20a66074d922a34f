"""Streaming queries, run over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.timegrid import TIMEFRAMES, plain
from candlewick.operators import decisions
from candlewick.plans.market import ORACLES as ORACLES_OF_BARS
from candlewick.plans.market import WITH
from candlewick.plans.strategy import ORACLES as ORACLES_OF_RULES
from candlewick.plans import strategy
from candlewick.plans.strategy import context, payloads
from candlewick.sources.store import Store
from candlewick.sources.tables import as_ticks, bars_1m, in_utc, table
from candlewick.sources.written import new_folder
from candlewick.streaming import bars, fanout, keyed, monitor, series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of ticks, by the same expressions as the table's: numbers that don't parse are null."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_ticks(in_utc(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")))


def run_to_store(stream: DataFrame, keys: list[str], arrival: str | None = None, name: str = "query", store: Store | None = None) -> Store:
    """Run a stream over all that is there into ``store``, or one of its own."""
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    if store is None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
        store = Store(spark, f"{base}/store", schema, keys, next(f.name for f in stream.schema if f.dataType.typeName() == "timestamp"), arrival)
    with keyed.keyed_state(spark):
        query = stream.writeStream.foreachBatch(store.sink(name)).option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def _bars_of(tf: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Bars of one timeframe whose windows the watermark has passed."""
        ticks = bars.deduplicated(tick_stream(spark, sf_dir), ["event_id"])
        return plain(run_to_store(bars.windowed(ticks, tf, watermarked=True), ["symbol", "ts"]).read())

    return run


for _tf, _ms in TIMEFRAMES.items():
    QUERIES[f"stream_bars_{_tf}"] = _bars_of(_tf)
    ORACLES[f"stream_bars_{_tf}"] = (
        WITH
        + f"""SELECT symbol, ts, open, high, low, close, volume, n AS source_count
FROM (SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE tf = '{_tf}')
JOIN (SELECT symbol, make_timestamp(epoch_us(ts) // {_ms * 1000} * {_ms * 1000}) AS ts, count(*)::INTEGER AS n FROM ticks GROUP BY ALL) USING (symbol, ts)
WHERE epoch_us(ts) + {_ms * 1000} <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM ticks)"""
    )


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as a record of one append-only log: errors and all others come by two streams that both begin with batch 0."""
    ticks, error = tick_stream(spark, sf_dir), F.col("symbol").eqNullSafe("error")
    store = run_to_store(ticks.filter(error), [], name="errors")
    return plain(run_to_store(ticks.filter(~error), [], name="others", store=store).read())


QUERIES["log_append"] = log_append
ORACLES["log_append"] = WITH + "SELECT event_id, symbol, ts::TIMESTAMP AS ts, price, volume FROM ticks"


def save_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saving bars in three batches came to, by two writers and with one batch twice: inserted and skipped of each."""
    rows = bars_1m(spark, sf_dir)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    store = Store(spark, new_folder(spark, "store"), schema, ["symbol", "ts"])
    halves = {"first": rows.filter("minute(ts) < 40"), "second": rows.filter("minute(ts) >= 20"), "all": rows}
    for number, (name, some) in enumerate([*halves.items(), ("first", halves["first"])]):
        store.save(some, name, 0 if name == "first" else number)
    found = spark.createDataFrame([(c["stream"], c["inserted"], c["skipped"]) for c in store.log()], "batch string, inserted long, skipped long")
    return found.withColumn("stored", F.lit(store.read().count()))


QUERIES["save_report"] = save_report
ORACLES["save_report"] = (
    WITH
    + """SELECT batch, inserted, total - inserted AS skipped, (SELECT count(*) FROM b1) AS stored FROM (
SELECT 'first' AS batch, count(*) FILTER (minute(ts) < 40) AS inserted, count(*) FILTER (minute(ts) < 40) AS total FROM b1
UNION ALL SELECT 'second', count(*) FILTER (minute(ts) >= 40), count(*) FILTER (minute(ts) >= 20) FROM b1
UNION ALL SELECT 'all', 0, count(*) FROM b1)"""
)


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks of a stream that a cooldown of an hour for each symbol lets pass."""
    found = keyed.cooled_down(tick_stream(spark, sf_dir).select("event_id", F.col("symbol").alias("key"), "ts"), 3600)
    return plain(run_to_store(found.select("key", "ts"), ["key", "ts"]).read())


QUERIES["stream_cooldown"] = stream_cooldown
ORACLES["stream_cooldown"] = ORACLES_OF_BARS["cooldown_filter"]


def stream_guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard chain over context rows as a stream: keys are held in state, with timers."""
    path = new_folder(spark, "context")
    context(spark, sf_dir).write.parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    found = keyed.guarded(rows, "bar_time").select("symbol", "bar_time", "strategy_id", "reject")
    return plain(run_to_store(found, ["symbol", "bar_time", "strategy_id"]).read().drop("strategy_id"))


QUERIES["stream_guard_chain"] = stream_guard_chain
ORACLES["stream_guard_chain"] = ORACLES_OF_RULES["guard_chain"]


_CLOSED = "epoch_us(ts) + 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM ticks)"


def closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as a stream, each when the watermark has passed its end."""
    return bars.windowed(bars.deduplicated(tick_stream(spark, sf_dir), ["event_id"]), "1h", watermarked=True)


def stream_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, strength and MACD of hourly bars: bars close on one stream, and are the input of another that keeps the series."""
    closed = run_to_store(closed_hours(spark, sf_dir), ["symbol", "ts"]).read()
    path = new_folder(spark, "closed-bars")
    closed.select("symbol", "ts", "close").write.parquet(path)
    rows = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(path)
    return plain(run_to_store(series.indicators(rows), ["symbol", "ts"]).read())


def _of(name: str) -> str:
    return "(" + ORACLES_OF_BARS[f"ind_{name}"].removeprefix(WITH) + ")"


QUERIES["stream_indicators"] = stream_indicators
ORACLES["stream_indicators"] = (
    WITH
    + f"""SELECT symbol, ts::TIMESTAMP AS ts, e.value AS ema, r.value AS rsi, macd, signal, histogram
FROM {_of("ema")} e JOIN {_of("rsi")} r USING (symbol, ts) JOIN {_of("macd")} m USING (symbol, ts) WHERE {_CLOSED}"""
)


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subscriptions: several configurations of a nation's user on a symbol."""
    names = F.element_at(F.array(*map(F.lit, ("click", "view", "error", "none"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(names.alias("symbol"), F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("config_id"), (F.col("c_acctbal") > 0).cast("int").alias("enabled"))


def stream_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as they close, for each user who has subscribed to their symbol."""
    found = fanout.subscribers(closed_hours(spark, sf_dir).select("symbol", "ts", "close"), _subscriptions(spark, sf_dir))
    rows = run_to_store(found.select("symbol", "ts", "close", "user_id", F.size("configs").alias("configs"), F.array_min("configs").alias("first_config")), ["symbol", "ts", "user_id"]).read()
    return plain(rows)


QUERIES["stream_subscribers"] = stream_subscribers
ORACLES["stream_subscribers"] = (
    WITH
    + f"""SELECT symbol, ts::TIMESTAMP AS ts, close, user_id, configs, first_config FROM h1
JOIN (SELECT ['click', 'view', 'error', 'none'][1 + c_custkey % 4] AS symbol, c_nationkey AS user_id, count(DISTINCT c_custkey)::INTEGER AS configs, min(c_custkey) AS first_config
 FROM customer WHERE c_acctbal > 0 GROUP BY ALL) USING (symbol) WHERE {_CLOSED}"""
)


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook signals on a stream with the configuration of their key, where one is enabled."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = in_utc(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    stream = payloads(events).withColumn("signal_key", F.concat(F.lit("k"), F.col("event_id") % 40))
    configs = table(spark, sf_dir, "customer").filter("c_custkey <= 30")
    configs = configs.select(F.concat(F.lit("k"), F.col("c_custkey")).alias("signal_key"), F.col("c_custkey").alias("signal_config_id"), F.col("c_nationkey").alias("user_id"), (F.col("c_acctbal") > 0).cast("int").alias("enabled"))
    found = fanout.configured(stream, configs).select("event_id", "ts", "direction", "price", "quantity", "signal_config_id", "user_id")
    return plain(run_to_store(found, ["event_id"]).read())


QUERIES["stream_signals"] = stream_signals
ORACLES["stream_signals"] = f"""SELECT event_id, ts::TIMESTAMP AS ts, direction, price, quantity, signal_config_id, user_id
FROM ({ORACLES_OF_RULES["signal_parse"]}) JOIN (SELECT event_id, ts FROM events) USING (event_id)
LEFT JOIN (SELECT c_custkey AS signal_config_id, c_nationkey AS user_id FROM customer WHERE c_custkey <= 30 AND c_acctbal > 0) ON event_id % 40 = signal_config_id"""


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two streams of writes report of themselves, with the alerts that follow: one is slow and loses writes, one isn't."""
    found = monitor.Metrics("good", "bad")
    for name, latency, lost in (("good", F.lit(2.5), 0), ("bad", F.col("volume"), 20)):
        rows = tick_stream(spark, sf_dir).select("event_id", "ts", latency.alias("latency_ms"), (F.col("event_id") % 100 >= lost).alias("written"))
        query = monitor.observed(rows, name).writeStream.format("noop").option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()
        for progress in query.recentProgress:
            found.add(progress)
    return monitor.alerts(found.table(spark))


QUERIES["stream_alerts"] = stream_alerts
ORACLES["stream_alerts"] = (
    WITH
    + """SELECT stream, count(*) AS total, count(*) FILTER (w) AS written, round(count(*) FILTER (w) * 100.0::DOUBLE / count(*), 6) AS rate, min(ms) AS min_ms, max(ms) AS max_ms, round(sum(ms) / count(*), 6) AS mean_ms,
 concat_ws(',', CASE WHEN max(ms) > 10 THEN 'LATENCY' END, CASE WHEN count(*) FILTER (w) * 100.0::DOUBLE / count(*) < 99 THEN 'WRITE_RATE' END) AS alerts
FROM (SELECT 'good' AS stream, 2.5::DOUBLE AS ms, true AS w FROM ticks UNION ALL SELECT 'bad', volume, event_id % 100 >= 20 FROM ticks) GROUP BY stream"""
)


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that act, recorded once with their whole reason as a document, and read back from the log."""
    rows = decisions.guarded(context(spark, sf_dir), "bar_time").filter("reject is null").withColumn("action", decisions.decide(*strategy._trees())).filter("action <> 'HOLD'")
    records = rows.select("strategy_id", "symbol", "bar_time", "action", decisions.order_quantity(F.col("action")).alias("qty"), F.col("sig_intent_id").alias("signal_id"), decisions.reason_document(F.col("action")).alias("reason"))
    schema = "strategy_id long, symbol string, bar_time timestamp, action string, qty double, signal_id long, reason string"
    store = Store(spark, new_folder(spark, "decisions"), schema, ["strategy_id", "symbol", "bar_time"], ts="bar_time")
    for batch in range(2):  # the second time nothing is new
        store.save(records, "decisions", batch)
    get = lambda path, kind="string": F.get_json_object("reason", f"$.{path}").cast(kind)
    found = store.read().select(
        "strategy_id", "symbol", "bar_time", "action", "qty", "signal_id", get("logicStateBefore.phase").alias("phase"), get("paramsDigest.takeProfitRatio", "double").alias("take_profit"),
        get("paramsDigest.stopLossRatio", "double").alias("stop_loss"), get("decisionBasis.strategyType").alias("strategy_type"), get("stateChange").alias("state_change"),
    )
    return plain(found)


QUERIES["decision_log"] = decision_log
ORACLES["decision_log"] = (
    strategy.WITH
    + strategy._SIG
    + strategy._GUARD
    + f"""SELECT strategy_id, symbol, bar_time::TIMESTAMP AS bar_time, action, {strategy._QTY} AS qty, sig_intent_id AS signal_id, state_phase AS phase, param_take_profit AS take_profit, param_stop_loss AS stop_loss,
 strategy_type, coalesce(state_side, 'FLAT') || ' -> ' || action AS state_change FROM (SELECT *, {strategy._DECIDE} AS action FROM g WHERE reject IS NULL) WHERE action <> 'HOLD'"""
)
