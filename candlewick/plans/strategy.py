"""Queries over rules and decisions: context rows from hourly bars, signals from events, states by the hour."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.timegrid import TIMEFRAMES, plain, plus_ms
from candlewick.operators import conditions, decisions, dims, halo, indicators, quantiles, signals
from candlewick.plans.market import WITH, hourly
from candlewick.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Signals and context rows, in SQL; the same rules as in signals() and context().
_SIG = """, sig AS (SELECT event_id AS intent_id, event_type AS symbol, ts AS received_at, ['BUY', 'SELL', 'FLAT', 'REVERSE'][1 + event_id % 4] AS direction, CASE WHEN event_id % 3 = 0 THEN 'CONSUMED' ELSE 'ACTIVE' END AS status, ts + INTERVAL 12 HOUR AS expired_at, value AS price, event_id // 12 % 24 AS strategy_id FROM events),
ind AS (SELECT symbol, ts, CASE WHEN count(*) OVER w >= 20 THEN round(sum(close::DECIMAL(20, 8)) OVER w::DOUBLE / 20, 8) END::DOUBLE AS v FROM h1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c0 AS (SELECT symbol, ts + INTERVAL 1 HOUR AS bar_time, hour(ts) AS h, open, high, low, close, volume, v FROM h1 JOIN ind USING (symbol, ts)),
c1 AS (SELECT c0.*, intent_id, direction, status, received_at, expired_at FROM c0 ASOF LEFT JOIN (SELECT * FROM sig WHERE status = 'ACTIVE') sig ON c0.symbol = sig.symbol AND c0.h = sig.strategy_id AND c0.bar_time >= sig.received_at),
ctx AS (SELECT symbol, bar_time, h AS strategy_id, CASE symbol WHEN 'click' THEN 'SIGNAL_DRIVEN' WHEN 'view' THEN 'INDICATOR_DRIVEN' WHEN 'error' THEN 'OTHER' ELSE 'HYBRID' END AS strategy_type, ['SIGNAL', 'INDICATOR', 'BAR', 'PRICE'][1 + h % 4] AS trigger_type,
 open AS bar_open, high AS bar_high, low AS bar_low, close AS bar_close, volume AS bar_volume, 'SMA' AS ind_code, v AS ind_value, CASE WHEN h % 7 = 0 THEN 0.0::DOUBLE WHEN h % 7 = 1 THEN NULL ELSE close END AS px_last,
 intent_id AS sig_intent_id, direction AS sig_direction, status AS sig_status, received_at AS sig_received_at, expired_at AS sig_expired_at, coalesce(status = 'ACTIVE' AND expired_at > bar_time, false) AS sig_valid,
 CASE WHEN h = 23 THEN NULL ELSE ['FLAT', 'LONG', 'SHORT'][1 + h % 3] END AS state_side, (h % 5)::DOUBLE AS state_qty, open AS state_entry, CASE WHEN h = 22 THEN NULL ELSE 10000.0::DOUBLE END AS param_capital, CASE WHEN h = 21 THEN 1.0001::DOUBLE WHEN h = 20 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS param_ratio, 0.05::DOUBLE AS param_stop_loss,
 CASE WHEN h = 23 THEN NULL ELSE ['IDLE', 'OPENED', 'OPENED'][1 + h % 3] END AS state_phase, CASE WHEN h % 2 = 0 THEN 0.1::DOUBLE END AS param_take_profit FROM c1)
"""


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL over the bars' and the context's."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = WITH + _SIG + sql
        return f

    return add


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals: (intent_id, symbol, received_at, direction, status, expired_at, price, strategy_id), one for each event."""
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("BUY", "SELL", "FLAT", "REVERSE")))
    return e.select(F.col("event_id").alias("intent_id"), F.col("event_type").alias("symbol"), F.col("ts").alias("received_at"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("direction"), F.when(F.col("event_id") % 3 == 0, "CONSUMED").otherwise("ACTIVE").alias("status"), plus_ms(F.col("ts"), 43_200_000).alias("expired_at"), F.col("value").alias("price"), F.expr("event_id div 12 % 24").alias("strategy_id"))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context row for each hourly bar: as-of signal, indicator, state, parameters."""
    bars = hourly(spark, sf_dir)
    with_ind = halo.windowed(bars, lambda rows, by: rows.withColumn("v", indicators.strict_average(by)), ("symbol",), 19)
    rows = with_ind.withColumn("bar_time", plus_ms(F.col("ts"), TIMEFRAMES["1h"])).withColumn("h", F.hour("ts").cast("long")).withColumn("strategy_id", F.col("h"))
    # the latest active one of a strategy's own: consumed ones don't hide those before them
    sig = intents(spark, sf_dir).filter("status = 'ACTIVE'").select("symbol", "strategy_id", "received_at", F.struct("received_at", "intent_id", "direction", "status", "expired_at").alias("sig"))
    rows = decisions.as_of(rows, sig, ["symbol", "strategy_id"], "bar_time", "received_at", "sig")
    h = F.col("h")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (h % len(xs) + 1).cast("int"))
    kind = F.when(F.col("symbol") == "click", "SIGNAL_DRIVEN").when(F.col("symbol") == "view", "INDICATOR_DRIVEN").when(F.col("symbol") == "error", "OTHER").otherwise("HYBRID")
    out = rows.select(
        "symbol", "bar_time", "strategy_id", kind.alias("strategy_type"), pick("SIGNAL", "INDICATOR", "BAR", "PRICE").alias("trigger_type"), *(F.col(c).alias(f"bar_{c}") for c in ("open", "high", "low", "close", "volume")),
        F.lit("SMA").alias("ind_code"), F.col("v").alias("ind_value"), F.lit(None).cast("map<string,double>").alias("ind_extra"), F.when(h % 7 == 0, F.lit(0.0)).when(h % 7 != 1, F.col("close")).alias("px_last"),
        F.col("sig.intent_id").alias("sig_intent_id"), F.col("sig.direction").alias("sig_direction"), F.col("sig.status").alias("sig_status"), F.col("sig.received_at").alias("sig_received_at"), F.col("sig.expired_at").alias("sig_expired_at"),
        F.when(h != 23, pick("FLAT", "LONG", "SHORT")).alias("state_side"), (h % 5).cast("double").alias("state_qty"), F.col("open").alias("state_entry"), F.when(h != 22, F.lit(10000.0)).alias("param_capital"), F.when(h == 21, F.lit(1.0001)).when(h == 20, F.lit(0.0)).otherwise(F.lit(0.25)).alias("param_ratio"), F.lit(0.05).alias("param_stop_loss"),
        F.when(h != 23, pick("IDLE", "OPENED", "OPENED")).alias("state_phase"), F.when(h % 2 == 0, F.lit(0.1)).alias("param_take_profit"),
    )
    return out.withColumn("sig_valid", decisions.signal_valid(F.col("bar_time")))


@query("decision_context", "SELECT * FROM ctx")
def _(spark, sf_dir):
    return context(spark, sf_dir).drop("ind_extra")


@query("asof_latest_intent", "SELECT symbol, bar_time, sig_intent_id, sig_direction, sig_received_at FROM ctx")
def _(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar_time", "sig_intent_id", "sig_direction", "sig_received_at")


@query("asof_indicator", "SELECT e.event_id, i.v AS value FROM events e ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 HOUR AS t, v FROM ind WHERE v IS NOT NULL) i ON e.event_type = i.symbol AND e.ts >= i.t")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    ind = indicators.sma_strict(hourly(spark, sf_dir)).filter("value is not null").select("symbol", plus_ms(F.col("ts"), TIMEFRAMES["1h"]).alias("t"), F.struct("value").alias("i"))
    return decisions.as_of(e, ind, ["symbol"], "ts", "t", "i").select("event_id", "i.value")


@query("indicator_latest", "SELECT symbol, max(ts) AS ts, arg_max(v, ts) AS value FROM ind GROUP BY symbol")
def _(spark, sf_dir):
    return indicators.sma_strict(hourly(spark, sf_dir)).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


#: Rule trees with what they are in SQL: the state by a CASE over the context's columns.
TREES: dict[str, tuple[dict, str]] = {
    "cond_bar": ({"rules": [{"factor": "BAR.CLOSE", "operator": "GT", "value": "BAR.OPEN"}, {"factor": "BAR.VOLUME", "operator": "GTE", "value": 40}]}, "CASE WHEN bar_close > bar_open AND bar_volume >= 40 THEN 'PASSED' ELSE 'FAILED' END"),
    "cond_ind": ({"rules": [{"factor": "IND.SMA", "operator": "LT", "value": "BAR.CLOSE"}]}, "CASE WHEN ind_value IS NULL THEN 'BLOCKED' WHEN ind_value < bar_close THEN 'PASSED' ELSE 'FAILED' END"),
    "cond_nullable": ({"rules": [{"factor": "IND.SMA", "operator": "LT", "value": "BAR.CLOSE", "nullable": True}]}, "CASE WHEN ind_value < bar_close THEN 'PASSED' ELSE 'FAILED' END"),
    "cond_factor_vs_factor": ({"rules": [{"factor": "BAR.CLOSE", "operator": "GT", "value": "IND.SMA", "nullable": True}]}, "CASE WHEN ind_value IS NULL THEN 'BLOCKED' WHEN bar_close > ind_value THEN 'PASSED' ELSE 'FAILED' END"),
    "cond_ops": ({"mode": "ANY", "rules": [{"factor": "BAR.CLOSE", "operator": "LTE", "value": "20.5"}, {"factor": "STATE.POSITION_QTY", "operator": "EQ", "value": 3}, {"factor": "BAR.OPEN", "operator": "NEQ", "value": "BAR.CLOSE"}, {"factor": "BAR.OPEN", "operator": "BETWEEN", "value": 5}]}, "CASE WHEN bar_close <= 20.5 OR state_qty = 3 OR bar_open <> bar_close THEN 'PASSED' ELSE 'BLOCKED' END"),
    "cond_string_ops": ({"rules": [{"factor": "SIG.DIRECTION", "operator": "STARTS_WITH", "value": "B", "type": "STRING", "nullable": True}, {"factor": "SIG.DIRECTION", "operator": "CONTAINS", "value": "U", "type": "STRING", "nullable": True}, {"factor": "SIG.DIRECTION", "operator": "ENDS_WITH", "value": "Y", "type": "STRING", "nullable": True}]}, "CASE WHEN sig_valid AND sig_direction = 'BUY' THEN 'PASSED' ELSE 'FAILED' END"),
    "cond_coercion": ({"mode": "ANY", "rules": [{"factor": "STATE.POSITION_QTY", "operator": "GT", "value": "3.0", "type": "STRING", "nullable": True}, {"factor": "STATE.POSITION_SIDE", "operator": "EQ", "value": 1}]}, "CASE WHEN state_qty > 3 THEN 'PASSED' ELSE 'BLOCKED' END"),
    "cond_state": ({"rules": [{"factor": "STATE.POSITION_SIDE", "operator": "EQ", "value": "LONG", "type": "STRING"}, {"factor": "BAR.LOW", "operator": "LT", "value": "STATE.STOP_LOSS_PRICE"}]}, "CASE WHEN state_side IS NULL THEN 'BLOCKED' WHEN state_side = 'LONG' AND bar_low < state_entry * (1 - param_stop_loss) THEN 'PASSED' ELSE 'FAILED' END"),
    "cond_prefix": ({"mode": "ANY", "rules": [{"factor": "BAR.CLOSE", "operator": "GT", "value": 30}, {"factor": "ACCOUNT.CASH", "operator": "GT", "value": 1}]}, "CASE WHEN bar_close > 30 THEN 'PASSED' ELSE 'BLOCKED' END"),
    "cond_boolean": ({"rules": [{"factor": "STATE.POSITION_QTY", "operator": "EQ", "value": True, "type": "BOOLEAN", "nullable": True}]}, "CASE WHEN state_qty IS NULL THEN 'FAILED' ELSE 'BLOCKED' END"),
    "cond_empty": ({}, "'BLOCKED'"),
    "cond_tree": (
        {"mode": "ANY", "rules": [{"factor": "PX.LAST", "operator": "GT", "value": 50, "nullable": True}, {"factor": "IND.SMA", "operator": "GT", "value": 30}], "groups": [{"mode": "ALL", "rules": [{"factor": "SIG.INTENT_ID", "operator": "GT", "value": 500}], "groups": [{"mode": "ANY"}]}, {"rules": []}]},
        "CASE WHEN coalesce(px_last > 50, false) THEN 'PASSED' WHEN ind_value IS NULL THEN 'BLOCKED' WHEN ind_value > 30 THEN 'PASSED' WHEN NOT sig_valid THEN 'BLOCKED' ELSE 'PASSED' END",
    ),
}


def _condition(name: str) -> None:
    spec, state = TREES[name]
    query(name, f"SELECT symbol, bar_time, {state} AS state FROM ctx")(lambda spark, sf_dir: context(spark, sf_dir).select("symbol", "bar_time", conditions.compiled(json.dumps(spec), conditions.factors()).state.alias("state")))


for _name in TREES:
    _condition(_name)


@query("cond_trace", "SELECT symbol, bar_time, 'BAR.CLOSE GT BAR.OPEN ' || CASE WHEN bar_close > bar_open THEN 'PASSED' ELSE 'FAILED' END || ';BAR.VOLUME GTE 40 ' || CASE WHEN bar_volume >= 40 THEN 'PASSED' ELSE 'FAILED' END AS trace FROM ctx")
def _(spark, sf_dir):
    out = conditions.compiled(json.dumps(TREES["cond_bar"][0]), conditions.factors())
    said = F.transform(out.hits["rules"], lambda x: F.concat_ws(" ", x["factor"], x["operator"], x["value"], F.when(x["hit"], "PASSED").otherwise("FAILED")))
    return context(spark, sf_dir).select("symbol", "bar_time", F.array_join(said, ";").alias("trace"))


def _hit_text(rules: F.Column) -> F.Column:
    return F.array_join(F.transform(rules, lambda x: F.concat_ws(" ", x["factor"], x["operator"], x["value"], x["reason"])), ";")


@query(
    "cond_hits",
    """SELECT symbol, bar_time, CASE WHEN NOT first AND ind_value IS NULL THEN 'factor has no value: IND.SMA' WHEN NOT first AND NOT second AND NOT sig_valid THEN 'factor has no value: SIG.INTENT_ID' END AS blocked,
 CASE WHEN first THEN 'PX.LAST GT 50 hit' WHEN ind_value IS NULL THEN NULL WHEN second THEN 'PX.LAST GT 50 miss;IND.SMA GT 30 hit' WHEN NOT sig_valid THEN NULL ELSE 'PX.LAST GT 50 miss;IND.SMA GT 30 miss' END AS rules,
 CASE WHEN first THEN '' WHEN ind_value IS NULL THEN NULL WHEN second THEN '' WHEN NOT sig_valid THEN NULL ELSE 'ALL miss: SIG.INTENT_ID GT 500 ' || CASE WHEN sig_intent_id > 500 THEN 'hit' ELSE 'miss' END || '/ALL hit: ' END AS groups
FROM (SELECT *, coalesce(px_last > 50, false) AS first, coalesce(ind_value > 30, false) AS second FROM ctx)""",
)
def _(spark, sf_dir):
    out = conditions.compiled(json.dumps(TREES["cond_tree"][0]), conditions.factors())
    group = lambda g: F.concat(g["mode"], F.when(g["hit"], " hit: ").otherwise(" miss: "), _hit_text(g["rules"]))
    return context(spark, sf_dir).select("symbol", "bar_time", out.reason.alias("blocked"), _hit_text(out.hits["rules"]).alias("rules"), F.array_join(F.transform(out.hits["groups"], group), "/").alias("groups"))


_PHASE = "CASE WHEN state_side IS NULL THEN 'PhaseGate: no state' END"
_STALE = """coalesce(CASE WHEN trigger_type = 'SIGNAL' THEN CASE WHEN sig_intent_id IS NULL THEN 'StalenessGate: no signal' WHEN NOT sig_valid THEN 'StalenessGate: invalid signal' WHEN epoch_us(bar_time) // 1000000 - epoch_us(sig_received_at) // 1000000 > 30 THEN 'StalenessGate: old signal' END END,
 CASE WHEN strategy_type IN ('INDICATOR_DRIVEN', 'HYBRID') AND ind_value IS NULL THEN 'StalenessGate: no indicator' END)"""
_SANITY = "CASE WHEN coalesce(param_capital <= 0, true) THEN 'SanityGate: capital' WHEN param_ratio <= 0 THEN 'SanityGate: ratio' WHEN param_ratio > 1 THEN 'SanityGate: ratio over 1' WHEN px_last <= 0 THEN 'SanityGate: price' END"
_KEY = """trigger_type || ':' || strategy_id || ':' || symbol || ':' || CASE trigger_type WHEN 'SIGNAL' THEN sig_intent_id::VARCHAR WHEN 'INDICATOR' THEN 'SMA:' || epoch_us(bar_time) // 1000000 WHEN 'BAR' THEN '1h:' || epoch_us(bar_time) // 1000000 ELSE 'PRICE:' || epoch_us(bar_time) // 1000000 // 5 * 5 END"""
_GUARD = f""", g0 AS (SELECT *, coalesce({_PHASE}, {_STALE}) AS early, {_KEY} AS k FROM ctx),
g AS (SELECT *, coalesce(early, CASE WHEN early IS NULL AND k IS NOT NULL AND epoch_us(bar_time) - epoch_us(lag(bar_time) OVER (PARTITION BY k, early IS NULL ORDER BY bar_time, sig_intent_id)) < 1000000::BIGINT * CASE trigger_type WHEN 'BAR' THEN 86400 WHEN 'PRICE' THEN 6 ELSE 3600 END THEN 'DedupGate: repeated' END, {_SANITY}) AS reject FROM g0)
"""


@query("staleness_gate", f"SELECT symbol, bar_time, {_STALE} AS reject FROM ctx")
def _(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar_time", decisions.staleness_gate(F.col("bar_time")).alias("reject"))


@query("sanity_gate", f"SELECT symbol, bar_time, {_SANITY} AS reject FROM ctx")
def _(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar_time", decisions.sanity_gate().alias("reject"))


@query("dedup_gate", f"SELECT {_KEY} AS key, count(*) AS n, min(bar_time) AS first_time FROM ctx GROUP BY 1")
def _(spark, sf_dir):
    return context(spark, sf_dir).groupBy(decisions.dedup_key(F.col("bar_time")).alias("key")).agg(F.count("*").alias("n"), F.min("bar_time").alias("first_time"))


@query("guard_chain", _GUARD + "SELECT symbol, bar_time, reject FROM g")
def _(spark, sf_dir):
    return decisions.guarded(context(spark, sf_dir), "bar_time").select("symbol", "bar_time", "reject")


_FLAT = "(state_side = 'FLAT' OR state_qty = 0)"
_BY_SIGNAL = f"""CASE WHEN NOT (sig_valid AND param_capital IS NOT NULL) THEN 'HOLD' WHEN {_FLAT} THEN CASE WHEN sig_direction IN ('BUY', 'SELL', 'REVERSE') THEN 'OPEN' ELSE 'HOLD' END
 WHEN state_side = 'LONG' AND sig_direction IN ('SELL', 'FLAT') THEN 'CLOSE' WHEN state_side = 'SHORT' AND sig_direction IN ('BUY', 'FLAT') THEN 'CLOSE' WHEN state_side IN ('LONG', 'SHORT') AND sig_direction = 'REVERSE' THEN 'REVERSE' ELSE 'HOLD' END"""
_BY_INDICATOR = f"CASE WHEN {_FLAT} THEN CASE WHEN ind_value < bar_close THEN 'OPEN' ELSE 'HOLD' END WHEN {TREES['cond_bar'][1]} = 'PASSED' THEN 'CLOSE' ELSE 'HOLD' END"
_HYBRID = f"CASE WHEN ({_BY_SIGNAL}) <> 'HOLD' THEN {_BY_SIGNAL} ELSE {_BY_INDICATOR} END"


def _trees() -> tuple[conditions.Outcome, conditions.Outcome]:
    known = conditions.factors()
    return conditions.tree(TREES["cond_ind"][0], known), conditions.tree(TREES["cond_bar"][0], known)


@query("decide_signal", f"SELECT symbol, bar_time, {_BY_SIGNAL} AS action FROM ctx")
def _(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar_time", decisions.by_signal().alias("action"))


@query("decide_indicator", f"SELECT symbol, bar_time, {_BY_INDICATOR} AS action FROM ctx")
def _(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar_time", decisions.by_indicator(*_trees()).alias("action"))


@query("decide_hybrid", f"SELECT symbol, bar_time, {_HYBRID} AS action FROM ctx")
def _(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar_time", decisions.hybrid(*_trees()).alias("action"))


_DECIDE = f"CASE strategy_type WHEN 'SIGNAL_DRIVEN' THEN {_BY_SIGNAL} WHEN 'INDICATOR_DRIVEN' THEN {_BY_INDICATOR} WHEN 'HYBRID' THEN {_HYBRID} ELSE 'HOLD' END"
_QTY = "CASE WHEN action = 'HOLD' THEN 0.0::DOUBLE ELSE coalesce((param_capital::DECIMAL(20, 8) * param_ratio::DECIMAL(10, 4))::DOUBLE, 0.0::DOUBLE) END"


@query("order_qty", f"SELECT symbol, bar_time, {_QTY} AS qty FROM (SELECT *, {_DECIDE} AS action FROM ctx)")
def _(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar_time", decisions.order_quantity(decisions.decide(*_trees())).alias("qty"))


@query("decisions", _GUARD + f"SELECT strategy_id, symbol, bar_time, action, {_QTY} AS qty, trigger_type || '/' || state_side || '/' || strategy_type || '/' || coalesce(sig_intent_id::VARCHAR, '-') AS reason FROM (SELECT *, {_DECIDE} AS action FROM g WHERE reject IS NULL) WHERE action <> 'HOLD'")
def _(spark, sf_dir):
    rows = decisions.guarded(context(spark, sf_dir), "bar_time").filter("reject is null").withColumn("action", decisions.decide(*_trees())).filter("action <> 'HOLD'")
    reason = F.concat_ws("/", "trigger_type", "state_side", "strategy_type", F.coalesce(F.col("sig_intent_id").cast("string"), F.lit("-")))
    return rows.select("strategy_id", "symbol", "bar_time", "action", decisions.order_quantity(F.col("action")).alias("qty"), reason.alias("reason"))


_REASONS = """
SELECT strategy_id, symbol, bar_time, trigger_type, position_side, position_qty, intent_id, ind_value, close, price, capital, state_change,
 CASE WHEN action = 'HOLD' THEN 'HOLD' WHEN strategy_type = 'SIGNAL_DRIVEN' OR (strategy_type = 'HYBRID' AND signalled) THEN intent_id::VARCHAR ELSE 'SMA' END AS trigger_source
FROM (SELECT strategy_id, symbol, bar_time, trigger_type, strategy_type, action, state_side AS position_side, CASE WHEN state_side IS NOT NULL THEN state_qty END AS position_qty, sig_intent_id AS intent_id, ind_value, bar_close AS close,
  CASE WHEN px_last > 0 THEN px_last END AS price, param_capital AS capital, coalesce(state_side, 'FLAT') || ' -> ' || action AS state_change,
  sig_valid AND param_capital IS NOT NULL AND CASE WHEN state_side = 'FLAT' OR state_qty = 0 THEN sig_direction IN ('BUY', 'SELL', 'REVERSE')
   WHEN state_side = 'LONG' THEN sig_direction IN ('SELL', 'FLAT', 'REVERSE') WHEN state_side = 'SHORT' THEN sig_direction IN ('BUY', 'FLAT', 'REVERSE') ELSE false END AS signalled
 FROM (SELECT *, {} AS action FROM ctx))"""


@query("decision_reasons", _REASONS.format(_DECIDE))
def _(spark, sf_dir):
    rows = context(spark, sf_dir).withColumn("action", decisions.decide(*_trees()))
    rows = rows.select("strategy_id", "symbol", "bar_time", decisions.reason_document(F.col("action")).alias("reason"))
    get = lambda path, kind="string": F.get_json_object("reason", f"$.{path}").cast(kind)
    return rows.select(
        "strategy_id", "symbol", "bar_time", get("trigger.type").alias("trigger_type"), get("trigger.source").alias("trigger_source"),
        get("logicStateBefore.positionSide").alias("position_side"), get("logicStateBefore.positionQty", "double").alias("position_qty"),
        get("snapshots.signal.intentId", "long").alias("intent_id"), get("snapshots.indicator.value", "double").alias("ind_value"),
        get("snapshots.bar.close", "double").alias("close"), get("snapshots.price.current", "double").alias("price"),
        get("paramsDigest.initialCapital", "double").alias("capital"), get("stateChange").alias("state_change"),
    )


@query("decision_history", _GUARD + f"SELECT symbol, bar_time, action FROM (SELECT *, {_DECIDE} AS action FROM g WHERE reject IS NULL) WHERE action <> 'HOLD' AND symbol = 'click' AND bar_time BETWEEN '2024-01-03' AND '2024-01-20' ORDER BY bar_time DESC, strategy_id LIMIT 25")
def _(spark, sf_dir):
    found = QUERIES["decisions"](spark, sf_dir).filter("symbol = 'click' and bar_time between timestamp_ntz'2024-01-03' and timestamp_ntz'2024-01-20'")
    return found.orderBy(F.desc("bar_time"), "strategy_id").limit(25).select("symbol", "bar_time", "action")


def payloads(events: DataFrame) -> DataFrame:
    """(event_id, ts, payload): events as webhook signals in JSON, some with numbers that don't parse."""
    words = F.element_at(F.array(*map(F.lit, ("buy", "Go LONG", "sell", "x-short", "close", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    price = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string"))
    quantity = F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 50 + 0.5)
    payload = F.to_json(F.struct(words.alias("action"), price.alias("price"), quantity.alias("quantity"), (F.col("event_id") % 7).alias("qty"), F.col("event_type")))
    return events.select("event_id", "ts", payload.alias("payload"))


@query("signal_parse", "SELECT event_id, direction, price, quantity, event_type FROM (SELECT event_id, CASE WHEN a LIKE '%BUY%' OR a LIKE '%LONG%' THEN 'LONG' WHEN a LIKE '%SELL%' OR a LIKE '%SHORT%' THEN 'SHORT' ELSE 'NEUTRAL' END AS direction, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS price, CASE WHEN event_id % 2 = 0 THEN event_id % 50 + 0.5 ELSE event_id % 7 END::DOUBLE AS quantity, upper(event_type) AS event_type FROM (SELECT *, upper(coalesce(['buy', 'Go LONG', 'sell', 'x-short', 'close', ''][1 + event_id % 6], '')) AS a FROM events))")
def _(spark, sf_dir):
    found = signals.parsed(payloads(table(spark, sf_dir, "events")), "payload")
    return found.select("event_id", "direction", "price", "quantity", "event_type")


@query("signals_latest", "SELECT intent_id, symbol, received_at, direction FROM sig ORDER BY received_at DESC, intent_id DESC LIMIT 40")
def _(spark, sf_dir):
    return intents(spark, sf_dir).orderBy(F.desc("received_at"), F.desc("intent_id")).limit(40).select("intent_id", "symbol", "received_at", "direction")


@query("indicator_values", "SELECT symbol, ts, 'SMA' AS code, v AS value, NULL::VARCHAR AS extra FROM (SELECT symbol, ts, round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 8) AS v FROM h1) UNION ALL SELECT symbol, ts, 'Stochastic', NULL, CASE WHEN hh <> ll THEN 'd=' || k || ',k=' || k ELSE 'd=,k=' END FROM (SELECT *, CASE WHEN hh <> ll THEN round((close - ll) / (hh - ll) * 100, 8)::DECIMAL(18, 4)::VARCHAR END AS k FROM (SELECT *, min(low) OVER w AS ll, max(high) OVER w AS hh FROM h1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)))")
def _(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    both = indicators.values(bars, "SMA", period="20").unionByName(indicators.values(bars, "Stochastic", kPeriod="x"))
    pairs = F.array_sort(F.transform(F.map_entries("extra_values"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("decimal(18,4)").cast("string"), F.lit("")))))
    return both.select("symbol", "ts", "code", "value", F.array_join(pairs, ",").alias("extra"))


@query("indicator_values_page", "SELECT symbol, ts, v AS value, count(*) OVER () AS total FROM ind WHERE symbol = 'view' AND v IS NOT NULL AND ts BETWEEN '2024-01-04' AND '2024-01-25' ORDER BY ts DESC LIMIT 20 OFFSET 40")
def _(spark, sf_dir):
    stored = indicators.sma_strict(hourly(spark, sf_dir)).filter("value is not null")
    rows = dims.matching(stored, {"symbol": "view", "value": None}, since={"ts": "2024-01-04"}, until={"ts": "2024-01-25"})
    return signals.page(rows, [F.desc("ts")], page=3, size=20)


@query("calc_log", "SELECT symbol, code, CASE WHEN code = 'SMA' THEN 'SUCCESS' ELSE 'FAILED' END AS status, n FROM (SELECT symbol, count(*) AS n FROM h1 GROUP BY symbol), (VALUES ('SMA'), ('KDJ'), ('NONE')) c(code)")
def _(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    rows = [indicators.values(bars, code) for code in ("SMA", "KDJ", "NONE")]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    status = F.when(F.col("value").isNull() & F.col("extra_values").isNull(), "FAILED").otherwise("SUCCESS")
    return both.groupBy("symbol", "code", status.alias("status")).agg(F.count("*").alias("n"))


@query("calc_log_page", "SELECT event_id, ts, event_type AS status, count(*) OVER () AS total FROM events WHERE event_type = 'error' AND ts >= '2024-01-10' AND ts <= '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error' and ts between timestamp'2024-01-10' and timestamp'2024-01-20'").select("event_id", "ts", F.col("event_type").alias("status"))
    return signals.page(rows, [F.desc("ts"), F.desc("event_id")], page=2, size=50)


@query(
    "calc_cost_percentiles",
    """SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, round(sum(value::DECIMAL(18, 2))::DOUBLE / count(*), 6) AS mean,
 quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*"), 6)
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), mean.alias("mean"))
    return sums.join(quantiles.exact(e, ["event_type"], "value", {"p50": "0.5", "p95": "0.95", "p99": "0.99"}), "event_type", "left")


@query("fingerprint", "SELECT p_partkey, sha256(p_brand || ':' || p_size || ':' || 'brand=' || p_brand || ',size=' || p_size || ',type=' || p_type || ':ta') AS fingerprint FROM part")
def _(spark, sf_dir):
    params = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", indicators.fingerprint(F.col("p_brand"), F.col("p_size").cast("string"), params, F.lit("ta")).alias("fingerprint"))


@query("indicator_conflicts", "SELECT symbol, ts, v AS stored, round(v + 1, 8) AS computed FROM ind WHERE v IS NOT NULL AND day(ts) % 3 = 0")
def _(spark, sf_dir):
    old = indicators.sma_strict(hourly(spark, sf_dir)).filter("value is not null").withColumn("fp", F.lit("a"))
    new = old.withColumn("value", F.when(F.dayofmonth("ts") % 3 == 0, F.round(F.col("value") + 1, 8)).otherwise(F.col("value"))).withColumn("fp", F.when(F.dayofmonth("ts") % 6 == 1, "a").otherwise("b"))
    return signals.conflicts(old, new, ["symbol", "ts"])


@query("indicator_insert_ignore", "SELECT symbol, ts, CASE WHEN day(ts) % 2 = 0 THEN v ELSE v + 5 END AS value FROM ind WHERE v IS NOT NULL")
def _(spark, sf_dir):
    rows = indicators.sma_strict(hourly(spark, sf_dir)).filter("value is not null")
    old = rows.filter(F.dayofmonth("ts") % 2 == 0)
    incoming = rows.withColumn("value", F.col("value") + 5).withColumn("seq", F.lit(1)).unionByName(rows.withColumn("value", F.col("value") + 9).withColumn("seq", F.lit(2)))
    return old.unionByName(signals.fresh(incoming, old, ["symbol", "ts"], "seq").drop("seq"))
