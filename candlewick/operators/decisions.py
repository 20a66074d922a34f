"""Decisions from context rows: guards, logic by strategy type, quantities, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import halo
from candlewick.operators.conditions import PASSED, Outcome

MAX_AGE_S = 30
COOLDOWN_S = 5
REPEATED = "DedupGate: repeated"
#: Seconds that a key of a trigger's type is held.
TTL_S = {"SIGNAL": 3600, "INDICATOR": 3600, "BAR": 86_400, "PRICE": COOLDOWN_S + 1}


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, span_ms: int = halo.SPAN_MS) -> DataFrame:
    """Each row of ``left`` with the latest struct ``value`` of ``right`` at or before its time.

    Of rows of ``right`` with one time the last by value counts; a row of ``left`` sees those with its own time. A key is
    cut into chunks of time: within one, both sides are one sorted stream; what a chunk finds nothing for has the last
    value of the chunks before it, which comes from one row for each chunk. No pairs, and no task has all of a key.
    """
    a = left.withColumn("_t", F.col(left_ts)).withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), value)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_chunk", halo.chunk_of(both, "_t", span_ms))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_side", value).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last(value, ignorenulls=True).over(inside)).filter("_side = 1")
    last = F.max(F.when(F.col("_side") == 0, F.struct("_t", value)))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.filter(F.col("_t").isNotNull() & (F.col(value).isNotNull() | (F.col("_side") == 1))).groupBy(*keys, "_chunk").agg(last.alias("_last"))
    carried = carried.withColumn("_carried", F.last(F.col(f"_last.{value}"), ignorenulls=True).over(earlier)).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_chunk").alias("_of_chunk"), "_carried")
    same = F.col("_chunk") == F.col("_of_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    met = found.join(carried, same, "left").withColumn(value, F.coalesce("_found", "_carried"))
    return met.drop("_t", "_side", "_chunk", "_found", "_carried", "_of_chunk", *(f"_of_{k}" for k in keys))


def signal_valid(as_of_ts: Column) -> Column:
    """An active signal that hasn't expired at an instant; the instant is a column, never the clock."""
    return F.coalesce((F.col("sig_status") == "ACTIVE") & (F.col("sig_expired_at").isNull() | (F.col("sig_expired_at") > as_of_ts)), F.lit(False))


def is_flat() -> Column:
    """No position: side FLAT or quantity 0."""
    return (F.col("state_side") == "FLAT") | (F.col("state_qty") == 0)


def has_indicator() -> Column:
    """An indicator with a value, or with named values."""
    return F.col("ind_value").isNotNull() | (F.coalesce(F.size("ind_extra"), F.lit(0)) > 0)


def phase_gate() -> Column:
    """Why a row is rejected for its state, or null."""
    return F.when(F.col("state_side").isNull(), "PhaseGate: no state")


def staleness_gate(as_of_ts: Column) -> Column:
    """Why a row's signal or indicator is too old or not there, or null."""
    age = F.unix_seconds(as_of_ts) - F.unix_seconds("sig_received_at")
    by_signal = F.when(F.col("sig_intent_id").isNull(), "StalenessGate: no signal").when(~F.col("sig_valid"), "StalenessGate: invalid signal").when(age > MAX_AGE_S, "StalenessGate: old signal")
    by_indicator = F.when(F.col("strategy_type").isin("INDICATOR_DRIVEN", "HYBRID") & ~has_indicator(), "StalenessGate: no indicator")
    return F.coalesce(F.when(F.col("trigger_type") == "SIGNAL", by_signal), by_indicator)


def dedup_key(as_of_ts: Column, timeframe: str = "1h") -> Column:
    """What makes a trigger unique: its signal, indicator bar, bar of ``timeframe``, or five seconds; null lets it pass."""
    slot = F.floor(F.unix_seconds(as_of_ts) / COOLDOWN_S) * COOLDOWN_S
    unique = (
        F.when(F.col("trigger_type") == "SIGNAL", F.col("sig_intent_id").cast("string"))
        .when(F.col("trigger_type") == "INDICATOR", F.concat_ws(":", "ind_code", F.unix_seconds("bar_time").cast("string")))
        .when(F.col("trigger_type") == "BAR", F.concat(F.lit(f"{timeframe}:"), F.unix_seconds("bar_time").cast("string")))
        .when(F.col("trigger_type") == "PRICE", F.concat(F.lit("PRICE:"), slot.cast("string")))
    )
    return F.when(unique.isNotNull(), F.concat_ws(":", "trigger_type", "strategy_id", "symbol", unique))


def sanity_gate() -> Column:
    """Why a row's parameters or price can't be used, or null."""
    return (
        F.when(F.coalesce(F.col("param_capital") <= 0, F.lit(True)), "SanityGate: capital")
        .when(F.coalesce(F.col("param_ratio") <= 0, F.lit(True)), "SanityGate: ratio")
        .when(F.col("param_ratio") > 1, "SanityGate: ratio over 1")
        .when(F.col("px_last") <= 0, "SanityGate: price")
    )


def with_keys(rows: DataFrame, as_of_ts: str, timeframe: str = "1h") -> DataFrame:
    """Add ``_early`` (why the first gates reject a row), ``_key`` (null where none is to be held) and ``_hold`` (for how many microseconds)."""
    rows = rows.withColumn("_early", F.coalesce(phase_gate(), staleness_gate(F.col(as_of_ts))))
    rows = rows.withColumn("_key", F.when(F.col("_early").isNull(), dedup_key(F.col(as_of_ts), timeframe)))
    hold = F.element_at(F.create_map(*(F.lit(x) for k, v in TTL_S.items() for x in (k, v * 1_000_000))), F.col("trigger_type"))
    return rows.withColumn("_hold", F.coalesce(hold, F.lit(3_600_000_000)))


def _taken(keyed: DataFrame) -> DataFrame:
    """(_key, _us) at which keys are taken, from (_key, _us, _hold).

    A key's times are cut where none comes for its hold, and each part is folded once, in order. Keys hold a signal, a
    bar or five seconds, so that parts are short; ``checks.cooldown`` is for keys that go on.
    """
    order = Window.partitionBy("_key").orderBy("_us")
    apart = F.coalesce(F.col("_us") - F.lag("_us").over(order) >= F.col("_hold"), F.lit(True)).cast("int")
    parts = keyed.distinct().withColumn("_apart", apart).withColumn("_part", F.sum("_apart").over(order))
    times = parts.groupBy("_key", "_hold", "_part").agg(F.array_sort(F.collect_list("_us")).alias("t"))
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= F.col("_hold")), F.concat(acc, F.array(x))).otherwise(acc)
    return times.select("_key", F.explode(F.aggregate("t", F.array().cast("array<bigint>"), step)).alias("_us"))


def guarded(rows: DataFrame, as_of_ts: str, timeframe: str = "1h") -> DataFrame:
    """Add ``reject``: the first gate's reason, or null.

    A key is taken by the first row that gets to it, even if sanity rejects that row, and held for TTL_S from then;
    rows that it turns away don't prolong it. Rows without a key, and those that an earlier gate rejects, stand alone.
    """
    rows = with_keys(rows, as_of_ts, timeframe).withColumn("_us", F.unix_micros(as_of_ts))
    taken = _taken(rows.filter("_key is not null").select("_key", "_us", "_hold")).withColumn("_there", F.lit(True))
    # rows without a key are dealt by what they are, not to one task
    alone = F.when(F.col("_key").isNull(), F.xxhash64("symbol", "strategy_id", "sig_intent_id"))
    nth = F.row_number().over(Window.partitionBy("_key", "_us", alone).orderBy("sig_intent_id"))
    rows = rows.withColumn("_nth", nth).join(taken, ["_key", "_us"], "left")
    repeated = F.when(F.col("_key").isNotNull() & ~(F.coalesce("_there", F.lit(False)) & (F.col("_nth") == 1)), REPEATED)
    return rows.withColumn("reject", F.coalesce("_early", repeated, sanity_gate())).drop("_early", "_key", "_us", "_hold", "_there", "_nth")


def by_signal() -> Column:
    """The action of a signal-driven strategy."""
    d, side = F.col("sig_direction"), F.col("state_side")
    held = F.when((side == "LONG") & d.isin("SELL", "FLAT"), "CLOSE").when((side == "SHORT") & d.isin("BUY", "FLAT"), "CLOSE").when(side.isin("LONG", "SHORT") & (d == "REVERSE"), "REVERSE").otherwise("HOLD")
    action = F.when(is_flat(), F.when(d.isin("BUY", "SELL", "REVERSE"), "OPEN").otherwise("HOLD")).otherwise(held)
    return F.when(F.col("sig_valid") & F.col("param_capital").isNotNull(), action).otherwise("HOLD")


def by_indicator(entry: Outcome, leave: Outcome) -> Column:
    """The action of an indicator-driven strategy: entry when flat, exit when held; blocked trees hold."""
    return F.when(is_flat(), F.when(entry.state == PASSED, "OPEN").otherwise("HOLD")).otherwise(F.when(leave.state == PASSED, "CLOSE").otherwise("HOLD"))


def hybrid(entry: Outcome, leave: Outcome) -> Column:
    """The signal's action, else the indicator's."""
    first = by_signal()
    return F.when(first != "HOLD", first).otherwise(by_indicator(entry, leave))


def decide(entry: Outcome, leave: Outcome) -> Column:
    """The action by strategy type; unknown types hold."""
    kind = F.col("strategy_type")
    return F.when(kind == "SIGNAL_DRIVEN", by_signal()).when(kind == "INDICATOR_DRIVEN", by_indicator(entry, leave)).when(kind == "HYBRID", hybrid(entry, leave)).otherwise("HOLD")


def order_quantity(action: Column) -> Column:
    """Capital times ratio for what isn't HOLD, in exact decimals."""
    qty = F.col("param_capital").cast("decimal(20,8)") * F.col("param_ratio").cast("decimal(10,4)")
    return F.when(action == "HOLD", F.lit(0.0)).otherwise(F.coalesce(qty.cast("double"), F.lit(0.0)))


def reason_document(action: Column, timeframe: str = "1h") -> Column:
    """Why a decision was made, as JSON: trigger, state before, what was known, parameters, basis and change of state.

    The trigger's source is the signal's id where a signal decided, else the indicator's code, and HOLD where nothing
    is done. Times are epoch milliseconds. What wasn't known (no signal, no value, no price over 0) is left out.
    """
    ms = lambda c: F.unix_millis(c)
    part = lambda there, **fields: F.when(there, F.struct(*(c.alias(k) for k, c in fields.items())))
    col = F.col
    by_a_signal = (col("strategy_type") == "SIGNAL_DRIVEN") | ((col("strategy_type") == "HYBRID") & (by_signal() != "HOLD"))
    source = F.when(action == "HOLD", "HOLD").when(by_a_signal, col("sig_intent_id").cast("string")).otherwise(col("ind_code"))
    known = F.lit(True)
    return F.to_json(
        F.struct(
            part(known, type=F.coalesce("trigger_type", F.lit("UNKNOWN")), source=source, timestamp=ms("bar_time")).alias("trigger"),
            part(col("state_side").isNotNull(), phase=col("state_phase"), positionSide=col("state_side"), positionQty=col("state_qty"), avgEntryPrice=col("state_entry")).alias("logicStateBefore"),
            part(
                known,
                signal=part(col("sig_intent_id").isNotNull(), intentId=col("sig_intent_id"), direction=col("sig_direction"), activatedAt=ms("sig_received_at")),
                indicator=part(has_indicator(), code=col("ind_code"), value=col("ind_value"), barTime=ms("bar_time")),
                bar=part(col("bar_close").isNotNull(), timeframe=F.lit(timeframe), closeTime=ms("bar_time"), close=col("bar_close")),
                price=part(col("px_last") > 0, current=col("px_last"), timestamp=ms("bar_time")),
            ).alias("snapshots"),
            part(col("param_capital").isNotNull(), initialCapital=col("param_capital"), baseOrderRatio=col("param_ratio"), takeProfitRatio=col("param_take_profit"), stopLossRatio=col("param_stop_loss")).alias("paramsDigest"),
            part(known, strategyType=col("strategy_type"), action=action).alias("decisionBasis"),
            F.concat_ws(" -> ", F.coalesce("state_side", F.lit("FLAT")), action).alias("stateChange"),
        )
    )
