"""Rule trees by truth table, guards and decisions by cases."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from candlewick.operators import conditions, decisions

ROW = "bar_open double, bar_high double, bar_low double, bar_close double, bar_volume double, ind_code string, ind_value double, ind_extra map<string,double>, px_last double, sig_valid boolean, sig_direction string, sig_intent_id long, state_side string, state_qty double, state_entry double, param_stop_loss double, param_capital double, param_ratio double, strategy_type string, trigger_type string, sig_status string"
BASE = {"bar_open": 10.0, "bar_high": 12.0, "bar_low": 9.0, "bar_close": 11.0, "bar_volume": 5.0, "ind_code": "RSI", "ind_value": 70.0, "ind_extra": {"k": 1.5}, "px_last": 11.0, "sig_valid": True, "sig_direction": "BUY", "sig_intent_id": 7, "state_side": "LONG", "state_qty": 2.0, "state_entry": 100.0, "param_stop_loss": 0.1, "param_capital": 1000.0, "param_ratio": 0.5, "strategy_type": "HYBRID", "trigger_type": "BAR", "sig_status": "ACTIVE"}

PASS = {"factor": "BAR.CLOSE", "operator": "GT", "value": 1}
FAIL = {"factor": "BAR.CLOSE", "operator": "LT", "value": 1}
BLOCK = {"factor": "RSI_14", "operator": "GT", "value": 1}


def frame(spark, *changes):
    rows = [{**BASE, **c} for c in changes or ({},)]
    names = [f.split()[0] for f in ROW.replace("map<string,double>", "m").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ROW)


def state(spark, spec, **row):
    text = spec if spec is None or isinstance(spec, str) else json.dumps(spec)
    return frame(spark, row).select(conditions.compiled(text, conditions.factors()).state).first()[0]


def expected(mode, parts):
    """The rule in plain words: in order; blocked ends all; ANY ends at the first that passes."""
    results = []
    for p in parts:
        if p == "BLOCKED":
            return p
        if mode == "ANY" and p == "PASSED":
            return p
        results.append(p == "PASSED")
    return "PASSED" if (any(results) if mode == "ANY" else all(results)) else "FAILED"


def test_truth_table(spark):
    kinds = {"PASSED": PASS, "FAILED": FAIL, "BLOCKED": BLOCK}
    cases = [(m, p, g) for m in ("ANY", "ALL", "any") for n in range(4) for p in itertools.product(kinds, repeat=n) for g in (0, 1)]
    known = conditions.factors()
    columns, want = [], []
    for mode, parts, grouped in cases:
        rules, groups = (parts[:1], parts[1:]) if grouped else (parts, ())
        spec = {"mode": mode, "rules": [kinds[p] for p in rules], "groups": [{"rules": [kinds[p]]} for p in groups]}
        columns.append(conditions.tree(spec, known).state)
        want.append(expected(mode, parts))
    got = [x for at in range(0, len(columns), 60) for x in frame(spark).select(*(c.alias(f"c{i}") for i, c in enumerate(columns[at : at + 60]))).first()]
    assert got == want


@pytest.mark.parametrize(
    ("rule", "row", "want"),
    [
        ({"factor": "IND.RSI", "operator": "GTE", "value": 70}, {}, "PASSED"), ({"factor": "IND.k", "operator": "EQ", "value": "1.50"}, {}, "PASSED"), ({"factor": "IND.RSI", "operator": "GT", "value": 1}, {"ind_value": None}, "BLOCKED"),
        ({"factor": "IND.x", "operator": "GT", "value": 1, "nullable": True}, {}, "FAILED"), ({"factor": "BAR.CLOSE", "operator": "GT", "value": "BAR.OPEN"}, {}, "PASSED"), ({"factor": "BAR.CLOSE", "operator": "GT", "value": "IND.none"}, {}, "BLOCKED"),
        ({"factor": "SIG.DIRECTION", "operator": "EQ", "value": "BUY", "type": "STRING"}, {}, "PASSED"), ({"factor": "SIG.DIRECTION", "operator": "EQ", "value": "buy", "type": "STRING"}, {}, "FAILED"), ({"factor": "SIG.DIRECTION", "operator": "GT", "value": "A", "type": "STRING"}, {}, "BLOCKED"),
        ({"factor": "SIG.DIRECTION", "operator": "EQ", "value": 3}, {}, "BLOCKED"), ({"factor": "STATE.POSITION_QTY", "operator": "EQ", "value": "2.0", "type": "STRING"}, {}, "PASSED"), ({"factor": "BAR.CLOSE", "operator": "BETWEEN", "value": 3}, {}, "BLOCKED"),
        ({"factor": "BAR.CLOSE", "operator": "CONTAINS", "value": 1}, {}, "BLOCKED"), ({"factor": "BAR.CLOSE", "operator": "EQ", "value": True, "type": "BOOLEAN"}, {}, "BLOCKED"), ({"factor": "BAR.LOW", "operator": "LT", "value": "STATE.STOP_LOSS_PRICE"}, {}, "PASSED"),
        ({"factor": "PX.LAST", "operator": "GT", "value": 0}, {"px_last": 0.0}, "BLOCKED"), ({"factor": "SIG.INTENT_ID", "operator": "EQ", "value": 7}, {"sig_valid": False}, "BLOCKED"), ({"factor": "BAR.CLOSE", "operator": "EQ", "value": None}, {}, "BLOCKED"), ({"factor": "BAR.CLOSE", "operator": "GT", "value": "abc"}, {}, "BLOCKED"),
    ],
)
def test_rules(spark, rule, row, want):
    assert state(spark, {"rules": [rule]}, **row) == want


def test_no_condition_is_blocked(spark):
    assert [state(spark, x) for x in (None, "", "{}", "not json")] == ["BLOCKED"] * 4


def test_signal_matrix(spark):
    want = {("FLAT", "BUY"): "OPEN", ("FLAT", "SELL"): "OPEN", ("FLAT", "REVERSE"): "OPEN", ("LONG", "SELL"): "CLOSE", ("LONG", "FLAT"): "CLOSE", ("SHORT", "BUY"): "CLOSE", ("SHORT", "FLAT"): "CLOSE", ("LONG", "REVERSE"): "REVERSE", ("SHORT", "REVERSE"): "REVERSE"}
    cases = list(itertools.product(("FLAT", "LONG", "SHORT"), ("BUY", "SELL", "FLAT", "REVERSE")))
    got = frame(spark, *({"state_side": s, "sig_direction": d} for s, d in cases)).select("state_side", "sig_direction", decisions.by_signal()).collect()
    assert {(a, b): c for a, b, c in got} == {c: want.get(c, "HOLD") for c in cases}
    assert frame(spark, {"sig_valid": False, "state_side": "FLAT"}).select(decisions.by_signal()).first()[0] == "HOLD"
    assert frame(spark, {"state_qty": 0.0}).select(decisions.by_signal()).first()[0] == "OPEN"


def test_hybrid_takes_the_signal_first(spark):
    entry, leave = (conditions.tree({"rules": [r]}, conditions.factors()) for r in (PASS, PASS))
    rows = frame(spark, {"sig_direction": "REVERSE"}, {"sig_direction": "BUY"}, {"sig_valid": False}, {"strategy_type": "NONE"})
    assert [r[0] for r in rows.select(decisions.decide(entry, leave)).collect()] == ["REVERSE", "CLOSE", "CLOSE", "HOLD"]
    assert rows.select(decisions.order_quantity(F.lit("OPEN"))).first()[0] == 500.0 and rows.select(decisions.order_quantity(F.lit("HOLD"))).first()[0] == 0.0


def test_guards(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    cases = [({"state_side": None}, 0, "PhaseGate: no state"), ({"trigger_type": "SIGNAL"}, 30, None), ({"trigger_type": "SIGNAL", "sig_intent_id": 8}, 31, "StalenessGate: old signal"), ({"trigger_type": "SIGNAL", "sig_valid": False, "sig_intent_id": 9}, 0, "StalenessGate: invalid signal"), ({"ind_value": None, "ind_extra": None}, 0, "StalenessGate: no indicator"), ({"param_ratio": 1.0}, 0, None), ({"param_ratio": 1.0001}, 0, "SanityGate: ratio over 1"), ({"param_ratio": 0.0}, 0, "SanityGate: ratio"), ({"param_capital": None}, 0, "SanityGate: capital"), ({"px_last": -1.0}, 0, "SanityGate: price"), ({"px_last": None}, 0, None)]
    rows = frame(spark, *(c for c, _, _ in cases)).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    age = F.element_at(F.array(*(F.lit(a) for _, a, _ in cases)), (F.col("i") + 1).cast("int"))
    rows = rows.withColumn("bar_time", F.timestamp_seconds(F.lit(10_000))).withColumn("sig_received_at", F.timestamp_seconds(F.lit(10_000) - age)).withColumn("strategy_id", F.col("i")).withColumn("symbol", F.lit("s"))
    got = {r.i: r.reject for r in decisions.guarded(rows, "bar_time").collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]
    twice = rows.filter("i = 7").unionByName(rows.filter("i = 7").withColumn("bar_time", F.col("bar_time")).withColumn("sig_intent_id", F.lit(8).cast("long")))
    # the key is taken even by a row that sanity rejects
    assert sorted(r.reject for r in decisions.guarded(twice, "bar_time").collect()) == ["DedupGate: repeated", "SanityGate: ratio"]


@pytest.mark.parametrize("text", ["nan", "NaN", "inf", "-Infinity", "1_0", " 3", "3 ", "", "0x1", "1e", "٣", float("nan"), float("inf")])
def test_what_is_no_decimal_is_blocked(spark, text):
    assert state(spark, {"rules": [{"factor": "BAR.CLOSE", "operator": "NEQ", "value": text}]}) == "BLOCKED"


def test_decimal_literals(spark):
    assert [state(spark, {"rules": [{"factor": "BAR.CLOSE", "operator": "GT", "value": v}]}) for v in ("1.50", "+1", "-.5", "1e1", "3.", 1)] == ["PASSED"] * 6
    assert state(spark, {"rules": [{"factor": "SIG.DIRECTION", "operator": "NEQ", "value": 1}]}, sig_direction="NaN") == "BLOCKED"


def test_keys_of_triggers_expire(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for kind, ttl in (("SIGNAL", 3600), ("INDICATOR", 3600), ("BAR", 86_400)):
        times = [0, 10, ttl - 1, ttl, ttl + 5, 2 * ttl - 1, 2 * ttl, 9 * ttl]
        want, last = [], None
        for t in times:  # in plain words: held from when it was taken, not from when it was last asked for
            taken = last is None or t - last >= ttl
            last = t if taken else last
            want.append(None if taken else "DedupGate: repeated")
        rows = frame(spark, *({"trigger_type": kind} for _ in times)).coalesce(1).withColumn("i", F.monotonically_increasing_id())
        at = F.element_at(F.array(*map(F.lit, times)), (F.col("i") + 1).cast("int")) + 10**6
        rows = rows.withColumn("now", F.timestamp_seconds(at)).withColumn("bar_time", F.timestamp_seconds(F.lit(5))).withColumn("sig_received_at", F.col("now"))
        rows = rows.withColumn("strategy_id", F.lit(1).cast("long")).withColumn("symbol", F.lit("x"))
        assert [r.reject for r in decisions.guarded(rows, "now").orderBy("i").collect()] == want


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1), ("a", 5, 2), ("a", 5, 3), ("c", 1, 4)], "k string, t int, v int").select("k", F.col("t").alias("at"), F.struct("v").alias("x"))
    got = {(r.k, r.t): r.x and r.x.v for r in decisions.as_of(left, right, ["k"], "t", "at", "x").collect()}
    assert got == {("a", 5): 3, ("a", 1): None, ("b", 9): None}
