"""Optional predicates, lookups, series of requests, arrival order, message routes, hit reasons."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.operators import checks, conditions, dims, halo, scan
from candlewick.sources import exchange


def test_predicates_are_applied_where_given(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "b", 0), (4, None, 1)], "id int, name string, enabled int")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(dims.matching(rows)) == ids(dims.matching(rows, {"name": " ", "enabled": None}, {"id": None}, {})) == [1, 2, 3, 4]
    assert ids(dims.matching(rows, {"name": "b"}, {"id": "2"}, {"id": 2})) == [2]
    assert ids(dims.lookup(rows, enabled=True, name="b")) == [2] and [r.id for r in dims.lookup(rows, order=("id",), name="b").collect()] == [2, 3]
    with pytest.raises(ValueError):
        dims.lookup(rows, name="")


def test_missing_pairs_are_reported(spark):
    requests = spark.createDataFrame([(1,), (2,), (3,), (1,)], "pair_id int")
    pairs, listed = spark.createDataFrame([(1, "A"), (2, "B")], "pair_id int, symbol string"), spark.createDataFrame([(1, "A-X")], "pair_id int, listing string")
    found = sorted((r.pair_id, r.symbol, r.listing, r.error) for r in dims.pair_info(requests, pairs, listed).collect())
    assert found == [(1, "A", "A-X", None)] * 2 + [(2, "B", None, "pair 2 isn't listed"), (3, None, None, "no pair 3")]


def test_series_follow_the_whitelist_the_names_and_both_limits(spark):
    bars = [(s, tf, datetime(2024, 1, 1) + timedelta(hours=i), 1.0, 1.0, 1.0, float(i), 1.0) for s in ("x-swap", "x", "y") for tf in ("1h", "2h") for i in range(400)]
    frame = spark.createDataFrame(bars, "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double")
    requests = spark.createDataFrame([(1, "1h", 3), (1, "2h", 3), (2, "1h", 9999), (3, "1h", 5), (4, "1h", 5), (1, "1m", 5), (5, "1h", 0)], "pair_id int, tf string, n int")
    listed = spark.createDataFrame([(1, "x-swap"), (2, ""), (4, None), (5, "y")], "pair_id int, symbol string")
    standard = spark.createDataFrame([(1, "x"), (2, "y"), (4, "")], "pair_id int, symbol string")
    found = {}
    for r in scan.series_for(requests, frame, listed, standard).collect():
        assert r.bar_time == r.ts + timedelta(hours=1)
        found.setdefault((r.pair_id, r.tf, r.symbol), []).append(int(r.close))
    assert {k: sorted(v) for k, v in found.items()} == {(1, "1h", "x-swap"): [397, 398, 399], (2, "1h", "y"): list(range(35, 400))}


def test_what_came_before_in_many_chunks(spark):
    pick = random.Random(1)
    rows = [(k, i, pick.choice([None, pick.randrange(100)])) for k in "ab" for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, i int, v int")
    for size in (7, 1000):
        found = {(r.k, r.i): r.m for r in halo.greatest_before(frame, ("k",), F.floor(F.col("i") / size), "i", "v", "m").collect()}
        assert found == {(k, i): max((v for kk, j, v in rows if kk == k and j < i and v is not None), default=None) for k, i, _ in rows}


def test_late_and_repeated_bars_are_not_looked_at(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    frame = spark.createDataFrame([("s", at(m), i) for i, m in enumerate((0, 1, 3, 2, 3, 4, 1, 9))], "symbol string, ts timestamp, seq int")
    found = {r.ts: r.seen for r in checks.continuity(frame, 5, arrival="seq", places=3).collect()}
    assert {(t - at(0)).seconds // 60: n for t, n in found.items()} == {0: 0, 1: 1, 3: 4, 4: 6, 9: 1}


def test_messages_are_routed(spark):
    texts = ['{"event":"login","arg":{"channel":"tickers"}}', '{"arg":{"channel":"candle1m"}}', '{"arg":{"channel":"tickers"}}', '{"arg":{"channel":"books"}}', "no json", None]
    found = spark.createDataFrame([(t,) for t in texts], "m string").select(exchange.channel("m").alias("c")).collect()
    assert [r.c for r in found] == ["system", "candle", "ticker", "unknown", "unknown", "unknown"]


def test_hits_end_where_evaluation_ends(spark):
    columns = "bar_open double, bar_high double, bar_low double, bar_close double, bar_volume double, px_last double, sig_valid boolean, sig_direction string, sig_intent_id long, state_side string, state_qty double, state_entry double, param_stop_loss double, ind_code string, ind_value double, ind_extra map<string,double>"
    row = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 9.0, 0.0, False, None, None, "LONG", 1.0, 1.0, 0.1, "SMA", 1.0, None)], columns)
    good, bad, gone = ({"factor": "BAR.CLOSE", "operator": "GT", "value": 1}, {"factor": "BAR.CLOSE", "operator": "GT", "value": 2}, {"factor": "PX.LAST", "operator": "GT", "value": 1})

    def run(spec):
        out = conditions.compiled(json.dumps(spec), conditions.factors())
        r = row.select(out.state.alias("s"), out.reason.alias("r"), out.hits.alias("h")).first()
        hits = r.h and ([x.reason for x in r.h.rules], [(g.mode, g.hit, [x.reason for x in g.rules]) for g in r.h.groups])
        return r.s, r.r, hits

    assert run({"mode": "ANY", "rules": [bad, good, gone], "groups": [{"rules": [good]}]}) == ("PASSED", None, (["miss", "hit"], []))
    assert run({"rules": [bad, good], "groups": [{"mode": "ANY", "rules": [good, bad]}]}) == ("FAILED", None, (["miss", "hit"], [("ANY", True, ["hit"])]))
    assert run({"rules": [bad], "groups": [{"rules": [gone]}]}) == ("BLOCKED", "factor has no value: PX.LAST", None)
    assert run({"mode": "ANY", "groups": [{"rules": [bad, {**gone, "nullable": True}]}, {"groups": [{"rules": [good]}]}, {"rules": [gone]}]}) == ("PASSED", None, ([], [("ALL", False, ["miss", "miss"]), ("ALL", True, [])]))
    assert run({"rules": [{"factor": "X.Y"}]})[:2] == ("BLOCKED", "factor not allowed: X.Y") and run({})[:2] == ("BLOCKED", "no condition")
    assert run({"rules": [{"factor": "BAR.CLOSE", "operator": "LIKE", "value": 1}]})[1] == "can't be compared: BAR.CLOSE LIKE"
    assert run({"rules": [{"factor": "BAR.CLOSE", "operator": "GT", "value": "x1"}]})[1] == "no such value: x1"


def test_one_key_is_fanned_out_by_many_tasks(spark):
    events = spark.createDataFrame([("hot", i) for i in range(20)] + [("cold", 1), (None, 2), ("none", 3), ("hot", 0)], "symbol string, n int")
    subs = spark.createDataFrame([("hot", i, int(i % 3 > 0), {"a": i}) for i in range(300)] + [("cold", 1, 1, {}), (None, 2, 1, {}), ("cold", 1, 1, {})], "symbol string, user_id int, enabled int, more map<string,int>")
    found = dims.fanned_out(events, subs, ["symbol"])
    assert found.columns == ["symbol", "n", "user_id", "more"]
    want = [("hot", n, u) for n in [*range(20), 0] for u in range(300) if u % 3] + [("cold", 1, 1)] * 2
    assert sorted((r.symbol, r.n, r.user_id) for r in found.collect()) == sorted(want)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) > 30 and max(tasks) < len(want) / 8
