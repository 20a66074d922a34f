"""Exact quantiles against sorting."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from candlewick.operators import quantiles

WANTED = {"low": "0.0", "p50": "0.5", "p95": "0.95", "p99": "0.99", "top": "1.0"}


@pytest.mark.parametrize(("accuracy", "groups"), [(10_000, 100), (50, 100), (50, 1)])
def test_quantiles_are_exact(spark, accuracy, groups):
    pick = random.Random(6)
    rows = [("even", float(i)) for i in range(5000)] + [("ties", float(pick.choice((1, 1, 1, 2, 9)))) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    rows += [("skew", pick.paretovariate(1.1)) for _ in range(4000)] + [("ties", None)] * 50 + [(None, 3.0), (None, 4.0)]
    pick.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in quantiles.exact(frame.filter("g is not null"), ["g"], "v", WANTED, accuracy, groups).collect()}
    assert set(found) == {"even", "ties", "one", "skew"}
    for g, r in found.items():
        values = sorted(v for x, v in rows if x == g and v is not None)
        for name, p in WANTED.items():
            assert r[name] == values[max(math.ceil(Fraction(p) * len(values)), 1) - 1], (g, name)


def test_no_exact_percentile_in_the_plan(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = quantiles.exact(frame, ["g"], "v", {"p50": "0.5"})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_disc" not in plan.lower() and "collect_list" not in plan
