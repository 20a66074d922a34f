"""Exact quantiles by a sketch and a second look: no task holds a group's values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's ranks are off by at most a group's rows over this.
ACCURACY = 10_000
#: Groups up to this many are broadcast with their brackets.
GROUPS = 100_000


def exact(rows: DataFrame, keys: list[str], value: str, wanted: Mapping[str, str], accuracy: int = ACCURACY, groups: int = GROUPS) -> DataFrame:
    """(keys, one column for each of ``wanted``): the least value that at least a share of a group's values doesn't exceed.

    ``wanted`` has shares as decimal text by column. Mergeable sketches bracket each quantile between two values, on either
    side of it by more than their error; values below a bracket are counted, those inside are counted by value and
    ranked: 4 in ``accuracy`` of a group's rows, and as many as have its ends. Null values don't count.
    """
    there = rows.filter(F.col(value).isNotNull())
    off = 2 / accuracy
    ends = [min(max(float(p) + d, 0.0), 1.0) for p in wanted.values() for d in (-off, off)]
    found = there.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, ends, accuracy).alias("_ends"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    rank = lambda p: F.greatest(F.ceil(F.col("_n").cast("decimal(20,0)") * F.lit(p).cast("decimal(10,6)")), F.lit(1)).cast("long")
    begin = lambda i: F.when(F.lit(ends[2 * i] == 0.0), F.col("_min")).otherwise(F.get("_ends", F.lit(2 * i)))
    end = lambda i: F.when(F.lit(ends[2 * i + 1] == 1.0), F.col("_max")).otherwise(F.get("_ends", F.lit(2 * i + 1)))
    brackets = found.select(*keys, F.array(*(F.struct(F.lit(name).alias("name"), begin(i).alias("lo"), end(i).alias("hi"), rank(p).alias("rank")) for i, (name, p) in enumerate(wanted.items()))).alias("_b")).persist()
    small = brackets.limit(groups + 1).count() <= groups
    met = there.select(*keys, F.col(value).alias("_v")).join(F.broadcast(brackets) if small else brackets, keys)
    each = met.select(*keys, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["hi"])).alias("b"))
    # below a bracket all values are one
    inside = F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v")
    counts = each.groupBy(*keys, F.col("b.name").alias("_name"), F.col("b.rank").alias("_rank"), inside).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(F.asc_nulls_first("_v")))
    least = counts.withColumn("_upto", upto).filter("_upto >= _rank").groupBy(*keys, "_name").agg(F.min("_v").alias("_q"))
    return least.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in wanted))
