"""Windows over a key's rows in order, in many tasks: chunks, each with the rows before it that its frames reach.

A window by symbol alone gives each symbol to one task, however long its history is. Here a symbol's rows are cut
into chunks, and the last rows before a chunk (its halo) are copied to it; the window goes by symbol and chunk, and the
copies are dropped from the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "_part"
#: Time of a chunk: of hourly bars some 2,000, of which the halo of 364 is a sixth.
SPAN_MS = 90 * 86_400_000


def time_chunk(ts: str = "ts", span_ms: int = SPAN_MS) -> Column:
    """The number of the chunk of time that a row is in."""
    return F.floor(F.unix_millis(ts) / span_ms)


def chunk_of(rows: DataFrame, ts: str, span_ms: int = SPAN_MS) -> Column:
    """``time_chunk``, or the same cut of a number in place of a time."""
    return time_chunk(ts, span_ms) if rows.schema[ts].dataType.typeName() == "timestamp" else F.floor(F.col(ts) / span_ms)


def with_rows_before(rows: DataFrame, keys: tuple[str, ...], chunk: Column, order: str, before: int) -> DataFrame:
    """``rows`` with PART: each row in its own chunk, and in those after it for which it is among the ``before`` rows before.

    ``chunk`` must not fall with ``order``. Chunks may be smaller than ``before``: then a row is copied to more than one.
    What is computed for a key as a whole is a sum over its chunks, one row each.
    """
    own = rows.withColumn("_chunk", chunk)
    from_end = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(F.desc(order)))
    ranked = own.withColumn("_from_end", from_end)
    along = Window.partitionBy(*keys).orderBy("_chunk")
    sizes = own.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_upto", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # chunks without rows aren't there, so that at most ``before`` chunks can be within reach
    later = F.collect_list(F.struct("_chunk", (F.col("_upto") - F.col("_n")).alias("passed"))).over(along.rowsBetween(1, before))
    near = F.filter(F.transform(later, lambda c: F.struct(c["_chunk"].alias("chunk"), (c["passed"] - F.col("_upto")).alias("between"))), lambda c: c["between"] < before)
    sizes = sizes.select(*keys, "_chunk", near.alias("_near"))
    met = ranked.join(sizes, [*keys, "_chunk"])
    reached = F.transform(F.filter("_near", lambda c: c["between"] + F.col("_from_end") <= before), lambda c: c["chunk"])
    return met.select(*rows.columns, F.explode(F.concat(F.array("_chunk"), reached)).alias(PART))


def with_time_before(rows: DataFrame, span_ms: int, reach_ms: int, ts: str = "ts") -> DataFrame:
    """``rows`` with PART: each row in its own chunk of time, and in those that begin within ``reach_ms`` after it."""
    last = F.floor((F.unix_millis(ts) + reach_ms) / span_ms)
    return rows.withColumn(PART, F.explode(F.sequence(time_chunk(ts, span_ms), last)))


def windowed(rows: DataFrame, compute: Callable[[DataFrame, tuple[str, ...]], DataFrame], keys: tuple[str, ...], before: int, span_ms: int = SPAN_MS, ts: str = "ts") -> DataFrame:
    """``compute(rows, keys)`` for windows that reach at most ``before`` rows back in time, in many tasks for each key.

    ``compute`` gets PART as one more key, must partition by all keys given, and keep ``ts`` and the keys.
    """
    chunk = chunk_of(rows, ts, span_ms)
    found = compute(with_rows_before(rows, keys, chunk, ts, before), (*keys, PART))
    return found.filter(F.col(PART) == chunk).drop(PART)


def greatest_before(rows: DataFrame, keys: tuple[str, ...], chunk: Column, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` of all rows of the key that stand before in ``order``, in many tasks.

    Inside a chunk it is a window's; what the chunks before it hold comes from one row for each chunk.
    """
    cut = rows.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut.groupBy(*keys, "_chunk").agg(F.max(value).alias("_most")).withColumn("_earlier", F.max("_most").over(along)).drop("_most")
    found = cut.withColumn("_inside", F.max(value).over(inside)).join(earlier, [*keys, "_chunk"])
    return found.select(*rows.columns, F.greatest("_inside", "_earlier").alias(name))
