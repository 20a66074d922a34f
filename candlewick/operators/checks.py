"""Gaps, duplicates, order and validity of stored bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.timegrid import grid
from candlewick.operators import halo
from candlewick.sources.written import durable

#: Entries of a list in a report.
LISTED = 100
#: Places of arrival that a task gets of one symbol.
ARRIVALS = 1_000_000


def valid(o: str = "open", h: str = "high", low: str = "low", c: str = "close") -> Column:
    """High is not below, low not above, open and close."""
    return (F.col(h) >= F.col(o)) & (F.col(h) >= F.col(c)) & (F.col(low) <= F.col(o)) & (F.col(low) <= F.col(c))


def flat() -> Column:
    """All four prices are one."""
    return (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))


def gaps(stored: DataFrame, begin: str, end: str) -> DataFrame:
    """(symbol, ts): minutes of [begin, end) that a symbol of ``stored`` has no bar for."""
    lo, hi = F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp")
    expected = stored.select("symbol").distinct().select("symbol", F.explode(grid(lo, hi, 60_000)).alias("ts"))
    return expected.join(stored.filter((F.col("ts") >= lo) & (F.col("ts") < hi)), ["symbol", "ts"], "left_anti")


def missing(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Bars of ``source`` that ``stored`` lacks."""
    return source.join(stored, ["symbol", "ts"], "left_anti")


def missing_report(source: DataFrame, stored: DataFrame, begin: str, end: str) -> DataFrame:
    """(symbol, missing_count, filled_count, minutes): gaps, how many ``source`` can fill, and a list unless too long.

    Minutes are ranked first, and only symbols that lack few enough are listed.
    """
    lacking = gaps(stored, begin, end)
    can = source.select("symbol", "ts", F.lit(1).alias("there"))
    met = lacking.join(can, ["symbol", "ts"], "left")
    sums = met.groupBy("symbol").agg(F.count("*").alias("missing_count"), F.count("there").alias("filled_count"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    first = lacking.withColumn("rank", rank).filter(F.col("rank") <= LISTED)
    listed = first.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list(F.date_format("ts", "yyyy-MM-dd HH:mm"))), ",").alias("all"))
    return sums.join(listed, "symbol").select("symbol", "missing_count", "filled_count", F.when(F.col("missing_count") <= LISTED, F.col("all")).alias("minutes"))


def duplicates(rows: DataFrame) -> DataFrame:
    """(symbol, ts, n) for instants with more than one row."""
    return rows.groupBy("symbol", "ts").agg(F.count("*").alias("n")).filter("n > 1")


def with_previous(rows: DataFrame, arrival: str, places: int = ARRIVALS) -> DataFrame:
    """``rows`` with ``previous``: the time of the symbol's row that arrived before. A symbol is cut by ``places`` of arrival."""
    chunk = F.floor(F.col(arrival) / places)
    spread = halo.with_rows_before(rows, ("symbol",), chunk, arrival, 1)
    order = Window.partitionBy("symbol", halo.PART).orderBy(arrival)
    return spread.withColumn("previous", F.lag("ts").over(order)).filter(F.col(halo.PART) == chunk).drop(halo.PART)


def out_of_order(rows: DataFrame, arrival: str, places: int = ARRIVALS) -> DataFrame:
    """Rows earlier than the one that arrived before them."""
    return with_previous(rows, arrival, places).filter(F.col("ts") < F.col("previous"))


def data_errors() -> Column:
    """Names of what is wrong with a bar, joined by commas; empty if nothing is."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    named = (
        ("NEGATIVE_PRICE", (o < 0) | (h < 0) | (low < 0) | (c < 0)), ("NEGATIVE_VOLUME", F.col("volume") < 0), ("PRICE_TOO_HIGH", F.greatest(o, h, low, c) > 1_000_000),
        ("HIGH_LESS_THAN_LOW", h < low), ("HIGH_INVALID", (h < o) | (h < c)), ("LOW_INVALID", (low > o) | (low > c)),
    )
    return F.concat_ws(",", *(F.when(wrong, name) for name, wrong in named))


def verify_report(rows: DataFrame, arrival: str, places: int = ARRIVALS) -> DataFrame:
    """(symbol, total, duplicates, out_of_order, data_errors, error_count, details) of bars in order of arrival.

    Details are the first LISTED rows with errors in order of time: rows without any never go to a task that lists them.
    """
    marked = with_previous(rows, arrival, places).withColumn("late", F.col("ts") < F.col("previous")).withColumn("errors", data_errors())
    sums = marked.groupBy("symbol").agg(F.count("*").alias("total"), F.count_if("late").alias("out_of_order"), F.count_if(F.col("errors") != "").alias("data_errors"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("ts", arrival))
    # the limit on the rank is applied before the shuffle too, so that a task sends LISTED rows of a symbol at most
    first = rows.withColumn("errors", data_errors()).filter("errors <> ''").withColumn("rank", rank).filter(F.col("rank") <= LISTED)
    text = F.struct("rank", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" "), "errors").alias("text"))
    details = first.groupBy("symbol").agg(F.array_sort(F.collect_list(text)).alias("d"))
    twice = duplicates(rows).groupBy("symbol").agg(F.count("*").alias("dup"))
    met = sums.join(twice, "symbol", "left").join(details, "symbol", "left")
    listed = F.coalesce(F.array_join(F.transform("d", lambda x: x["text"]), ";"), F.lit(""))
    return met.select("symbol", "total", F.coalesce("dup", F.lit(0)).cast("long").alias("duplicates"), "out_of_order", "data_errors", (F.col("data_errors") + F.col("out_of_order")).alias("error_count"), listed.alias("details"))


def continuity(bars: DataFrame, span_minutes: int = 60, span_ms: int = 86_400_000, arrival: str | None = None, places: int = ARRIVALS) -> DataFrame:
    """Each bar with how many bars the minutes before it have; fewer than all is a gap. Chunks of ``span_ms`` have the minutes before them.

    In order of ``arrival``, a bar that isn't after all that came before it (late, or again) isn't looked at.
    """
    spread = halo.with_time_before(bars, span_ms, span_minutes * 60_000)
    order = Window.partitionBy("symbol", halo.PART).orderBy(F.unix_seconds("ts")).rangeBetween(-60 * span_minutes, -1)
    rows = spread.withColumn("seen", F.count("*").over(order)).filter(F.col(halo.PART) == halo.time_chunk("ts", span_ms))
    if arrival is not None:
        rows = halo.greatest_before(rows, ("symbol",), F.floor(F.col(arrival) / places), arrival, "ts", "_latest").filter("_latest is null or ts > _latest")
    return rows.select("symbol", "ts", "seen", (F.col("seen") < span_minutes).alias("has_gap"))


def cooldown(triggers: DataFrame, hold: Column | int = 300, rounds: int = 40) -> DataFrame:
    """(key, ts) of the triggers that a cooldown lets pass: each at least ``hold`` after the last of its key that passed.

    ``hold`` is in seconds, or a column of microseconds that is the same for all rows of a key. Whether a trigger passes
    hangs on all before it, but the first after a pause of ``hold`` passes whatever was before. From each trigger a
    pointer leads to the first that is ``hold`` later; those reached from the first ones are found by doubling pointers,
    so that a chain of n needs log n rounds, each written. No task has all of a key, and no array holds its times. Where
    all chains are short (most keys of a trigger are), that is one round or none.
    """
    us = F.lit(hold * 1_000_000).cast("long") if isinstance(hold, int) else hold.cast("long")
    rows = triggers.select("key", F.unix_micros("ts").alias("us"), us.alias("hold")).distinct().filter("us is not null")
    rows = durable(rows, "cooldown-triggers")
    # at most one trigger of a span as long as the hold can pass; probes ask for the first one at or after their time
    probes = rows.select("key", (F.col("us") + F.col("hold")).alias("at"), "hold", F.col("us").alias("origin"))
    both = rows.select("key", F.col("us").alias("at"), "hold", F.lit(None).cast("long").alias("origin")).unionByName(probes).withColumn("span", F.floor(F.col("at") / F.col("hold")))
    ahead = Window.partitionBy("key", "span").orderBy("at", F.col("origin").isNull().cast("int")).rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("origin").isNull(), F.col("at"))
    inside = both.withColumn("next", F.min(own).over(ahead)).withColumn("first", F.min(own).over(Window.partitionBy("key", "span")))
    spans = both.groupBy("key", "span").agg(F.min(own).alias("first"))
    after = F.first("first", ignorenulls=True).over(Window.partitionBy("key").orderBy("span").rowsBetween(1, Window.unboundedFollowing))
    later = spans.select("key", "span", after.alias("later"))
    leads = inside.filter("origin is not null").join(later, ["key", "span"], "left").select("key", F.col("origin").alias("us"), F.coalesce("next", "later").alias("next"))
    # a trigger with none before it within the hold begins a chain; what it leads to over a pause begins one of its own
    back = rows.withColumn("span", F.floor(F.col("us") / F.col("hold")))
    before = F.lag("us").over(Window.partitionBy("key", "span").orderBy("us"))
    ends = back.groupBy("key", "span").agg(F.max("us").alias("end")).withColumn("end", F.lag("end").over(Window.partitionBy("key").orderBy("span")))
    heads = back.withColumn("before", before).join(ends, ["key", "span"]).filter("coalesce(before, end) is null or us - coalesce(before, end) >= hold").select("key", "us")
    jump = durable(leads.filter("next is not null").join(heads.select("key", F.col("us").alias("next")), ["key", "next"], "left_anti").select("key", "us", "next"), "cooldown-leads")
    reached = durable(heads, "cooldown-reached")
    # each round: what the pointers reach from all that is reached, then pointers over twice as many
    for _ in range(rounds):
        if jump.isEmpty():
            return reached.select("key", F.timestamp_micros("us").alias("ts"))
        more = jump.join(reached, ["key", "us"], "left_semi").select("key", F.col("next").alias("us"))
        reached = durable(reached.unionByName(more).distinct(), "cooldown-reached")
        jump = durable(jump.join(jump.select("key", F.col("us").alias("next"), F.col("next").alias("end")), ["key", "next"]).select("key", "us", F.col("end").alias("next")), "cooldown-leads")
    raise RuntimeError(f"chains of over 2 ** {rounds} triggers")
