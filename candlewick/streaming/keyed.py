"""Keys that are held for a time on a stream: duplicate triggers, cooldowns. State goes when the watermark passes its end."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlewick.operators import decisions

#: Rows of a key that a task sorts in memory; of more, sorted runs go to a file of the task, to be merged in blocks.
RUN, BLOCK = 50_000, 200
#: Parts that rows without a key are dealt to.
PARTS = 1_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within it, streams are started with the state store that keyed state with timers needs; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_order(rows: Iterator[tuple], order: Callable[[tuple], Any], run: int = RUN, block: int = BLOCK) -> Iterator[tuple]:
    """``rows`` sorted by ``order``; of however many rows one run is in memory, and then a block of each run."""
    part = sorted(islice(rows, run), key=order)
    if len(part) < run:
        yield from part
        return
    with tempfile.TemporaryFile() as file:
        spans = []
        while part:
            begin = file.tell()
            for at in range(0, len(part), block):
                pickle.dump(part[at : at + block], file, pickle.HIGHEST_PROTOCOL)
            spans.append((begin, file.tell()))
            part = None  # or the next run would come beside this one
            part = sorted(islice(rows, run), key=order)

        def stored(at: int, end: int) -> Iterator[tuple]:
            while at < end:
                file.seek(at)
                some = pickle.load(file)
                at = file.tell()
                yield from some

        yield from heapq.merge(*(stored(*span) for span in spans), key=order)


class Hold(StatefulProcessor):
    """For each key the time at which a row took it last; a row takes it when it is free, for its own ``_ttl``.

    Rows of a micro-batch are taken in order of time and ``tie``. Rows that are turned away don't prolong the hold, and
    go if ``passed`` alone are wanted: Spark holds all that a key gives in a micro-batch. Rows without a key hold nothing and pass.
    """

    def __init__(self, tie: str, passed: bool = False):
        self.tie, self.passed = tie, passed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType()), T.StructField("ttl", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = next(rows, None)
        if first is None:
            return
        out, rows = Row(*first.__fields__, "taken"), chain([first], rows)
        if key[0] is None:
            for row in rows:
                yield out(*row, True)
            return
        us, ttl, tie = (first.__fields__.index(c) for c in ("_us", "_ttl", self.tie))
        held = self.last.get() if self.last.exists() else None
        before = held
        for row in in_order(map(tuple, rows), lambda r: (r[us], r[tie] is not None, r[tie])):
            free = held is None or row[us] - held[0] >= row[ttl]
            if free:
                held = (row[us], row[ttl])
            if free or not self.passed:
                yield out(*row, free)
        if held is not before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, Row)) else timer)
            self.last.update(held)
            self.handle.registerTimer((held[0] + held[1]) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def held(stream: DataFrame, key: str, ts: str, ttl_us: Column | int, tie: str, delay: str = "10 minutes", watermarked: bool = False, passed: bool = False) -> DataFrame:
    """``stream`` with ``taken``: whether a row got its key, which the row before it holds for ``ttl_us``. Rows without a key pass.

    Rows that are later than the watermark go, and those that didn't get their key if ``passed`` alone are wanted. Rows
    without a key are dealt to parts, so that no task has all of them. Needs ``keyed_state`` when the stream is started.
    """
    rows = stream if watermarked else stream.withWatermark(ts, delay)
    schema = T.StructType([*rows.schema.fields, T.StructField("taken", T.BooleanType())])
    plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind]
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*plain), F.lit(PARTS))).otherwise(0)
    rows = rows.withColumns({"_us": F.unix_micros(ts), "_ttl": (F.lit(ttl_us) if isinstance(ttl_us, int) else ttl_us).cast("long"), "_part": part})
    return rows.groupBy(key, "_part").transformWithState(Hold(tie, passed), schema, "append", "eventTime")


def cooled_down(triggers: DataFrame, seconds: int = 300, tie: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """The rows of a stream of triggers (key, ts, tie) that a cooldown lets pass: each ``seconds`` or more after the last of its key that passed."""
    return held(triggers, "key", "ts", seconds * 1_000_000, tie, delay, passed=True).drop("taken")


def guarded(rows: DataFrame, as_of_ts: str, timeframe: str = "1h", delay: str = "10 minutes") -> DataFrame:
    """``decisions.guarded`` on a stream of context rows: ``reject`` is the first gate's reason, or null."""
    rows = rows.withWatermark(as_of_ts, delay)
    rows = decisions.with_keys(rows, as_of_ts, timeframe)
    found = held(rows, "_key", as_of_ts, F.col("_hold"), "sig_intent_id", watermarked=True)
    repeated = F.when(~F.col("taken"), decisions.REPEATED)
    return found.withColumn("reject", F.coalesce("_early", repeated, decisions.sanity_gate())).drop("_early", "_key", "_hold", "taken")
