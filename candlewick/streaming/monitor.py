"""Write rates and latencies of running streams, measured by the streams themselves, and the alerts that follow."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Alerts: a latency over so many milliseconds, a share of writes below so many per cent.
LATENCY_MS, WRITE_RATE = 10.0, 99.0
_SCHEMA = "stream string, total long, written long, min_ms double, max_ms double, sum_ms double"


def observed(rows: DataFrame, name: str, written: str = "written", latency_ms: str = "latency_ms") -> DataFrame:
    """``rows``, which report under ``name`` with each batch: how many there are, how many were written, and their latencies."""
    latency = F.col(latency_ms).cast("double")
    return rows.observe(name, F.count(F.lit(1)).alias("total"), F.count_if(written).alias("written"), F.min(latency).alias("min_ms"), F.max(latency).alias("max_ms"), F.sum(latency).alias("sum_ms"))


class Metrics(StreamingQueryListener):
    """Sums of what ``observed`` streams report, one row for each stream: as a listener, or from a query's own progress."""

    def __init__(self, *names: str):
        self.names, self.sums, self.seen = names, {}, {}

    def add(self, progress: Any) -> None:
        """Count a batch's report once, whoever brings it."""
        for name in self.names:
            new = progress.observedMetrics.get(name)
            last = self.seen.get((name, str(progress.runId)), -1)
            if new is None or progress.batchId <= last:
                continue
            self.seen[name, str(progress.runId)] = progress.batchId
            if new.total:
                old = self.sums.get(name)
                row = tuple(new)
                self.sums[name] = row if old is None else (old[0] + row[0], old[1] + row[1], min(old[2], row[2]), max(old[3], row[3]), old[4] + row[4])

    def onQueryProgress(self, event: Any) -> None:
        self.add(event.progress)

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(stream, total, written, min_ms, max_ms, sum_ms)."""
        return spark.createDataFrame([(name, *row) for name, row in self.sums.items()], _SCHEMA)


def alerts(metrics: DataFrame, latency_ms: float = LATENCY_MS, write_rate: float = WRITE_RATE) -> DataFrame:
    """Metrics with rate (per cent), mean_ms and ``alerts``, the names of the thresholds that are passed, joined by commas."""
    rate = F.col("written") * 100.0 / F.col("total")
    named = F.concat_ws(",", F.when(F.col("max_ms") > latency_ms, "LATENCY"), F.when(rate < write_rate, "WRITE_RATE"))
    return metrics.select("stream", "total", "written", F.round(rate, 6).alias("rate"), "min_ms", "max_ms", F.round(F.col("sum_ms") / F.col("total"), 6).alias("mean_ms"), named.alias("alerts"))
