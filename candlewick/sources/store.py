"""A keyed table that many streams and jobs write: a key is stored once, a batch counts once, readers see whole commits.

``rows/commit=<id>/day=<day>`` holds what a commit added, ``log/<version>.json`` says which commits count, in order. A
log file is created only where none is, so of two writers of one version the later one looks at what the other added
and goes on with the next version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from candlewick.operators.signals import fresh


class Saved(NamedTuple):
    """What a batch came to: rows added, and rows whose key was there or came twice."""

    inserted: int
    skipped: int


class Store:
    """The table at ``path``: rows of ``schema`` with ``keys`` (none: every row is kept), by the days of ``ts``.

    Of rows of a batch with one key the first by ``arrival`` is kept, any one without it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], ts: str = "ts", arrival: str | None = None):
        self.spark, self.path, self.keys, self.ts, self.arrival = spark, path.rstrip("/"), keys, ts, arrival
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, commit string, day date"

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> list[dict]:
        """All commits in order: version, id, stream, batch, inserted, skipped. One small file for each, read by the driver."""
        folder, files = self._hadoop(f"{self.path}/log"), self._files()
        if not files.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in files.listStatus(folder))
        read = self.spark._jvm.org.apache.commons.io.IOUtils.toString
        out = []
        for name in names:
            if name.endswith(".json"):
                stream = files.open(self._hadoop(f"{self.path}/log/{name}"))
                try:
                    text = read(stream, "UTF-8")
                finally:
                    stream.close()
                if text:
                    out.append(json.loads(text))
        return out

    def _committed(self, entry: dict) -> bool:
        """Create the entry's log file; False if its version has been taken."""
        path = self._hadoop(f"{self.path}/log/{entry['version']:012d}.json")
        try:
            out = self._files().create(path, False)
        except (Py4JJavaError, PySparkException):
            if self._files().exists(path):
                return False
            raise
        out.write(json.dumps(entry).encode())
        out.close()
        return True

    def _of(self, commits: list[dict]) -> DataFrame:
        table = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows") if commits else self.spark.createDataFrame([], self.schema)
        return table.filter(F.col("commit").isin([c["id"] for c in commits]))

    def read(self, begin: object = None, end: object = None) -> DataFrame:
        """Stored rows, of the days from ``begin`` to ``end`` where these are given: other days' files aren't listed for reading."""
        return self._days(self.log(), begin, end).select(*self.columns)

    def _days(self, commits: list[dict], begin: object = None, end: object = None) -> DataFrame:
        found = self._of(commits)
        if begin is not None:
            found = found.filter(F.col("day") >= F.lit(begin).cast("date"))
        return found if end is None else found.filter(F.col("day") <= F.lit(end).cast("date"))

    def save(self, batch: DataFrame, stream: str, number: int) -> Saved:
        """Add the rows of a stream's batch whose key isn't stored. A batch that has been saved adds nothing and gives its counts again."""
        commits = self.log()
        for c in commits:
            if (c["stream"], c["batch"]) == (stream, number):
                return Saved(c["inserted"], c["skipped"])
        rows = batch.select(*self.columns, F.to_date(self.ts).alias("day")).persist()
        try:
            begin, end, size = rows.agg(F.min("day"), F.max("day"), F.count("*")).first()
            new = fresh(rows, self._days(commits, begin, end), self.keys, self.arrival) if self.keys else rows
            while True:
                # what is written is what is committed: a batch computed anew after a failure has another id
                commit = uuid.uuid4().hex
                folder = f"{self.path}/rows/commit={commit}"
                new.select(*self.columns, "day").write.partitionBy("day").parquet(folder)
                inserted = self.spark.read.schema(self.schema).parquet(folder).count()
                entry = {"version": commits[-1]["version"] + 1 if commits else 0, "id": commit, "stream": stream, "batch": number, "inserted": inserted, "skipped": size - inserted}
                if self._committed(entry):
                    return Saved(inserted, size - inserted)
                # another writer was first: its keys are stored now
                known, commits = len(commits), self.log()
                others = commits[known:]
                for c in others:
                    if (c["stream"], c["batch"]) == (stream, number):
                        return Saved(c["inserted"], c["skipped"])
                if self.keys:
                    new = self._of([entry]).drop("commit").join(self._days(others, begin, end).select(*self.keys), self.keys, "left_anti")
        finally:
            rows.unpersist()

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch; ``stream`` names the query, and is to be the same when it is started again from its checkpoint."""

        def write(batch: DataFrame, number: int) -> None:
            self.save(batch, stream, number)

        return write
