"""What the operators of this folder share: durable tables, Arrow mapping and small caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text and rows that a task turns into Python objects at once.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches at BATCH_ROWS rows at most: rows with whole texts are wide, and JVM and Python worker hold a batch whole."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, under these names: other columns can't clash with an operator's own."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set a local master gets one of its own; a cluster gets an error, since its machines share none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="candlewick-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the write that made them has ended, not when the driver collects garbage."""
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.conf
    before = conf.get(name)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    with tidy(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``durable`` tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, text: int | str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into parts of at most ``rows`` rows and ``most`` bytes of ``text`` (one longer text is a part of its own)."""
    column = batch.column(text)
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, before = 0, 0
    while begin < batch.num_rows:
        end = min(max(int(np.searchsorted(size, before + most, side="right")), begin + 1), begin + rows)
        yield batch.slice(begin, end - begin)
        begin, before = end, int(size[end - 1])


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """Map (doc_id, text) in slices of bounded size.

    ``make`` runs once in a task and returns a function from a slice's texts (nulls as None) to columns by
    name; doc_id comes first in ``schema`` and is carried over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | work(part.column(1).to_pylist()))

    return df.select("doc_id", "text").mapInArrow(run, schema)


class Memo(dict):
    """A dictionary that computes what it lacks. It holds at most ``most`` entries and as many older ones.

    Keys longer than ``longest`` are computed each time and never held, so that what it holds is bounded in bytes too.
    """

    def __init__(self, compute: Callable, most: int = 200_000, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest, self.older = compute, most, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


#: A-Z and what they become; no other letter changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
