"""Substring dedup: a log-structured index of window fingerprints, merged, verified and compacted."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import documents, durable, shared_folder, slices, small_batches, texts, tidy

WINDOW = 13
#: Words of an anchor; each window's anchor is its word run of this length with the least fingerprint.
ANCHOR = 5
#: Batches that the query over a whole table adds to the index one after another.
BATCHES = 3
#: Runs of the index; one more, and they are compacted into one.
RUNS = 2
# odd multipliers of the positions in a window, two lanes
_LANES = np.random.default_rng(20).integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_lanes(most: int = 400_000) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Two independent 64-bit fingerprints for each word (the halves of XXH3-128), kept for words seen lately."""
    from xxhash import xxh3_128_intdigest

    class Places(dict):
        """Where a word's fingerprints stand in ``table``."""

        def __missing__(self, word: bytes) -> int:
            h = xxh3_128_intdigest(word)
            at = self[word] = len(self)
            table[0, at], table[1, at] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
            return at

    table, places = np.zeros((2, most), np.uint64), Places()

    def lanes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal table
        if len(places) + len(words) > table.shape[1]:
            places.clear()
            if len(words) > table.shape[1]:
                table = np.zeros((2, 2 * len(words)), np.uint64)
        at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        return table[0, at], table[1, at]

    return lanes


def rolled(lane: np.ndarray, width: int, k: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` words, from the words' in lane ``k``; every word counts by its place."""
    n = len(lane) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out += lane[j : j + n] * _LANES[k, j]
    return _mixed(out)


def anchors(lane: np.ndarray, window: int = WINDOW, width: int = ANCHOR) -> np.ndarray:
    """For each window of a document its anchor: the least fingerprint of the word runs inside it.

    It depends on the window's words alone, so equal windows have equal anchors wherever they stand.
    """
    if len(lane) < window:
        return np.zeros(0, np.uint64)
    inner, n = rolled(lane, width, 0), len(lane) - window + 1
    least = inner[:n].copy()
    for j in range(1, window - width + 1):
        np.minimum(least, inner[j : j + n], out=least)
    return least


def windows(lanes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of a document, and an independent 64-bit fingerprint of its 13 words."""
    return anchors(lanes[0]), rolled(lanes[1], WINDOW, 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (anchor, windows, doc_id, more): the windows in a row that have one anchor.

    Documents of a slice that have the same windows at an anchor are one row (the others are in ``more``), so that
    a hot passage has a row for each slice, not for each document.
    """
    lanes = word_lanes()
    for batch in batches:
        for part in slices(batch, 1):
            doc = part.column(0).to_numpy()
            anchor, window, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, text in enumerate(part.column(1).to_pylist()):
                a, w = windows(lanes((text or "").encode().split()))
                anchor.append(a)
                window.append(w)
                owner.append(np.full(len(a), i))
            anchor, window, owner = np.concatenate(anchor), np.concatenate(window), np.concatenate(owner)
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            ends = np.append(at, len(anchor)).astype(np.int32)
            held = pa.ListArray.from_arrays(ends, pa.array(window.view(np.int64)))
            anchor, owner = anchor[at], doc[owner[at]]
            # rows with equal anchors and equal windows, the least doc_id first
            sums = np.add.reduceat(_mixed(window + np.uint64(1)), at) if len(at) else anchor
            order = np.lexsort((owner, sums, anchor))
            first = np.ones(len(order), bool)
            first[1:] = (anchor[order][1:] != anchor[order][:-1]) | (sums[order][1:] != sums[order][:-1])
            ends = np.cumsum(~first)[np.flatnonzero(np.append(first[1:], True))] if len(order) else np.zeros(0, np.int64)
            more = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(owner[order][~first]))
            one = order[first]
            more = pc.if_else(pa.array(np.diff(np.append(0, ends)) > 0), more, pa.scalar(None, more.type))
            yield pa.RecordBatch.from_pydict({"anchor": anchor[one].view(np.int64), "windows": held.take(pa.array(one)), "doc_id": owner[one], "more": more})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, repeats) to (row, n_words, n_removed, text, kept_sha256); repeats are keys of the windows to go."""
    lanes = word_lanes()
    for batch in batches:
        for part in slices(batch):
            out = {"n_words": [], "n_removed": [], "text": [], "kept_sha256": []}
            for text, repeats in zip(part.column("text").to_pylist(), part.column("repeats"), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if repeats.is_valid and n >= WINDOW:
                    anchor, window = windows(lanes(words))
                    key = (anchor ^ window).view(np.int64)
                    begins = np.flatnonzero(np.isin(key, np.concatenate([r.values.to_numpy() for r in repeats.values])))
                    edge = np.bincount(begins, minlength=n + 1) - np.bincount(begins + WINDOW, minlength=n + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                kept = b" ".join(words)
                for k, v in zip(out, (n, n - len(words), text if n == len(words) else kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"row": part.column("row")} | out)


class WindowIndex:
    """The log-structured index: immutable sorted runs of window hashes, bucketed by anchor, in a folder of the shared store.

    A row of a run holds an anchor, the hashes of windows that have it, and the documents that have these windows.
    ``add`` writes a batch as the newest run and merge-joins it with the older ones bucket by bucket, without another
    shuffle: windows with one anchor are verified by their hashes. Beyond ``most`` runs, ``compact`` first rewrites
    each bucket as one run that has equal rows of windows once, with their first document; no shuffle either. An index is
    opened again, in this session or a later one, by its path.
    """

    SCHEMA = "anchor BIGINT, windows ARRAY<BIGINT>, doc_id BIGINT, more ARRAY<BIGINT>, run INT"

    def __init__(self, spark: SparkSession, path: str | None = None, most: int = RUNS):
        self.spark, self.most = spark, most
        self.path = path or f"{shared_folder(spark)}/window-index-{uuid.uuid4().hex}"
        self.table: str | None = None
        there = [f.getPath().getName() for f in self._fs().listStatus(self._hadoop(self.path))] if self._fs().exists(self._hadoop(self.path)) else []
        done = [n for n in there if self._fs().exists(self._hadoop(f"{self.path}/{n}/_SUCCESS"))]
        # generation and buckets are in a folder's name; a generation that wasn't finished is passed over
        self.generation, self.buckets = max(((int(g), int(b)) for g, b in (n.split("-") for n in done)), default=(0, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.runs = 0
        if done:
            self.table = self._name()
            spark.sql(f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self._folder()}'")
            self.runs = (spark.table(self.table).agg(F.max("run")).first()[0] or 0) + 1

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self) -> str:
        return f"{self.path}/{self.generation}-{self.buckets}"

    def _name(self) -> str:
        return f"window_index_{uuid.uuid4().hex}"

    def _append(self, rows: DataFrame) -> None:
        name = self.table or self._name()
        with tidy(self.spark):
            rows.write.mode("append").bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", self._folder()).saveAsTable(name)
        self.table, self.runs = name, self.runs + 1

    def add(self, batch: DataFrame) -> DataFrame:
        """Index (doc_id, text) as the newest run; gives (doc_id, key) of its windows that a smaller doc_id of any run has too.

        Windows of one anchor are verified by 64 bits of their own, over all 13 words and independent of the anchor: however
        many windows stand round a common phrase, that is the chance that two of them are taken for one.
        """
        if self.runs >= self.most:
            self.compact()
        run = self.runs
        rows = small_batches(batch).filter("doc_id is not null").select("doc_id", "text").mapInArrow(_runs, "anchor long, windows array<long>, doc_id long, more array<long>")
        self._append(rows.withColumn("run", F.lit(run)).repartition(self.buckets, "anchor"))
        return self._repeated(run)

    def _repeated(self, run: int) -> DataFrame:
        """(doc_id, key) of the windows of a run that a smaller doc_id of it or an older run has too."""
        rows = self.spark.table(self.table)
        last = F.greatest("doc_id", F.coalesce(F.array_max("more"), F.col("doc_id")))
        held = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max(last).alias("hi"), F.max("run").alias("newest")).filter(f"lo < hi and newest = {run}")
        met = rows.join(held.select("anchor").hint("merge"), "anchor", "left_semi")
        each = met.select("anchor", F.explode("windows").alias("w"), "doc_id", "more", "run")
        # in the order of anchor and hash; what is to be held of a window is one row for each slice of documents
        first = F.min("doc_id").over(Window.partitionBy("anchor", "w"))
        later = each.withColumn("first", first).filter(f"run = {run} and (doc_id > first or more is not null)")
        docs = F.filter(F.concat(F.array("doc_id"), F.coalesce("more", F.array().cast("array<long>"))), lambda d: d > F.col("first"))
        key = F.col("anchor").bitwiseXOR(F.col("w"))
        return later.select(key.alias("key"), F.explode(F.array_distinct(docs)).alias("doc_id"))

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket, in which equal rows of windows are one row with their first document; then drop them."""
        old, folder = self.table, self._folder()
        merged = self.spark.table(old).groupBy("anchor", "windows").agg(F.min("doc_id").alias("doc_id"))
        self.generation, self.table, self.runs = self.generation + 1, None, 0
        self._append(merged.select("anchor", "windows", "doc_id", F.lit(None).cast("array<long>").alias("more"), F.lit(0).alias("run")))
        self.spark.sql(f"DROP TABLE {old}")
        self._fs().delete(self._hadoop(folder), True)

    def close(self) -> None:
        """Forget the table's name; the files stay for whoever opens the path again."""
        if self.table:
            self.spark.sql(f"DROP TABLE {self.table}")
        self.table = None

    def delete(self) -> None:
        """Forget the index and delete its files."""
        self.close()
        self._fs().delete(self._hadoop(self.path), True)


def repeated_windows(base: DataFrame, batches: int = BATCHES, index: WindowIndex | None = None) -> DataFrame:
    """(doc_id, repeats) from (doc_id, text): lists of keys of a document's windows that a smaller doc_id has too.

    Batches by ranges of doc_id are added to ``index`` one after another (of its own, deleted at the end, where none is given).
    """
    low, high = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    own = index or WindowIndex(base.sparkSession)
    step = ((high or 0) - (low or 0)) // batches + 1
    parts = []
    for k in range(batches):
        begin = (low or 0) + k * step
        found = own.add(base.filter(F.col("doc_id").between(begin, begin + step - 1)))
        # lists of keys are small beside the texts: a few files for each batch
        parts.append(durable(found.groupBy("doc_id").agg(F.collect_list("key").alias("keys")).coalesce(max(1, own.buckets // 4)), "repeats"))
    if index is None:
        own.delete()
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    # a document is in one batch, but for rows that repeat its id
    return both.groupBy("doc_id").agg(F.collect_list("keys").alias("repeats"))


def substring_dedup(docs: DataFrame, batches: int = BATCHES, index: WindowIndex | None = None) -> DataFrame:
    """The columns of ``docs`` but text as the struct ``row``, and n_words, n_removed, text and kept_sha256.

    text is as it was where nothing goes, else the kept words joined by one space.

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id, of ``docs`` or of
    what ``index`` has from before. Windows are equal if their anchors and
    independent 64-bit fingerprints of their 13 words are.
    Null text has no words; rows with equal doc_id don't part each other's words and all stay; null doc_id neither
    removes nor loses words; texts of any length are judged whole; an empty table gives no rows; other columns stay in ``row`` and can't clash.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("others") if others else F.lit(None).alias("others"))
    base = plain.select("doc_id", "text")
    both = (plain if others else base).join(repeated_windows(base, batches, index), "doc_id", "left")
    row = F.struct("doc_id", *(F.col(f"others.`{c}`").alias(c) for c in others)).alias("row")
    rows = both.select(row, "text", "repeats")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, text string, kept_sha256 string"
    return rows.mapInArrow(_kept, schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those removed, and the digest of those kept."""
    found = substring_dedup(texts(documents(spark, sf_dir)))
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE list_filter(regexp_extract_all(text, '[^ 	-
]+'), lambda x: x <> '') END AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 12)))) AS gone FROM g JOIN f USING (g) WHERE doc_id > first GROUP BY doc_id),
k AS (SELECT doc_id, len(words) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
