"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import documents, durable, slices, small_batches

#: Most labelled documents that the classifier is fitted on; which ones, a hash of doc_id says.
SAMPLE = 20_000
#: Probabilities are summed as whole millionths, so that sums don't depend on the order of rows.
UNIT = 1_000_000
#: Sites whose sums are broadcast at most: some 10 MB.
BROADCAST = 100_000
#: Strength of a prior where sites don't differ beyond chance: as many documents.
FIRM = 1_000.0

_KINDS = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "blank": b" ", "line": b"\n", "stop": b".,;:", "quote": b"'\"()-",
    "mark": b"!?", "pipe": b"|", "symbol": b"#$%&*@^~+=_\\/<>[]{}`", "control": bytes(x for x in range(32) if x != 10) + b"\x7f", "wide": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(_KINDS)))
for _i, _k in enumerate(_KINDS.values()):
    _TABLE[list(_k), _i] = 1
FEATURES = (*_KINDS, "size", "word_size", "short_words", "long_words", "line_repeats", "word_repeats")


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, and sizes and repetition of words and lines; all zero for no text."""
    data = (text or "").encode()
    out = np.zeros(len(FEATURES))
    if not data:
        return out
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE
    out[: len(_KINDS)] = np.sqrt(kinds / len(data))
    words, lines = data.split(), data.split(b"\n")
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out[len(_KINDS) :] = np.log1p(len(data)), np.log1p(sizes.mean()), (sizes < 4).mean(), (sizes > 12).mean(), 1 - len(set(lines)) / len(lines), 1 - len(set(words)) / len(words)
    return out


class Classifier(NamedTuple):
    """Logistic regression over standardized features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Classifier:
    """Fit by Newton's method with an L2 penalty."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    model = Classifier(mean, scale, np.zeros(x.shape[1] + 1))
    a = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ model.weights, -12, 12)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ model.weights)
        model = model._replace(weights=model.weights + step)
        if np.abs(step).max() < 1e-8:
            break
    return model


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Classifier | None:
    """The classifier from at most ``most`` labelled documents, or None without both classes.

    Of rows that repeat a doc_id the one with the least features counts, so that the fit doesn't depend on the order of rows.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most this many rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [features(t).tolist() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "quality": part.column("quality"), "x": pa.array(found, pa.list_(pa.float64()))})

    rows = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>")
    found = sorted((r.quality, *r.x) for r in rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).collect())
    if len({f[0] for f in found}) < 2:
        return None
    table = np.array(found, float)
    return fit(table[:, 1:], table[:, 0])


def with_evidence(rows: DataFrame, model: Classifier | None, out: list[str]) -> DataFrame:
    """The columns ``out`` and ``p``: the classifier's probability of good quality from ``text``, in millionths (half without a classifier, null without a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = part.column("text").to_pylist()
                p = np.full(len(found), 0.5) if model is None else model.probability(np.array([features(t) for t in found]))
                whole = pa.array(np.rint(p * UNIT).astype(np.int64), mask=np.array([not t for t in found]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), whole], names=[*out, "p"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in out), T.StructField("p", T.LongType())]))


def _strength(rows: DataFrame, mean: Column, n: Column, s: Column) -> float:
    """Beta strength by moments: how much groups differ from ``mean`` beyond the chance of their sizes."""
    # between-group variance v of rates with binomial noise: strength = m (1 - m) / v - 1
    m = F.least(F.greatest(mean, F.lit(1e-4)), F.lit(1 - 1e-4))
    var = F.sum(n * (s / n - m) ** 2)
    noise = F.sum(m * (1 - m))
    r = rows.agg(var.alias("v"), noise.alias("noise"), F.sum(n * m * (1 - m)).alias("spread"), F.sum(n).alias("n")).first()
    if not r.n or r.v is None or r.v <= r.noise * (1 + 1e-9):
        return FIRM
    between = (r.v - r.noise) / r.n
    return float(min(FIRM, max(0.5, r.spread / r.n / between - 1)))


def posterior(docs: DataFrame, host: str = "source", path: str = "lang", labels: DataFrame | None = None, most: int = SAMPLE, carried: list[str] | None = None, written: bool = True) -> DataFrame:
    """The rows of ``docs`` (or their columns ``carried``) as the struct ``row``, with p_document, p_host, p_path and p_quality (0 to 1), and keep.

    Evidence of every document counts: a site's rate is the sum of its documents' probabilities, shrunk towards
    the rate above it (path to host, host to all) by a strength that the spread of sites gives; sparse sites stay
    near the prior. A document is left out of its own sites' rates, so that its evidence counts once. p_quality
    moves a document's own odds by its site's against all; keep is p_quality of at least a half. Null or empty text
    has p_document 0, adds nothing to its site but a document of bad quality, and is rejected; null host or path is a
    site of its own; without labels of both classes every text has a half, and is kept unless its site is below all;
    repeated rows and null doc_id stay; texts of any length count whole; an empty table gives no rows; columns of any name stay in ``row``.
    Rows are written with their evidence; if not ``written``, as suits wide rows of a stored table, texts are looked at again for the result.
    """
    docs = small_batches(docs)
    model = learned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, most) if labels is not None else None
    site = [F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text")]
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carried is None else carried))).alias("row")
    own = with_evidence(docs.select(row, *site), model, ["row", "host", "path"])
    if written:  # texts are looked at once: what is written has the evidence beside the row
        own = durable(own, "evidence")
    p = F.coalesce("p", F.lit(0))
    paths = durable((own if written else with_evidence(docs.select(*site), model, ["host", "path"])).groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum(p).alias("s_path")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    total = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s")).first()
    mean = min(max((total.s or 0) / UNIT / max(total.n or 0, 1), 1e-4), 1 - 1e-4)
    outer = _strength(hosts, F.lit(mean), F.col("n_host"), F.col("s_host") / UNIT)
    sites = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    shrunk = lambda s, n, strength, prior: (s / UNIT + strength * prior) / (n + strength)
    inner = _strength(sites, shrunk(F.col("s_host"), F.col("n_host"), outer, mean), F.col("n_path"), F.col("s_path") / UNIT)
    sums = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n_host", "s_host", "n_path", "s_path")
    if paths.count() <= BROADCAST:
        sums = F.broadcast(sums)
    # beyond that bound Spark joins by site, and splits hot ones
    met = own.join(sums, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    host_rate = shrunk(F.col("s_host") - p, F.col("n_host") - 1, outer, mean)
    path_rate = shrunk(F.col("s_path") - p, F.col("n_path") - 1, inner, host_rate)
    z = odds(p / UNIT) + odds(path_rate) - odds(F.lit(mean))
    quality = F.round(1 / (1 + F.exp(-z)), 6)
    found = met.select("row", (p / UNIT).alias("p_document"), F.round(host_rate, 6).alias("p_host"), F.round(path_rate, 6).alias("p_path"), quality.alias("p_quality"), "p")
    return found.withColumn("keep", F.coalesce((F.col("p_quality") >= 0.5) & F.col("p").isNotNull(), F.lit(False))).drop("p")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, with source as the host and language as the section below it."""
    found = posterior(documents(spark, sf_dir), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"), carried=["doc_id"])
    return found.select("row.doc_id", "p_document", "p_host", "p_path", "p_quality", "keep")
