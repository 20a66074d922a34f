"""Language ID by hyperdimensional profiles: permuted letter vectors bound into trigrams, bundled, compared by cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import documents, slices, small_batches

#: Dimensions of the vectors.
DIMENSIONS = 1024
UNKNOWN = "und"
#: Below this cosine a text is unlike every language. Chance alone gives 1 / sqrt(DIMENSIONS) = 0.031 for one language and
#: up to 0.126 for texts in unseen scripts, random Latin letters up to 0.166 (200 texts a kind and length, four languages).
LEAST_SCORE = 0.18
#: Below this many trigrams the floor is lower in proportion: a clean short text shares few trigrams with a profile.
SHORT = 80
#: Trigrams whose vectors are held at once.
BLOCK = 4096


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=20_000)
def letter(code: int) -> np.ndarray:
    """The random vector of +1 and -1 that stands for a letter (or 32, the gap between words)."""
    return np.random.default_rng(code).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' trigrams of lower-case letters and gaps: (owner, place in ``grams``) for each, and grams (n, 3).

    Runs of other characters are one gap; each text begins and ends with a gap. A trigram has a letter always.
    """
    joined = "\0".join(f" {t.replace(chr(0), ' ')} " for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = codes == 0
    codes = np.where(_is_letter()[codes] | ends, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, ends = codes[keep], ends[keep]
    owner = np.cumsum(ends)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[letters] = np.arange(len(letters))
    c, n = place[codes], len(letters)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    good = ~(ends[:-2] | ends[1:-1] | ends[2:])
    key = ((c[:-2] * n + c[1:-1]) * n + c[2:])[good]
    if n**3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(key, minlength=n**3))
        rank = np.zeros(n**3, np.int64)
        rank[found] = np.arange(len(found))
        key = rank[key]
    else:
        found, key = np.unique(key, return_inverse=True)
    return owner[:-2][good], key, letters[np.stack([found // (n * n), found // n % n, found % n], axis=1)]


def bound(grams: np.ndarray) -> np.ndarray:
    """The vector of each trigram: its letters' vectors, permuted by their place (rotated), multiplied."""
    kinds, place = np.unique(grams, return_inverse=True)
    table = np.stack([letter(int(k)) for k in kinds])
    place = place.reshape(grams.shape)
    return (np.roll(table, 2, axis=1)[place[:, 0]] * np.roll(table, 1, axis=1)[place[:, 1]] * table[place[:, 2]]).astype(np.float32)


def bundles(owner: np.ndarray, key: np.ndarray, grams: np.ndarray, owners: int) -> np.ndarray:
    """Each owner's bundle: the sum of the vectors of its trigrams."""
    out = np.zeros((owners, DIMENSIONS))
    for at in range(0, len(grams), BLOCK):
        size = min(BLOCK, len(grams) - at)
        inside = (key >= at) & (key < at + size) if len(grams) > BLOCK else slice(None)
        counts = np.bincount(owner[inside] * size + key[inside] - at, minlength=owners * size)
        out += counts.reshape(owners, size).astype(np.float32) @ bound(grams[at : at + size])
    return out


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Each language's bundle over all rows of ``labelled`` (text, lang); rows with a null or without a letter add nothing.

    Tasks give one partial sum a language. The result has a vector for each language, however large the table.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                kinds, of = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                owner, key, grams = trigrams(part.column("text").to_pylist())
                if len(grams):
                    found = bundles(of[owner], key, grams, len(kinds))
                    for kind, v in zip(kinds.tolist(), found, strict=True):
                        total[kind] = total.get(kind, 0) + v
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "vector": [v.tolist() for v in total.values()]})

    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    parts = rows.mapInArrow(sums, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("place", "v"))
    whole = parts.groupBy("lang", "place").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("x"))
    found = {r.lang: np.array([x.v for x in r.x]) for r in whole.collect()}
    return {k: v for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def scored(profiles: dict[str, np.ndarray], names: list[str], least: float | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: keep the columns ``names``, add lang_pred and score from ``text``; with ``least``, keep rows whose score reaches ``floor`` alone."""
    langs = [UNKNOWN, *profiles]
    table = np.stack([v / np.linalg.norm(v) for v in profiles.values()]) if profiles else np.zeros((0, DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                owner, key, grams = trigrams([t or "" for t in part.column("text").to_pylist()])
                best, score = np.zeros(n, int), np.zeros(n)
                if len(grams) and len(table):
                    vectors = bundles(owner, key, grams, n)
                    size = np.linalg.norm(vectors, axis=1)
                    near = vectors @ table.T / np.maximum(size, 1e-9)[:, None]
                    has = np.bincount(owner, minlength=n) > 0
                    best = np.where(has, near.argmax(axis=1) + 1, 0)
                    score = np.where(has, near.max(axis=1).clip(0, 1), 0.0)
                found = pa.RecordBatch.from_pydict({c: part.column(c) for c in names} | {"lang_pred": [langs[b] for b in best], "score": score})
                yield found if least is None else found.filter(pa.array((best > 0) & (score >= floor(np.bincount(owner, minlength=n), least))))

    return run


def floor(n: np.ndarray, least: float) -> np.ndarray:
    """The least score of texts with ``n`` trigrams: ``least``, and in proportion below SHORT."""
    return least * np.minimum(np.asarray(n) / SHORT, 1)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2. Null ids aren't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of documents.

    Profiles are learned from text and lang of the documents that are not held out; predictions look at text
    alone. Null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing could
    be learned; ties go to the language first by name; repeated rows and null doc_id stay (null doc_id is not
    learned from, nor held out); an empty table gives no rows; other columns are ignored.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = prototypes(rows.filter(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))
    asked = rows.select("doc_id", held_out().alias("held_out"), "text")
    return asked.mapInArrow(scored(profiles, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double")


def known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that have a language, as the struct ``row``, with lang_pred and score.

    Rejected are texts without a letter (null and empty too) and those with a score below ``floor`` of their trigrams
    and ``least``, which are unlike every profile. Where nothing could be learned, every text with a letter stays. Repeated rows and null
    doc_id stay; an empty table gives no rows; columns of any name stay in ``row``.
    """
    rows = small_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = prototypes(rows.filter(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))
    if not profiles:
        return rows.filter(F.col("text").rlike(r"\p{L}")).select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    asked = rows.select("row", "text")
    schema = T.StructType([asked.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return asked.mapInArrow(scored(profiles, ["row"], least), schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return identify(documents(spark, sf_dir))
