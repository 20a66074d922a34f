"""Near copies by exact Jaccard similarity of five-word shingles: MinHash bands find pairs, shingle sets verify them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import simhash
from candlewick.llm.common import Memo, dropped, durable, map_texts, slices, texts
from candlewick.llm.graph import components

WIDTH = 5
#: Least similarity of near copies.
LEAST = 0.8
#: Bands of minima: at a similarity of 0.8 one in 17,000 pairs shares no band.
BANDS, ROWS = 32, 6
#: Bits of the map that tells which texts needn't be looked at.
BITS = 1 << 23
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of hashes (XXH64) of a text's five-word shingles; of all its words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    n = max(len(words) - WIDTH + 1, 1) if words else 0
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + WIDTH]), simhash.SEED) for i in range(n)], np.uint64))


def keys() -> Callable[[list], dict]:
    """For map_texts: a number for each text's words, 0 without a word."""
    from xxhash import xxh64_intdigest

    def one(text: str | None) -> int:
        words = (text or "").encode().translate(_LOWER).split()
        return xxh64_intdigest(b" ".join(words), simhash.SEED) if words else 0

    return lambda batch: {"fp": pa.array(np.array([one(t) for t in batch], np.uint64).view(np.int64))}


def _bands(found: np.ndarray) -> list[int]:
    """A number for each band of a shingle set: equal where the band's minima are."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        mixed = found[at : at + 4096, None] * _MIX[0]
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    sums = (low * _MIX[1]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return sums.view(np.int64).tolist()


def described() -> Callable[[list], dict]:
    """For map_texts: key, 3-word fingerprint, number of shingles, bands."""
    key, fingerprint = keys(), simhash.fingerprints(3)()

    def run(batch: list) -> dict:
        sets = [shingles(t) for t in batch]
        return {"key": key(batch)["fp"], "fp": fingerprint(batch)["fp"], "n": pa.array([len(s) for s in sets], pa.int64()), "bands": pa.array([_bands(s) for s in sets], pa.list_(pa.int64()))}

    return run


def _might_hold(keys_: DataFrame) -> np.ndarray:
    """A bitmap of keys (which are hashes), 1 MB at most whatever their number: where a bit isn't set, no key is."""
    bit = F.pmod("key", F.lit(BITS))
    found = keys_.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    held = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in found.collect():  # at most BITS / 32768 rows of 4 kB
        held[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return held


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, near, shared, over, others) for the pairs (a, b) of keys: whether they are near copies, which of the shingles of ``a`` in
    order ``b`` has (64 bits a number), how many others ``b`` has, and these hashed to two bits for each shingle of ``a``."""
    pairs = durable(pairs.distinct(), "near-pairs")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    held = _might_hold(wanted)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = keys()
        for batch in batches:
            for part in slices(batch, 0):
                found = key(part.column(0).to_pylist())["fp"]
                bit = found.to_numpy() % BITS
                at = bit % 32768
                some = pa.RecordBatch.from_pydict({"key": found, "text": part.column(0)})
                yield some.filter(pa.array((held[bit // 32768, at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Memo(shingles, 64, longest=1 << 40)
        for batch in batches:
            for part in slices(batch, "y", rows=64):
                near, shared, over, others = [], [], [], []
                for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                    p, q = sets[x], sets[y]
                    has = np.isin(p, q, assume_unique=True)
                    both = int(has.sum())
                    near.append(both * 5 >= (len(p) + len(q) - both) * 4)
                    shared.append(np.packbits(np.pad(has, (0, -len(has) % 64)), bitorder="little").view(np.int64))
                    over.append(len(q) - both)
                    marks = np.zeros(64 * (len(p) // 32 + 1), bool)
                    marks[(q[np.isin(q, p, assume_unique=True, invert=True)] % np.uint64(len(marks))).astype(np.int64)] = True
                    others.append(np.packbits(marks, bitorder="little").view(np.int64))
                bits = {k: pa.array(v, pa.list_(pa.int64())) for k, v in (("shared", shared), ("others", others))}
                yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "near": near, "shared": bits["shared"], "over": pa.array(over, pa.int64()), "others": bits["others"]})

    # one step in Python: two in a row need two workers for each core, and Spark keeps them, with all that they hold, to the end
    found = docs.select("text").mapInArrow(asked, "key long, text string")
    # copies are one row for each task before they meet
    found = durable(found.groupBy("key").agg(F.min("text").alias("text")).join(wanted, "key", "left_semi"), "near-texts")
    met = pairs.join(found.select(F.col("key").alias("b"), F.col("text").alias("y")), "b").join(found.select(F.col("key").alias("a"), F.col("text").alias("x")), "a")
    out = durable(met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, near boolean, shared array<long>, over long, others array<long>"), "near-links")
    dropped(pairs, found)
    return out


def links(nodes: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) that with ``known`` ones join all pairs of ``nodes`` (key, n, bands) that share a band and are near copies.

    Each member of a band is first compared with its pivot alone, the member that shares the most bands with others
    (near copies of one text mostly have it as the pivot of all their bands). Two members share no more shingles than
    both share with the pivot, and no more of those that it lacks than one has less those that are hashed to where the other
    has none, all of which the comparisons told. All pairs in a band that this bound doesn't rule out, and that aren't joined by then, are compared, so that none is passed over.
    """
    placed = nodes.select("key", "n", F.explode("bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = durable(placed.join(sizes, "band"), "bands")
    score = met.groupBy("key").agg(F.sum("size").alias("score"))
    pivots = met.join(score, "key").groupBy("band").agg(F.max(F.struct("score", "key")).alias("top")).select("band", F.col("top.key").alias("pivot"))
    seated = durable(met.join(pivots, "band").select("band", "key", "n", "pivot"), "seated-bands")
    star = compared(seated.filter("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")), docs)
    first = star.filter("near").select("a", "b")
    roots = components(known.unionByName(first)).withColumnRenamed("node", "key")
    far = star.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "shared", "over", "others")
    rest = seated.filter("key != pivot").join(far, ["pivot", "key"]).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # bands whose members aren't all joined
    largest = rest.groupBy("band", "root").agg(F.count("*").alias("size")).groupBy("band").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("roots"))
    rest = durable(rest.join(largest.filter("roots > 1").select("band", F.col("top.root").alias("top")), "band"), "open-bands")
    side = lambda x: ["band", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "root", "shared", "over", "others"))]
    left, right = rest.filter("root != top").select(*side("a")), rest.select(*side("b"), "top")
    bits = lambda x, y, kept: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(kept(p, q))), F.lit(0), lambda n, k: n + k)
    both = bits("shared_a", "shared_b", lambda p, q: p.bitwiseAND(q))
    alone = lambda p, q: p.bitwiseAND(F.bitwise_not(q))
    others = F.least("over_a", "over_b")
    common = F.least(F.col("over_a") - bits("others_a", "others_b", alone), F.col("over_b") - bits("others_b", "others_a", alone))
    enough = lambda n: n * 9 >= (F.col("n_a") + F.col("n_b")) * 4
    # of two members outside the largest component one order is enough
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("top")) | (F.col("key_a") < F.col("key_b")))
    may = enough(F.least(F.col("n_a") - F.col("over_a"), F.col("n_b") - F.col("over_b")) + others) & enough(both + others) & enough(both + common)
    pair = left.join(right.withColumnRenamed("band", "band_b"), (F.col("band") == F.col("band_b")) & once & may)
    pair = pair.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    pair = pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = first.unionByName(compared(pair, docs).filter("near").select("a", "b"))
    dropped(met, seated, rest)
    return found


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, fp being its key, and (fp, component_id) of every key."""
    docs = texts(docs)
    prints = durable(map_texts(docs, described, "doc_id long, key long, fp long, n long, bands array<long>"), "near-prints")
    nodes = durable(prints.groupBy("key").agg(F.min("doc_id").alias("low"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands")), "near-nodes")
    stands = durable(nodes.groupBy("fp").agg(F.min("key").alias("b")), "near-stands")
    same = nodes.join(stands, "fp").select(F.col("key").alias("a"), "b")
    near = simhash.links(stands.select(F.col("fp").alias("node"), "fp"))
    near = near.join(stands.select(F.col("fp").alias("a"), F.col("b").alias("key_a")), "a").join(stands.select(F.col("fp").alias("b"), F.col("b").alias("key_b")), "b")
    known = durable(same.unionByName(near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).filter("a != b"), "near-known")
    roots = components(known.unionByName(links(nodes, docs, known))).withColumnRenamed("node", "key")
    named = durable(nodes.join(roots, "key", "left").select("key", "low", F.coalesce("root", "key").alias("root")), "near-named")
    dropped(nodes, stands, known)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.select("doc_id", F.col("key").alias("fp")), named.join(lowest, "root").select(F.col("key").alias("fp"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """As simhash.representatives, with components that join op1's (3-word fingerprints within 3 bits) and all
    found pairs of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return simhash.chosen(docs, *_named(docs), keys)
