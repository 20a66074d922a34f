"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and which of their tokens overlap.

Arrow batches tokenise, with the ends of both merged by numpy: the ids along the stretches between neighbouring ends, and
each side's ids as text, cut at common ends. Spark's functions make groups and links of these, an array each, and count
pairs over the corpus. A text costs about as much as it is long.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.bpe import default_path
from candlewick.llm.common import documents, durable, slices, texts

#: At most as many id pairs are broadcast with their counts; all others are joined by pair.
COMMON = 250_000
BLANK = "▁"


class Tokens:
    """Both tokenizers, with the bytes of each of their ids.

    Byte pairs are merged by tiktoken over the ranks that the file holds. Texts with characters beyond Latin ones, for
    which the libraries' Unicode tables can differ, go through tokenizers itself.
    """

    def __init__(self, byte_path: str, piece_path: str):
        import public_tokenizers
        import regex
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = b = SentencePieceProcessor(model_file=piece_path)
        # the byte alphabet: printable bytes stand for themselves, the others follow from 256 on in order
        alphabet = set(ByteLevel.alphabet())
        others = [b for b in range(256) if chr(b) not in alphabet]
        byte = {chr(b): b for b in range(256) if chr(b) in alphabet} | {chr(256 + i): b for i, b in enumerate(others)}
        names = {i: t for t, i in self.a.get_vocab().items()}
        special = self.a.get_added_tokens_decoder()
        self.a_bytes = [names[i].encode() if i in special else bytes(byte[c] for c in names[i]) for i in range(len(names))]
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(BLANK, " ").encode() for i in range(len(b))]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int32) for table in (self.a_bytes, self.b_bytes))
        # an id as text: with a comma, and after all of these with a semicolon, for those that close a group
        self.a_names, self.b_names = ([f"{i}{mark}" for mark in ",;" for i in range(len(table))] for table in (self.a_bytes, self.b_bytes))
        ranks = {token: i for i, token in enumerate(self.a_bytes) if i not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = regex.compile("[^\x00-\u024f\u2000-\u206f]")

    def first(self, text: str) -> list[int]:
        """Ids of a space and the text by the byte-level tokenizer, special strings as text."""
        return self.a.encode(text, add_special_tokens=False).ids if self.odd.search(text) else self.fast.encode_ordinary(text)

    def both(self, batch: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by both; none where either's bytes aren't those of a space and the text."""
        found = iter(self.b.encode([t for t in batch if t], num_threads=1))
        none = np.empty(0, np.int32)
        for text in batch:
            a_ids, b_ids = none, none
            if text:
                a, b, whole = self.first(" " + text), next(found), b" " + text.encode()
                if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
                    a_ids, b_ids = np.array(a, np.int32), np.array(b, np.int32)
            yield a_ids, b_ids


@lru_cache(maxsize=1)
def tokens(byte_path: str, piece_path: str) -> Tokens:
    """The tokenizers of two files, kept for all tasks of a Python worker."""
    return Tokens(byte_path, piece_path)


def grouped(ids: np.ndarray, ends: np.ndarray, other: np.ndarray, names: list[str]) -> str:
    """One tokenizer's ids as text, with semicolons where the other's tokens end too. Both end together at last."""
    closes = other[np.searchsorted(other, ends)] == ends
    return "".join(map(names.__getitem__, (ids + closes * (len(names) // 2)).tolist()))[:-1]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), pa.int32()))


def tokenised(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, a_along, b_along, a_groups, b_groups) for each document, by both tokenizers.

    ``a_along`` and ``b_along`` have the ids of the tokens that hold each stretch between neighbouring ends of either;
    ``a_groups`` and ``b_groups`` all ids in order as text, with a semicolon at common ends and commas elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(byte_path or default_path("byte_bpe_50k.json"), piece_path or default_path("piece_bpe_32k.model"))
        for batch in batches:
            for part in slices(batch):
                along, sizes, texts_ = ([], []), ([], []), ([], [])
                for a, b in known.both(part.column("text").to_pylist()):
                    a_ends, b_ends = np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b])
                    ends = np.unique(np.concatenate([a_ends, b_ends]))
                    for k, (ids, own, other, names) in enumerate(((a, a_ends, b_ends, known.a_names), (b, b_ends, a_ends, known.b_names))):
                        sizes[k].append(len(ids))
                        along[k].append(ids[np.searchsorted(own, ends)])
                        texts_[k].append(grouped(ids, own, other, names))
                numbers = {n: pa.array(v, pa.int64()) for n, v in zip(("n_a", "n_b"), sizes, strict=True)}
                lists = {n: _lists(v) for n, v in zip(("a_along", "b_along"), along, strict=True)}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | numbers | lists | {n: pa.array(v, pa.string()) for n, v in zip(("a_groups", "b_groups"), texts_, strict=True)})

    return texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, a_along array<int>, b_along array<int>, a_groups string, b_groups string")


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) for each row of documents.

    ``groups`` has the ids between byte offsets at which both tokenizers' tokens end, each as ``a1,a2|b1``. ``links``
    has each pair of occurrences with overlapping bytes, in the order of the text, as ``a * 2**32 + b``. Texts that are null,
    empty, or whose bytes a tokenizer doesn't give back have no tokens. Texts are taken whole; repeated rows and null
    doc_id stay; an empty table gives no rows; other columns are ignored.
    """
    rows = tokenised(docs, byte_path, piece_path)
    groups = F.zip_with(F.split("a_groups", ";"), F.split("b_groups", ";"), lambda a, b: F.concat(a, F.lit("|"), b))
    groups = F.when(F.col("n_a") > 0, groups).otherwise(F.array().cast("array<string>"))
    # the stretch before an end lies in one token of each tokenizer: that is a link
    links = F.zip_with("a_along", "b_along", lambda a, b: F.shiftleft(a.cast("long"), 32) + b)
    # each token ends once, and a link for each end counts the common ones once
    common = F.col("n_a") + F.col("n_b") - F.size("a_along")
    return rows.select("doc_id", "n_a", "n_b", common.alias("n_groups"), groups.alias("groups"), links.alias("links"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best) of rows with ``links``: how many rows have a pair, and whether no pair of its first id has more."""
    counts = rows.select(F.explode_outer(F.array_distinct("links")).alias("pair")).filter("pair is not null").groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftrightunsigned("pair", 32)))  # one row for each id of the second vocabulary at most
    return counts.withColumn("best", F.col("docs") == most)


def scored(rows: DataFrame, common: int = COMMON) -> DataFrame:
    """(row, n_best, count_sum) of rows with (row, links): links whose pair is its first id's best, and the counts of all.

    Pairs that at least one ``common``-th of all distinct pairs of documents are can be ``common`` at most: these are
    broadcast, and no pair among the others is frequent enough to fill a task of the join. Up to ``common`` pairs in
    all are broadcast whole. Of the others a document has one row for each, with its number of links.
    """
    counts = durable(pair_counts(rows), "alignment-pairs")
    size = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("docs"), F.lit(0)).alias("all")).first()
    often = F.lit(size["n"] <= common) | (F.col("docs") * common >= size["all"])
    links = rows.select("row", F.explode_outer("links").alias("pair")).filter("pair is not null")
    frequent = F.broadcast(counts.filter(often))
    parts = links.join(frequent, "pair").select("row", "docs", "best", F.lit(1).cast("long").alias("times"))
    if size["n"] > common:
        others = links.join(frequent, "pair", "left_anti").groupBy("row", "pair").agg(F.count("*").alias("times"))
        met = others.join(counts.filter(~often).hint("merge"), "pair")
        parts = parts.unionByName(met.select("row", "docs", "best", "times"))
    return parts.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def alignment(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of documents.

    A pair's count is the number of documents that hold it linked. Documents without tokens (see ``aligned``) have
    zeros and an empty digest. Rows are numbered once, in a written table, so that equal doc_ids stay apart.
    """
    rows = aligned(docs, byte_path, piece_path)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise("").alias("groups_sha256")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest, "links")
    rows = durable(rows, "alignment-rows")
    found = durable(scored(rows.select("row", "links"), common), "alignment-scores")
    out = rows.drop("links").join(found, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, byte_bpe_50k.json against piece_bpe_32k.model."""
    return alignment(documents(spark, sf_dir))
