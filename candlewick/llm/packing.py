"""Packing by minimum bin slack: subset sums over the lengths still there fill each window closest to capacity."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.bpe import default_path
from candlewick.llm.common import documents, durable, slices, texts

CAPACITY = 1024
#: The id that ends each document.
END_ID = 0
#: Parts that the rows of one length are numbered in, so that a hot length is no single group.
SALTS = 256


class Pattern(NamedTuple):
    """``times`` windows that each hold ``counts[length]`` whole pieces, longest first, then the first ``cut[1]`` ids of a piece of length ``cut[0]``."""

    counts: dict[int, int]
    times: int
    cut: tuple[int, int] | None = None


def fill(remaining: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of ``remaining`` lengths (with counts) whose sum comes closest to ``capacity`` from below.

    Bit s of a bitset says that sum s can be made; a length's count is split into powers of two, longest lengths
    first. The counts are found by going back through the bitsets.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in remaining if remaining[x] > 0 and x <= capacity), reverse=True):
        left, size = min(remaining[length], capacity // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> capacity & 1:
            break
    at, counts = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            counts[length] = counts.get(length, 0) + take
            at -= length * take
    return counts


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up the histogram (pieces by length), and the rests of those that they cut.

    Each window takes the longest piece left and the fill that leaves the least slack. Where slack is over 1/128 of
    the window, the longest piece left is cut so that its begin fills the window, and its rest is a piece again:
    whatever the lengths, only the last windows are padded by more. A pattern is used as often as its lengths last.
    The work depends on the number of lengths, at most ``capacity``, not on that of pieces.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        counts = fill(left, capacity - longest)
        left[longest] += 1
        counts[longest] = counts.get(longest, 0) + 1
        slack = capacity - sum(k * n for k, n in counts.items())
        # what is left besides is longer than the slack, or it would be in the fill
        other = max((k for k, n in left.items() if n > counts.get(k, 0)), default=0) if slack * 128 > capacity else 0
        times = min(left[k] // (n + (k == other)) for k, n in (counts | ({other: counts.get(other, 0)} if other else {})).items())
        for k, n in counts.items():
            left[k] -= n * times
        if other:
            left[other] -= times
            left[other - slack] = left.get(other - slack, 0) + times
        left = {k: n for k, n in left.items() if n}
        out.append(Pattern(dict(sorted(counts.items(), reverse=True)), times, (other, slack) if other else None))
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a whole text by a ``tokenizers`` byte-level BPE file, special strings as that library takes them.

    The merges run in tiktoken, over the ranks that the file holds; texts with characters beyond Latin ones,
    for which the libraries' Unicode tables can differ, go through tokenizers itself, which is loaded for the first of them.
    """
    import json

    import regex
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = ByteLevel.alphabet()
    own = [b for b in range(256) if chr(b) in alphabet]
    others = [b for b in range(256) if chr(b) not in alphabet]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    odd = regex.compile("[^\x00-\u024f\u2000-\u206f]")
    names = set(special)
    library = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        if odd.search(text):
            return np.array(library().encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode(text, allowed_special=names), "<u4")

    return encode


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: (doc_id, text) to pieces of at most ``capacity`` ids; those that aren't full carry their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in slices(batch, 1):
                owner, start, length, crc, total, held = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4").tobytes()
                    for at in range(0, len(ids), 4 * capacity):
                        piece = ids[at : at + 4 * capacity]
                        owner.append(i)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                        held.append(piece if len(piece) < 4 * capacity else None)
                doc = part.column(0).take(pa.array(owner, pa.int64()))
                numbers = {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}
                yield pa.RecordBatch.from_pydict({"doc_id": doc} | numbers | {"ids": pa.array(held, pa.binary())})

    return run


class Slots(NamedTuple):
    """Where the pieces of one length go, in the order of their index: for each range of indices its end, pieces a
    window, first sequence, offset, ids that are cut off (0: the whole piece is placed) and the first rest's index."""

    end: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    cut: np.ndarray
    rest: np.ndarray


def slots(patterns: list[Pattern], histogram: dict[int, int]) -> dict[int, Slots]:
    """The ranges of each length. Rests of cut pieces are numbered after the pieces that have their length from the start."""
    rows: dict[int, list] = {}
    made, sequence = dict(histogram), 0
    for counts, times, cut_ in patterns:
        offset = 0
        for length, n in counts.items():
            mine = rows.setdefault(length, [])
            mine.append(((mine[-1][0] if mine else 0) + n * times, n, sequence, offset, 0, 0))
            offset += length * n
        if cut_:
            length, size = cut_
            mine = rows.setdefault(length, [])
            mine.append(((mine[-1][0] if mine else 0) + times, 1, sequence, offset, size, made.get(length - size, 0)))
            made[length - size] = made.get(length - size, 0) + times
        sequence += times
    return {k: Slots(*np.array(v, np.int64).T) for k, v in rows.items()}


def placed(histogram: dict[int, int], capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: pieces with their index among those of their length to pieces in sequences."""
    where = slots(plan(histogram, capacity), histogram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, crc, total, index = (batch.column(c).to_numpy().copy() for c in ("start", "length", "ids_crc32", "doc_tokens", "index"))
            ids, first, now, out = batch.column("ids"), start.copy(), np.arange(len(start)), []
            changed = np.zeros(len(start), bool)
            while len(now):  # a rest goes round again
                size, sequence, offset = length[now], np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)
                part = size.copy()
                for k in np.unique(size).tolist():
                    s, at = where[k], np.flatnonzero(size == k)
                    i = index[now[at]]
                    r = np.searchsorted(s.end, i, side="right")
                    inside = i - np.where(r > 0, s.end[r - 1], 0)
                    sequence[at] = s.sequence[r] + inside // s.each[r]
                    offset[at] = s.offset[r] + inside % s.each[r] * k
                    part[at] = np.where(s.cut[r] > 0, s.cut[r], k)
                    index[now[at]] = s.rest[r] + inside
                out.append((now, start[now], part, sequence, offset))
                more = part < size
                changed[now[more]] = True
                start[now] += part
                length[now] -= part
                now = now[more]
            row, begin, part, sequence, offset = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
            sums = crc[row]
            for j in np.flatnonzero(changed[row]).tolist():
                at = 4 * int(begin[j] - first[row[j]])
                sums[j] = zlib.crc32(ids[int(row[j])].as_py()[at : at + 4 * int(part[j])])
            doc = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_pydict({"doc_id": doc, "start": begin, "length": part, "ids_crc32": sums, "doc_tokens": total[row], "sequence_id": sequence, "offset": offset})

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece.

    A document's ids are cut every ``capacity``; full pieces are sequences of their own, the others are packed
    by the plan for all documents' lengths, which may cut some of them once more. Null text counts as empty: the end id alone; repeated rows and null
    doc_id stay, each row with pieces of its own; texts of any length are cut whole; an empty table gives no rows; other columns are ignored.
    Sequence numbers are distinct, and need not be without gaps.
    """
    pieces = durable(texts(docs).mapInArrow(cut(path or default_path("byte_bpe_50k.json"), capacity), PIECE), "pieces")
    rests = pieces.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    # at most capacity * SALTS rows, whatever the number of documents
    sizes = sorted((r.length, r.salt, r.n) for r in rests.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    histogram: dict[int, int] = {}
    before = []
    for length, salt, n in sizes:
        before.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    begin = docs.sparkSession.createDataFrame(before, "length long, salt int, before long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = rests.withColumn("rank", F.row_number().over(order) - 1).join(begin, ["length", "salt"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    numbered = numbered.select(*columns, "ids", (F.col("rank") + F.col("before")).alias("index"))
    packed = numbered.mapInArrow(placed(histogram, capacity), PLACED)
    # full pieces need no place: their sequences follow from where they stand in the table, below all others
    full = pieces.filter(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(documents(spark, sf_dir))
