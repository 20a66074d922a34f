"""BPE round trips, token counts and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from candlewick.llm import bpe, counts, packing

P = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " ", "   ", "It's  ALL we'll need,\n\n don't\tyou?", "x<|endoftext|>  y<|startoftext|>\n<|endoftext|>", "ΣΑΣ İstanbul ǅ ẞ",
    "naïve café é ﬁ ﾊ 漢字 かな 😀👍🏽 ​ ", "a" * 3000, "ab" * 900 + " <s> </s> <unk> <0x0A>", "▁▁ a  b   c\t\td  ", "1234567 3.14 ٣٤ ½", "\x00\x1c\x85 q", "the cat " * 700,
]


def rows(spark):
    table = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], None), (None, "null id", "k")]
    return table, spark.createDataFrame(table, "doc_id long, text string, start string")


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    table, df = rows(spark)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for doc, text, _ in table:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.bpe_round_trip(df).collect()))) == sorted(map(str, want))


def test_forced_boundaries():
    pairs = bpe.inner_pairs(["ab", "bcd"])
    assert bpe.fragments("abcdab", pairs) == ["abcd", "ab"]
    assert bpe.merge(list("aaa"), lambda a, b: 0 if a == b == "a" else None) == ["aa", "a"]


def test_token_counts(spark):
    import sentencepiece

    table, df = rows(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", num_threads=1)), n > 50) for d, t, _ in table]
    assert sorted(map(str, map(tuple, counts.token_counts(df, limit=50).collect()))) == sorted(map(str, want))


def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    table, df = rows(spark)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = packing.pack(df).collect()
    parts = {}
    for r in found:
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for doc, text, _ in table:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(parts[doc, len(ids)])
        same = sum(d == doc and t == text for d, t, _ in table)  # repeated rows have pieces of their own
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in mine)
        covered = np.zeros(len(ids), int)
        for s, n, _ in mine:
            covered[s : s + n] += 1
        assert (covered == same).all()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_plan_and_fill():
    pick = random.Random(2)
    for _ in range(40):
        have = {pick.randint(1, 30): pick.randint(1, 4) for _ in range(5)}
        capacity = pick.randint(1, 60)
        sums = {0}
        for k, n in have.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        got = packing.fill(have, capacity)
        assert all(n <= have[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= capacity)
    for histogram in ({k: pick.randint(1, 5000) for k in range(1, 1025)}, {600: 10**6, 3: 5}, {1024: 7, 1: 1}, {700: 999, 900: 10**5}, {342: 10**5}, {400: 77777, 401: 3}, {513: 1}):
        patterns = packing.plan(histogram)
        have, total = dict(histogram), sum(k * n for k, n in histogram.items())
        for p in patterns:
            assert sum(k * n for k, n in p.counts.items()) + (p.cut[1] if p.cut else 0) <= 1024 and p.times > 0
            for k, n in p.counts.items():
                have[k] -= n * p.times
            if p.cut:
                length, size = p.cut
                assert 0 < size < length
                have[length] -= p.times
                have[length - size] = have.get(length - size, 0) + p.times
            assert all(n >= 0 for n in have.values())
        assert not any(have.values())
        assert sum(p.times for p in patterns) * 1024 - total < total / 128 + 2048


def test_packing_cuts_pieces_that_do_not_fit(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for words, docs in ((" the" * 606, 40), (" the" * 341, 90), (" the" * 3000, 9)):  # 607 and 342 ids, and several full pieces
        found = packing.pack(spark.createDataFrame([(i, words) for i in range(docs)], "doc_id long, text string")).collect()
        assert len({r.sequence_id for r in found}) * 1024 < sum(r.length for r in found) * 129 / 128 + 2048
        ids = np.array([*library.encode(words, add_special_tokens=False).ids, 0], "<u4")
        places = {}
        for i in range(docs):
            at = 0
            for r in sorted((r for r in found if r.doc_id == i), key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                places.setdefault(r.sequence_id, []).append((r.offset, r.length))
                at += r.length
            assert at == r.doc_tokens == len(ids)
        for parts in places.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert not bpe.bpe_round_trip(df).collect() and not counts.token_counts(df).collect() and not packing.pack(df).collect()
