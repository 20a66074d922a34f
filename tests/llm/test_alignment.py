"""Alignment of two tokenizers against loops over their libraries' output."""

import hashlib
from collections import Counter, defaultdict

import pytest

from candlewick.llm import alignment
from candlewick.llm.bpe import default_path

SCHEMA = "doc_id long, text string, row string, pairs int, a_ids string, docs int"
TEXTS = [
    None,
    "",
    " ",
    "a",
    "The quick brown fox, été Straße 12345!\n\n\tmore  blanks ",
    "The quick brown fox, été Straße 12345!\n\n\tmore  blanks ",
    "a ▁ mark that only one of the two gives back",
    "<|endoftext|> and <s> are text </s> <unk> <0x41>",
    "\x00\x01 zero and 😀😀 emoji ​ ﻿",
    "hello world " * 5000,
    "x" * 20_000,
    "日本語のテキスト、とても長い。" * 40,
]


@pytest.fixture(scope="module")
def known():
    return alignment.Tokens(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))


def walked(known, text):
    """(a, b, groups, links) by one walk along both sequences; None without tokens."""
    a = known.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = known.b.encode(text) if text else []
    whole = b" " + (text or "").encode()
    if not text or b"".join(known.a_bytes[i] for i in a) != whole or b"".join(known.b_bytes[i] for i in b) != whole:
        return None
    links, groups, i, j, at_a, at_b = [], [([], [])], 0, 0, len(known.a_bytes[a[0]]), len(known.b_bytes[b[0]])
    while True:
        links.append((a[i], b[j]))
        ends_a, ends_b = at_a <= at_b, at_b <= at_a
        if ends_a:
            groups[-1][0].append(a[i])
            i += 1
        if ends_b:
            groups[-1][1].append(b[j])
            j += 1
        if ends_a and ends_b:
            if i == len(a):
                return a, b, groups, links
            groups.append(([], []))
        at_a += len(known.a_bytes[a[i]]) if ends_a else 0
        at_b += len(known.b_bytes[b[j]]) if ends_b else 0


def brute(known, texts):
    """The query's rows, without doc_id."""
    found = [walked(known, t) for t in texts]
    docs = Counter(link for f in found if f for link in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    for f in found:
        if f is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(a), len(b), len(groups), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("common", [alignment.COMMON, 20, 1])
def test_matches_a_walk_with_nulls_repeats_and_clashing_names(spark, known, common):
    rows = spark.createDataFrame([(i // 3, t, "r", 1, "a", 2) for i, t in enumerate(TEXTS)], SCHEMA)
    found = alignment.alignment(rows, common=common).drop("doc_id").collect()
    assert sorted(map(tuple, found)) == sorted(brute(known, TEXTS))


def test_groups_and_links_are_whole(spark, known):
    rows = spark.createDataFrame([(i, t, "r", 1, "a", 2) for i, t in enumerate(TEXTS)], SCHEMA)
    for r in alignment.aligned(rows).collect():
        want = walked(known, TEXTS[r.doc_id])
        assert list(r.groups) == ([",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want[2]] if want else [])
        assert [(x >> 32, x & 0xFFFFFFFF) for x in r.links] == (want[3] if want else [])


def test_an_empty_table_gives_no_rows(spark):
    assert alignment.alignment(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_a_whole_table(spark, known):
    folder = "/root/testdata/sf0.001"
    texts = dict(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
    found = {r.doc_id: tuple(r)[1:] for r in alignment.op12_alignment(spark, folder).collect()}
    assert found == dict(zip(texts, brute(known, texts.values()), strict=True))
