"""Language ID: vectors against plain loops, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from candlewick.llm import langid


def test_bundles_are_sums_of_bound_letters():
    texts = ["Ab  c!", "", "éa\0b", "x" * 50, "12 3"]
    owner, key, grams = langid.trigrams(texts)
    got = langid.bundles(owner, key, grams, len(texts))
    for i, plain in enumerate([" ab c ", " ", " éa b ", " " + "x" * 50 + " ", " "]):
        want = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            want += np.roll(langid.letter(ord(a)), 2).astype(int) * np.roll(langid.letter(ord(b)), 1) * langid.letter(ord(c))
        assert (got[i] == want).all()


def test_many_letters():
    texts = ["".join(chr(0x4E00 + i) for i in range(3000)), "abc"]
    owner, key, grams = langid.trigrams(texts)
    assert len(grams) == 3003 and langid.bundles(owner, key, grams, 2).shape == (2, langid.DIMENSIONS)


def test_held_out_accuracy_and_odd_rows(spark):
    pick = random.Random(4)
    kinds = {"aa": "aeiou rst", "bb": "bcdfgh aei", "cc": "öüß mnop"}
    rows = []
    for i in range(400):
        lang = pick.choice(list(kinds))
        rows.append((i, "".join(pick.choices(kinds[lang], k=pick.randint(20, 200))), lang, 0.5))
    rows += [(1001, None, "aa", 1.0), (1002, "", "bb", 1.0), (1003, "12 !?", "cc", 1.0), (1004, rows[0][1], None, 1.0), (None, rows[1][1], "zz", 1.0), (5, rows[5][1], rows[5][2], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = langid.identify(df).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {*kinds, "und"}
    out = [r for r in found if r.held_out and r.doc_id < 1000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out) > 50
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1001, 1002, 1003}
    other = langid.identify(df.selectExpr("doc_id", "text", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 'aa' ELSE lang END AS lang"))
    assert sorted(map(str, other.collect())) == sorted(map(str, found))  # held-out labels are not looked at
    assert langid.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")).collect()} == {"und"}


def test_default_floor_rejects_unseen_scripts_and_random_letters(spark):
    pick = random.Random(8)
    kinds = {"en": "the of and tion ing er at on".split(), "fr": "le la eau ment ère çan ou".split()}
    made = lambda lang, n: " ".join("".join(pick.choices(kinds[lang], k=pick.randint(1, 3))) for _ in range(n))
    good = [(i, made(lang, pick.choice([6, 40, 120])), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    odd, ranges = [], {"cyrillic": (0x430, 0x450), "greek": (0x3B1, 0x3CA), "han": (0x4E00, 0x5E00), "arabic": (0x627, 0x64B), "latin": (97, 123)}
    for begin, end in ranges.values():
        odd += [" ".join("".join(chr(pick.randrange(begin, end)) for _ in range(pick.randint(2, 9))) for _ in range(120)) for _ in range(20)]
    docs = spark.createDataFrame(good + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    assert sorted(r.row.doc_id for r in langid.known(docs).collect()) == list(range(120))
