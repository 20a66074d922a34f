"""The audit against plain counting."""

import re
from collections import Counter, defaultdict

import duckdb

from candlewick.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, part string, n long"


def brute(rows, least, top):
    """The same numbers by plain loops."""
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(divergence.TERM, text.translate(str.maketrans(divergence.UPPER, divergence.LOWER)))
        counts[lang, source].update(words)
        having[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in having[lang].items() if n >= least)
        v = len(kept)

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // (p[s][t] + whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def table(spark, texts):
    return [(i, text, lang, source, "x", "y", 7) for i, (text, lang, source) in enumerate(texts)]


def test_matches_plain_loops_with_nulls_ties_and_clashing_names(spark):
    rows = table(
        spark,
        [(f"the Cat {'sat' * (i % 3)} été Ünd ÜND and{i % 4} 12the\x00x 😀", "en", f"s{i % 4}") for i in range(40)]
        + [("the the and cat", "en", None), (None, "en", "null text"), ("", "fr", "a"), (None, None, None), ("le la", "fr", "b"), ("le", "fr", "c")]
        + [("ein wort " * 2000, "de", "big")] * 11 + [("wort", "de", "small"), ("...", "de", "no terms")],
    )
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), least=10, top=3).collect()
    assert sorted(map(tuple, found)) == brute(rows, 10, 3)


def test_languages_that_keep_no_term_have_pairs_of_zero(spark):
    rows = table(spark, [("one", "en", "b"), ("two", "en", "a"), ("three", "en", "c")])
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in found) == [("a", "b", 0, 1), ("a", "c", 0, 2), ("b", "a", 0, 1), ("b", "c", 0, 2), ("c", "a", 0, 1), ("c", "b", 0, 2)]
    assert {r.part for r in found} == {"pair"}


def test_an_empty_table_gives_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(db.sql(f"SELECT {', '.join(names)} FROM ({divergence.ORACLE})").fetchall())
    assert sorted(map(tuple, divergence.op11_divergence(spark, folder).select(*names).collect())) == want
