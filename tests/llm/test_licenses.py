"""License scans against plain regular expressions."""

import re

import duckdb
import pytest

from candlewick.llm import licenses
from candlewick.llm.license_rules import RULES, Rule

SCHEMA = "doc_id long, text string, words string, found int, there string"
LOW = str.maketrans(licenses.UPPER, licenses.LOWER)


def brute(text, rules=RULES):
    """(n_words, base starts, labels, detections) by loops over words and rules."""
    words = re.findall(licenses.WORD, (text or "").translate(LOW))
    spread = " " + "  ".join(words) + " "
    found = []
    for number, rule in enumerate(rules):
        if set(rule.gate) <= set(words):
            for m in re.finditer(licenses.spaced(rule.pattern), spread):
                start = len(spread[: m.start()].split())
                found.append((start, start + len(m.group().split()), rule.level, number))
    better = lambda a, b: a[2] <= b[2] and a[0] <= b[0] and a[1] >= b[1] and (a[:2] != b[:2] or (a[2], a[3]) < (b[2], b[3]))
    kept = [d for d in found if d[2] == 0 or not any(better(a, d) for a in found if a is not d)]
    return len(words), sorted(d[0] for d in found if d[2] == 0), sorted({rules[d[3]].label for d in kept}), sorted(kept)


TEXTS = [
    None,
    "",
    "...",
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU General Public License; GPL-3.0-or-later, gpl v2 or later; LGPL 2.1 and AGPLv3",
    "Licensed under CC BY-NC 4.0. and cc-by-nc-sa 3.0, CC-BY, creativecommons.org/licenses/by-nc/4.0",
    "mit der license ist es so, under the MIT license under the mit license",
    "cc by nc " * 3000,
    "Ünder the MIT License, under the mit licenseé",
    "new bsd license and a BSD license; 3-clause BSD license",
    "Dual: MPL 2.0 / EPL 2.0 / all rights reserved; non-commercial use only, for noncommercial use only",
]


def test_matches_loops_with_nulls_long_texts_and_clashing_names(spark):
    rows = spark.createDataFrame([(i // 2, t, "w", 1, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    for r, text in zip(licenses.scan(rows.repartition(1).orderBy("doc_id")).collect(), TEXTS, strict=True):
        n, base, labels, kept = brute(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), base[0] if base else None, base[-1] if base else None)
        assert r.labels == ",".join(labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(labels)
        assert r.score == (licenses.WEIGHTS[min(d[2] for d in kept)] if kept else 0.0)
    assert licenses.scan(rows.limit(0)).collect() == []


def test_spans_are_those_of_the_loops(spark):
    rows = spark.createDataFrame([(i, t, "w", 1, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    found = sorted((r.doc_id, r.first_word, r.last_word + 1, r.level, r.rule) for r in licenses.spans(licenses.detect(rows)).collect())
    assert found == sorted((i, *d) for i, t in enumerate(TEXTS) for d in brute(t)[3])


def test_containment_keeps_better_and_longer_finds(spark):
    rules = (Rule("base", 0, ("b",), "b c"), Rule("long", 2, ("a",), "a b c d"), Rule("tag", 1, ("b",), "b c d"), Rule("weak", 3, ("c",), "c"), Rule("same", 2, ("a",), "a b(?: c d)?"))
    rows = spark.createDataFrame([(1, "a b c d " * 50 + "c")], "doc_id long, text string")
    found = sorted((r.first_word, r.last_word, r.label) for r in licenses.spans(licenses.detect(rows, rules)).collect())
    want = [x for k in range(0, 200, 4) for x in ((k, k + 3, "long"), (k + 1, k + 2, "base"), (k + 1, k + 3, "tag"))]
    assert found == sorted([*want, (200, 200, "weak")])


def variants(pattern):
    """All that a pattern matches, with a range's ends and one word for each gap."""
    if m := re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", pattern):
        options = [*m[1].split("|"), *([""] if m[2] == "?" else [])]
    elif m := re.search(r"\[(.+?)\]", pattern):
        options = m[1].replace("-", "")
    elif m := re.search(r"(.)\?", pattern):
        options = [m[1], ""]
    else:
        return {pattern}
    return {v for o in options for v in variants(pattern[: m.start()] + o + pattern[m.end() :])}


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.pattern[:40])
def test_gates_hold_for_whatever_a_pattern_matches(rule):
    for text in variants(rule.pattern):
        assert set(rule.gate) <= set(text.split()), text


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = db.sql(f"SELECT {', '.join(names)} FROM ({licenses.ORACLE}) ORDER BY doc_id").fetchall()
    assert list(map(tuple, licenses.op13_licenses(spark, folder).select(*names).orderBy("doc_id").collect())) == want
    assert any(r[5] for r in want)


def test_no_python_in_the_plan(spark):
    plan = licenses.op13_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
