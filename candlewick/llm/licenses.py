"""License scans by ordered signature rules: a keyword gate, patterns on words, and suppression of contained finds.

Column functions alone: no Python, no shuffle; a document's finds stay in its row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import LOWER, UPPER, documents, let
from candlewick.llm.license_rules import RULES, Rule

#: Digits, letters, and whatever isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How sure a find of each level is.
WEIGHTS = (1.0, 1.0, 0.8, 0.5)
_FOUND = "array<struct<start:int,back:int,level:int,rule:int,label:string>>"


def spaced(pattern: str) -> str:
    """A rule's pattern for text in which each word has a blank of its own before and after it.

    So neighbouring finds share no blank, and a find begins and ends with whole words.
    """
    return " " + pattern.replace(" ?", "(?: )?").replace(" ", "  ") + " "


def _rules(rules: Sequence[Rule]) -> Column:
    """The rules as one literal: (rule, label, level, gate, pattern), in order."""
    rows = [{"rule": i, "label": r.label, "level": r.level, "gate": list(r.gate), "pattern": spaced(r.pattern)} for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule:int,label:string,level:int,gate:array<string>,pattern:string>>")


def _places(text: Column, rule: Column) -> Column:
    """Where a rule matches: (start, -end, level, rule, label), in words from 0, the end not included.

    Each match is put between two marks. The k-th opening mark stands after 2k others, its closing mark after 2k + 1;
    words alone are counted, whatever their number.
    """
    marked = F.regexp_replace(text, rule["pattern"], F.lit(" \x01$0\x02 "))
    at = lambda words, mark: F.filter(F.transform(words, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())
    found = lambda words: F.zip_with(F.transform(at(words, "\x01"), lambda i, k: i - 2 * k), F.transform(at(words, "\x02"), lambda i, k: i - 2 * k - 1), lambda a, b: F.struct(a.alias("start"), (-b).alias("back"), rule["level"].alias("level"), rule["rule"].alias("rule"), rule["label"].alias("label")))
    return let(F.split(F.trim(marked), " +"), found)


def _furthest(ends: Column) -> Column:
    """The greatest of each value and all before it, by doubling steps: n log n, however many finds there are."""
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda s: s < F.size(ends))
    wider = lambda acc, s: F.transform(acc, lambda x, i: F.greatest(x, F.get(acc, i - s)))
    return F.aggregate(steps, ends, wider)


def kept(found: Column) -> Column:
    """The finds that no other one of the same or a better level contains; of equal ones the first by level and rule stays.

    In order of start and, among equals, falling end, what contains a find stands before it: it goes if one before it,
    of its level or better, ends no earlier.
    """

    def reach(s: Column, level: int) -> Column:
        return _furthest(F.transform(s, lambda d: F.when(d["level"] <= level, -d["back"]).otherwise(-1)))

    def without(s: Column) -> Column:
        stands = lambda r, d, i: (d["level"] == 0) | (i == 0) | (F.get(F.get(r, d["level"] - 1), i - 1) < -d["back"])
        open_ = lambda r: F.filter(F.transform(s, lambda d, i: F.when(stands(r, d, i), d)), lambda d: d.isNotNull())
        return let(F.array(*(reach(s, level) for level in range(1, len(WEIGHTS)))), open_)

    return F.when(F.size(found) < 2, found).otherwise(let(F.array_sort(found), without))


def detect(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """(doc_id, n_words, found, detections) for each row of documents.

    ``found`` has every match of every rule, ``detections`` those that stand: (start, back, level, rule, label) with
    the first word, minus the word after the last, and the rule's level, number and label. Rules of level 0 always
    stand. A rule is tried where all words of its gate are; its matches don't overlap each other. Null text counts as
    empty, without words or finds; texts are read whole; repeated rows and null doc_id stay; an empty table gives no rows;
    other columns are ignored.
    """
    gate = sorted({g for r in rules for g in r.gate})
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    rows = rows.withColumn("there", F.array_intersect("words", F.array(*map(F.lit, gate))))
    tried = F.filter(_rules(rules), lambda r: F.forall(r["gate"], lambda g: F.array_contains("there", g)))
    spread = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))

    def places(candidates: Column) -> Column:
        on = lambda t: F.flatten(F.transform(F.filter(candidates, lambda r: F.regexp_like(t, r["pattern"])), lambda r: _places(t, r)))
        return F.when(F.size(candidates) > 0, let(spread, on)).otherwise(F.array().cast(_FOUND))

    found = F.when(F.size("there") > 0, let(tried, places)).otherwise(F.array().cast(_FOUND))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))
    return rows.select("*", kept(F.col("found")).alias("detections"))


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, label, rule, level, first_word, last_word), a row for each detection of ``detect``."""
    rows = found.select("doc_id", F.explode("detections").alias("d"))
    return rows.select("doc_id", "d.label", "d.rule", "d.level", F.col("d.start").alias("first_word"), (-F.col("d.back") - 1).alias("last_word"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of documents.

    The base phrases are the rules of level 0: all their places count, first_word and last_word are the smallest and
    largest start. ``labels`` has theirs and those of all detections; the score is the surest detection's weight.
    See ``detect`` for nulls, empty and long texts, repeated rows and clashing names.
    """
    rows = detect(docs, rules, text).withColumn("base", F.filter("found", lambda d: d["level"] == 0))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    best = F.array_min(F.transform("detections", lambda d: d["level"]))
    score = F.coalesce(F.get(F.array(*map(F.lit, WEIGHTS)), best), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("detections").alias("labels"), score.alias("score"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by the rules of this folder."""
    return scan(documents(spark, sf_dir))


def _oracle(rules: Sequence[Rule] = RULES) -> str:
    """The same in DuckDB: every rule against every document that has its gate, containment by a join within documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {quoted(r.label)}, {r.level}, [{', '.join(map(quoted, r.gate))}], {quoted(spaced(r.pattern))})" for i, r in enumerate(rules))
    weights = " ".join(f"WHEN {level} THEN {w}::DOUBLE" for level, w in enumerate(WEIGHTS))
    return rf"""WITH r(rule, label, level, gate, pattern) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
t AS (SELECT i, doc_id, len(w)::BIGINT AS n, list_distinct(w) AS u, ' ' || array_to_string(w, '  ') || ' ' AS text FROM d),
m AS (SELECT i, rule, label, level, string_split_regex(trim(regexp_replace(text, pattern, ' {chr(1)}\0{chr(2)} ', 'g')), ' +') AS w FROM t JOIN r ON list_has_all(u, gate) WHERE regexp_matches(text, pattern)),
p AS (SELECT i, rule, label, level, unnest(w) AS x, unnest(range(len(w))) AS pos FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY i, rule, x ORDER BY pos) - 1 AS k FROM p WHERE x IN ('{chr(1)}', '{chr(2)}')),
f AS (SELECT a.i, a.rule, a.label, a.level, a.pos - 2 * a.k AS s, b.pos - 2 * b.k - 1 AS e FROM o a JOIN o b ON a.i = b.i AND a.rule = b.rule AND a.k = b.k WHERE a.x = '{chr(1)}' AND b.x = '{chr(2)}'),
k AS (SELECT * FROM f a WHERE level = 0 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.i = a.i AND b.level <= a.level AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e OR b.level < a.level OR b.rule < a.rule))),
base AS (SELECT i, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f WHERE level = 0 GROUP BY i),
every AS (SELECT i, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CASE min(level) {weights} END AS score FROM k GROUP BY i)
SELECT doc_id, t.n AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM t LEFT JOIN base USING (i) LEFT JOIN every USING (i)"""


ORACLE = _oracle()
