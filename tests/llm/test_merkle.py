"""Merkle fingerprints against plain hashing, and against their DuckDB SQL."""

import hashlib
import random
import re

import duckdb

from candlewick.llm import merkle

CLAUSE = re.compile(r"[^.!?,;:|]*[.!?,;:|]+ ?|[^.!?,;:|]+")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute_fingerprint(text):
    nodes = [(md5("".join(leaf)), leaf) for leaf in ([md5(c) for c in CLAUSE.findall(p) if c] for p in text.split("\n"))]
    sections = [[]]
    for node in nodes:
        sections[-1].append(node)
        if node[0][0] in "01":
            sections.append([])
    sections = [s for s in sections if s]
    digests = [md5("".join(n for n, _ in s)) for s in sections]
    branches = [d[:8] + "=" + ";".join(n[:8] + ":" + ",".join(x[:8] for x in leaf) for n, leaf in s) for d, s in zip(digests, sections, strict=True)]
    leaves = {x[:8] for _, leaf in nodes for x in leaf}
    return hashlib.sha256("".join(digests).encode()).hexdigest() + "/" + "/".join(branches), leaves


def likeness(a, b):
    return 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def brute(rows):
    # null ids last, equal ids by their texts, as the docstring says
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        edit = text[: len(text) - cut] + following[:cut]
        (own, a), (other, b), (_, c) = brute_fingerprint(text), brute_fingerprint(edit), brute_fingerprint(following)
        out.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), own, other, round(likeness(a, b), 12), round(likeness(a, c), 12)))
    return sorted(map(str, out))


def found(df, buckets=None):
    return sorted(str((*tuple(r)[:5], round(r.near_edited, 12), round(r.near_next, 12))) for r in merkle.merkle_fingerprints(df, buckets).collect())


def table(seed=3, n=90):
    pick = random.Random(seed)
    parts = ["Alpha beta, gamma. ", "é! ", "漢字😀; x|y", "\n", "\n\n", "...", "plain words ", "\r\n", "k: v, "]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 60))) for _ in range(n)]
    rows = [(pick.randrange(-(10**6), 10**6), t) for t in texts] + [(10**14, None), (3, ""), (4, "one paragraph. " * 3000), (5, "line, of words.\n" * 900)]
    return rows + [(6, texts[0]), (7, texts[0])]


def test_matches_brute_force_for_any_number_of_ranges(spark):
    rows = table()
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, next_text string, _bucket int")
    for buckets in (1, 2, 30):
        assert found(df, buckets) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a. b"), (1, "a. b"), (1, "c"), (2, "d\ne"), (None, "z, y"), (9, None)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 4) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(5, "abc. def")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert merkle.merkle_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.fingerprint for r in merkle.merkle_fingerprints(df).collect()}


def located(spark, old, new, whole=False):
    """Differing leaves of two texts as (side, number of the paragraph in its text, leaf); with ``whole`` paragraphs and sections too."""
    own = prints(spark, [old, new])
    df = spark.createDataFrame([(own[0], own[1], 7, "x")], "fingerprint string, edited_fingerprint string, doc_id long, side string")
    found = merkle.differences(df).collect()
    lengths = {s: [b.count(";") + 1 for b in own[d].split("/")[1:]] for d, s in enumerate(("left", "right"))}
    assert all(r.doc_id == 7 for r in found)
    return sorted(((r.side, sum(lengths[r.side][: r.section]) + (r.paragraph or 0), r.leaf) for r in found if whole or r.leaf is not None), key=lambda at: (*at[:2], -1 if at[2] is None else at[2]))


LINES = [f"line {i}, with words." for i in range(60)]


def test_equal_texts_have_equal_roots_and_no_differences(spark):
    text = "\n".join(LINES)
    found = prints(spark, [text, text])
    assert found[0] == found[1]
    assert located(spark, text, text) == [] == located(spark, "", "")


def test_edits_are_located(spark):
    text = "\n".join(LINES)
    assert located(spark, text, text.replace("line 9,", "line nine,")) == [("left", 9, 0), ("right", 9, 0)]
    several = text.replace("line 9,", "line nine,").replace("line 40, with words", "line 40, with others")
    assert located(spark, text, several) == [("left", 9, 0), ("left", 40, 1), ("right", 9, 0), ("right", 40, 1)]
    assert located(spark, text, text + "\nand more.") == [("right", 60, 0)]
    assert [at[0] for at in located(spark, text, text + "\nand more.", whole=True)] == ["left", "right"]  # the section that grew
    assert located(spark, "", "a. b") == [("left", 0, 0), ("right", 0, 0), ("right", 0, 1)]


def test_inserted_and_removed_lines_leave_other_sections(spark):
    text = "\n".join(LINES)
    longer = "\n".join(LINES[:3] + ["a new line."] + LINES[3:])
    own = prints(spark, [text, longer])
    one, other = (p.split("/")[1:] for p in (own[0], own[1]))
    assert len(set(other) - set(one)) <= 2 < len(one) and len(set(one) - set(other)) == 1
    assert located(spark, text, longer) == [("right", 3, 0)] and located(spark, longer, text) == [("left", 3, 0)]


def test_moved_and_repeated_parts_are_located(spark):
    lines = LINES[:20]
    repeated = located(spark, "\n".join(lines), "\n".join(lines[:5] + lines[4:]))
    assert repeated in ([("right", 5, 0)], [("right", 5, 0), ("right", 5, 1)])
    assert located(spark, "one, two, three, ", "two, one, three, ", whole=True) == [("left", 0, None), ("right", 0, None)]


def test_differences_of_odd_pairs(spark):
    schema = "fingerprint string, edited_fingerprint string"
    own = prints(spark, ["a, b", "a, c"])
    df = spark.createDataFrame([(None, own[0]), (own[0], None), (own[0], own[1]), (own[0], own[1])], schema)
    assert sorted(r.side for r in merkle.differences(df).collect()) == ["left", "left", "right", "right"]
    assert merkle.differences(df.limit(0)).collect() == []


def test_matches_sql(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(table(8, 60))]  # the SQL names no order for equal ids
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    want = sorted(map(str, db.sql(merkle.ORACLE).select(*names).fetchall()))
    assert sorted(str(tuple(r)) for r in merkle.op9_merkle_fingerprint(spark, str(tmp_path)).select(*names).collect()) == want
