"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import documents, texts

#: A leaf: a clause with the marks and the blank that end it, or what is left of the paragraph.
LEAF = r"[^.!?,;:|]*[.!?,;:|]+ ?|[^.!?,;:|]+"
#: A section ends with a paragraph (line) whose digest begins with one of these: one in eight, wherever lines are put in or taken out.
ENDS = ("0", "1")


def leaves(text: Column) -> Column:
    """Digests of the leaves, an array for each paragraph; the leaves of a paragraph concatenate to it."""
    clauses = lambda p: F.regexp_extract_all(p, F.lit(LEAF), F.lit(0))
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(clauses(p), lambda c: F.md5(c.cast("binary"))))


def paragraphs(tree: Column) -> Column:
    """Each paragraph's digest, of its leaves' digests, and the leaves in short: ``digest:leaf,leaf``."""
    short = lambda d: F.substring(d, 1, 8)
    return F.transform(tree, lambda p: F.concat(F.md5(F.array_join(p, "").cast("binary")), F.lit(":"), F.array_join(F.transform(p, short), ",")))


def section_ends(nodes: Column) -> Column:
    """Places (from 1) of the paragraphs that end a section; the last one does in any case."""
    return F.filter(F.sequence(F.lit(1), F.size(nodes)), lambda i: (i == F.size(nodes)) | F.substring(F.element_at(nodes, i), 1, 1).isin(*ENDS))


def fingerprint(nodes: Column, ends: Column) -> Column:
    """``root/section=paragraph:leaf,leaf;paragraph:.../section=...`` from the paragraphs' nodes and section_ends.

    The root (SHA-256 of the sections' digests) tests equality; a section's digest is MD5 of its paragraphs'.
    Where roots differ, differing sections, then paragraphs, then leaves locate the edit; see ``differences``.
    Sections are cut by content, so that a line put in changes its own section and leaves the others as they are.
    """
    begins = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    sections = F.zip_with(begins, ends, lambda before, end: F.slice(nodes, before + 1, end - before))
    digest = lambda s: F.md5(F.array_join(F.transform(s, lambda n: F.substring(n, 1, 32)), "").cast("binary"))
    brief = lambda s: F.array_join(F.transform(s, lambda n: F.concat(F.substring(n, 1, 8), F.substring(n, 33, 2**30))), ";")
    root = F.sha2(F.array_join(F.transform(sections, digest), "").cast("binary"), 256)
    branches = F.array_join(F.transform(sections, lambda s: F.concat(F.substring(digest(s), 1, 8), F.lit("="), brief(s))), "/")
    return F.concat(root, F.lit("/"), branches)


def _surplus(rows: DataFrame, place: list[str]) -> DataFrame:
    """Of the nodes (left_root, right_root, side, *place, digest, below), those that one side has oftener than the other, the last ones."""
    at = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct(*place)))).alias(s)
    beyond = lambda s, own, other: F.transform(F.slice(own, F.size(other) + 1, F.lit(2**30)), lambda x: F.struct(F.lit(s).alias("side"), *(x[p].alias(p) for p in place)))
    grouped = rows.groupBy("left_root", "right_root", "digest").agg(F.first("below").alias("below"), at("left"), at("right"))
    both = F.concat(beyond("left", F.col("left"), F.col("right")), beyond("right", F.col("right"), F.col("left")))
    return grouped.select("left_root", "right_root", "below", F.explode(both).alias("at")).select("left_root", "right_root", "at.*", "below")


def differences(pairs: DataFrame, left: str = "fingerprint", right: str = "edited_fingerprint") -> DataFrame:
    """Locate the edits between two fingerprints: (side, section, paragraph, leaf), numbers from 0, for each differing leaf.

    ``section`` counts in the document, ``paragraph`` in its section, ``leaf`` in its paragraph; ``side`` is left or
    right. Roots are compared first: pairs of equal texts give no rows, and only what lies below differing sections
    and paragraphs is looked at. A part differs if one side has it oftener than the other; the last ones are listed.
    Where all parts of a differing section or paragraph stand on the other side too (which has more, or another
    order), leaf (and paragraph) are null; sections that were only moved whole give no rows. An empty line that differs is leaf 0. A null fingerprint gives no rows;
    repeated pairs stay, each with its rows; the other columns of ``pairs`` are kept, but those named like the
    four give way.
    """
    key = ["left_root", "right_root"]
    kept = [F.col(f"`{c}`") for c in pairs.columns if c not in ("side", "section", "paragraph", "leaf")]
    prints = [F.col(f"`{c}`").cast("string") for c in (left, right)]
    roots = [F.substring(p, 1, 64).alias(k) for p, k in zip(prints, key, strict=True)]
    rows = pairs.select(F.struct(*kept).alias("kept"), *roots, *(p.alias(s) for p, s in zip(prints, ("left", "right"), strict=True))).filter("left_root <> right_root")
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("print")) for s in ("left", "right"))))
    of_pair = rows.groupBy(*key).agg(F.first("left").alias("left"), F.first("right").alias("right")).select(*key, sides.alias("of")).select(*key, "of.*")

    def below(nodes: DataFrame, parts: Column, place: list[str]) -> DataFrame:
        opened = nodes.select(*key, "side", *place[:-1], F.posexplode(parts).alias(place[-1], "node"))
        return _surplus(opened.select(*key, "side", *place, F.substring("node", 1, 8).alias("digest"), F.substring("node", 10, 2**30).alias("below")), place)

    sections = below(of_pair, F.slice(F.split("print", "/"), 2, 2**30), ["section"])
    paragraphs = below(sections, F.split("below", ";"), ["section", "paragraph"])
    leaves_ = below(paragraphs, F.split("below", ","), ["section", "paragraph", "leaf"])
    found = sections.drop("below").join(paragraphs.drop("below"), [*key, "side", "section"], "left")
    found = found.join(leaves_.drop("below"), [*key, "side", "section", "paragraph"], "left")
    return rows.select("kept", *key).join(found, key).select("kept.*", "side", "section", "paragraph", "leaf")


def leaf_set(tree: Column) -> Column:
    """The distinct leaves of a document, in short, as the fingerprint holds them."""
    return F.array_distinct(F.transform(F.flatten(tree), lambda d: F.substring(d, 1, 8)))


def likeness(a: Column, b: Column) -> Column:
    """Dice likeness of two leaf sets: twice the shared ones over the sum of both; 1 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(df: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """Add ``next_<column>`` from the next row in descending ``key`` order (after the last: the first).

    Keys are cut into ``buckets`` ranges of like size by quantiles of the key column alone. Each range also gets
    a copy of the first row of the range that follows, so that a window within a range finds every next row and
    no task sees the whole table. Equal keys follow in the order of ``columns``; null keys come last.
    """
    spark = df.sparkSession
    side = max(1, int(buckets**0.5))
    cuts = sorted({int(x) for x in df.approxQuantile(key, [i / (side * side) for i in range(1, side * side)], 0.2 / (side * side))} if side > 1 else ())
    coarse = [part[-1] for part in (cuts[i : i + side] for i in range(0, len(cuts), side))][:-1]
    fine = [cuts[i : i + side] for i in range(0, len(cuts), side)] or [[]]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col(key)))
    part = below(longs(coarse)) if coarse else F.lit(0)
    place = part * (side + 1) + below(F.element_at(F.array(*map(longs, fine)), part + 1))
    df = df.withColumn("_bucket", F.coalesce(F.when(F.col(key).isNotNull(), place), F.lit(-1)))
    # at most side * side + 1 rows: the largest key of each range, in descending order
    tops = [r.asDict() for r in df.groupBy("_bucket").agg(F.max(key).alias("top")).orderBy(F.desc("_bucket")).collect()]
    if not tops:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in columns)).drop("_bucket")
    also = [(tops[(i + 1) % len(tops)]["_bucket"], tops[i]["_bucket"], tops[(i + 1) % len(tops)]["top"]) for i in range(len(tops))]
    lent = spark.createDataFrame(also, "_bucket int, _to int, _top long")
    marked = df.join(F.broadcast(lent), "_bucket", "left").withColumn("_lent", F.col(key).eqNullSafe(F.col("_top")))
    spread = marked.withColumn("_at", F.explode(F.when(F.col("_lent"), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy"))))))
    order = Window.partitionBy("_at.b").orderBy("_at.copy", F.col(key).desc_nulls_last(), *columns)
    out = spread.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter("_at.copy = 0")
    return out.drop("_bucket", "_to", "_top", "_lent", "_at")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by as many (or all) first ones of ``following``."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def merkle_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint each document and its edited text, and compare both with each other and with the next document.

    Null text counts as empty, an empty text has one empty paragraph; rows with equal doc_id follow each other
    in the order of their texts and all stay; null doc_id is last; an empty table gives no rows; other columns
    are ignored. A table of one row is its own next document.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    base = with_next(base, "doc_id", ["text"], buckets)
    own = base.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edit"), leaves(F.col("text")).alias("tree"), F.col("next_text"))
    own = own.select("doc_id", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "tree", leaves(F.col("edit")).alias("edit_tree"), leaves(F.col("next_text")).alias("next_tree"))
    trees = {"a": "tree", "b": "edit_tree", "c": "next_tree"}
    own = own.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        paragraphs(F.col("tree")).alias("nodes"),
        paragraphs(F.col("edit_tree")).alias("edit_nodes"),
        *(leaf_set(F.col(tree)).alias(name) for name, tree in trees.items()),
    )
    own = own.select("*", section_ends(F.col("nodes")).alias("ends"), section_ends(F.col("edit_nodes")).alias("edit_ends"))
    return own.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("nodes"), F.col("ends")).alias("fingerprint"),
        fingerprint(F.col("edit_nodes"), F.col("edit_ends")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op9_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's Merkle fingerprints; see merkle_fingerprints."""
    return merkle_fingerprints(documents(spark, sf_dir))


_NODES = r"""list_transform(string_split({0}, chr(10)), lambda p: list_transform(list_filter(regexp_extract_all(p, '[^.!?,;:|]*[.!?,;:|]+ ?|[^.!?,;:|]+'), lambda x: x <> ''), lambda c: md5(c)))"""
_FINGERPRINT = """sha256(array_to_string(list_transform({0}, lambda s: s.d), '')) || '/' || array_to_string(list_transform({0}, lambda s: left(s.d, 8) || '=' || s.t), '/')"""
_ENDS = """list_filter(generate_series(1, len({0})), lambda i: i = len({0}) OR left({0}[i], 1) IN ('0', '1'))"""
_CUT = "{0}[CASE WHEN k = 1 THEN 1 ELSE {1}[k - 1] + 1 END:{1}[k]]"
_SECTIONS = """list_transform(generate_series(1, len({1})), lambda k: struct_pack(
    d := md5(array_to_string(list_transform({2}, lambda n: n[1:32]), '')),
    t := array_to_string(list_transform({2}, lambda n: left(n, 8) || n[33:]), ';')))"""
_PARAGRAPHS = """list_transform({0}, lambda p: md5(array_to_string(p, '')) || ':' || array_to_string(list_transform(p, lambda d: left(d, 8)), ','))"""
_LEAVES = "list_distinct(list_transform(flatten({0}), lambda d: left(d, 8)))"
_LIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM t WINDOW w AS (ORDER BY doc_id DESC, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(nxt, length(text) // 3) AS edit FROM n),
l AS (SELECT *, {_NODES.format("text")} AS lt, {_NODES.format("edit")} AS le, {_NODES.format("nxt")} AS ln FROM e),
p AS (SELECT *, {_PARAGRAPHS.format("lt")} AS pt, {_PARAGRAPHS.format("le")} AS pe, {_LEAVES.format("lt")} AS a, {_LEAVES.format("le")} AS b, {_LEAVES.format("ln")} AS c FROM l),
c AS (SELECT *, {_ENDS.format("pt")} AS ct, {_ENDS.format("pe")} AS ce FROM p),
s AS (SELECT *, {_SECTIONS.format("pt", "ct", _CUT.format("pt", "ct"))} AS st, {_SECTIONS.format("pe", "ce", _CUT.format("pe", "ce"))} AS se FROM c)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edit) AS edited_sha256, {_FINGERPRINT.format("st")} AS fingerprint, {_FINGERPRINT.format("se")} AS edited_fingerprint, {_LIKE.format("a", "b")} AS near_edited, {_LIKE.format("a", "c")} AS near_next FROM s
"""
