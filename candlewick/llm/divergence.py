"""Source divergence audit: how far each source's words are from those of its language and of the other sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import LOWER, UPPER, documents, dropped, durable

#: Letters, and whatever isn't ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a term must be in; ranks of a group's own terms.
LEAST, TOP = 10, 10


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and how many of its documents have it.

    Texts are split at what no term holds, which leaves the matches of TERM at less cost. A document's terms are sorted,
    and each is exploded with the one before it, so that the first of equal ones counts the document: no shuffle by document.
    """
    text = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    rows = docs.select("lang", "source", F.sort_array(F.split(text, BETWEEN)).alias("terms"))
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.array_prepend("terms", F.lit(None)).alias("before"))
    # the outer form, as the inner one would evaluate the split again to skip empty arrays
    rows = rows.select("lang", "source", F.inline_outer(pairs)).toDF("lang", "source", "term", "before").filter("term <> ''")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """One billionth parts of a smoothed share, from 1: exact, whatever the counts."""
    parts = (n + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", parts, (total + 2 * kept).cast("decimal(20,0)")) + 1).otherwise(F.lit(0).cast("long"))


def _distance(p: Column, q: Column) -> Column:
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0).cast("long"))


def shares(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, p, q) for every group and each term that its language keeps, zeros included.

    p is the group's share of the term, q the language's. A language that keeps no term has the empty term, once for
    each group, with n, p and q of 0. Groups are all that occur, even without terms.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = durable(term_counts(rows), "divergence-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = durable(of_lang.filter(F.col("docs") >= least).drop("docs"), "divergence-kept")
    own = durable(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "divergence-own")
    # one row for each group: the totals that shares need
    groups = rows.select("lang", "source").distinct()
    of_group = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    sizes = groups.join(of_group, ["lang", "source"], "left").join(totals, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    sizes = durable(sizes, "divergence-groups")
    empty = sizes.filter("kept = 0").select("lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("lang_n")).distinct()
    # groups are copied to each part of the vocabulary, so that a language is crossed in many tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = kept.select("lang", "term", "lang_n").unionByName(empty).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    copies = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    dense = vocabulary.join(copies, ["lang", "part"]).join(own, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    p = _share(F.col("n"), F.col("total"), F.col("kept"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    found = durable(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "divergence-shares")
    dropped(counts, kept, own, sizes)
    return found


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each (lang, source) group is from the others of its language.

    Part ``pair`` has each other source of the language with the sum of the terms' distances (0 where no term is
    kept); part ``term`` the group's own ``top`` terms whose share exceeds the language's. Nulls count as empty text,
    language or source; texts are counted whole; repeated rows are documents of their own; ties go by the item in
    UTF-8 order; an empty table gives no rows; other columns are ignored. A pair is computed once and given both ways.
    """
    dense = shares(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    a = dense.select("lang", "term", "source", "p")
    b = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    met = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    sums = met.groupBy("lang", "source", "item").agg(F.sum(_distance(F.col("p"), F.col("other"))).alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.*", "value").withColumn("rank", F.row_number().over(order))
    above = dense.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    own = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).unionByName(own.select(*columns("term")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(documents(spark, sf_dir))


ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST}),
t AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY lang, source),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * t.v))::BIGINT AS p,
  (1 + 1000000000::HUGEINT * (k.n + 2) // (t.n + 2 * t.v))::BIGINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN t ON g.lang = t.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM x WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= {TOP}"""
