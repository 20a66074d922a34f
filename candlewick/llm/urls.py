"""URL filters: host and path rules, else naive Bayes over words that a unigram Viterbi finds in host and path."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import durable, slices, small_batches


class Rule(NamedTuple):
    """What to do with the pages of a host, and of all its subdomains, whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Words that make a host a first example of what to block.
SEEDS = ("adult", "ads", "bets", "casino", "farm", "pills", "porn", "spam")
#: Letters of the longest word that a name is split into.
LONGEST = 24
#: Places of a run whose pieces are made at once.
SLICE = 4096
#: Parts that a host's paths are dealt to, so that a hot host is no single group.
SALTS = 32
#: What isn't visible text: scripts and styles (one that isn't closed hides the rest of the page), tags, entities. Linear on broken pages.
HIDDEN = re.compile(r"<(script|style)\b(?:.*?</\1>|.*)|<[^<>]*>|&#?\w+;", re.S | re.I)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def runs(text: Column) -> Column:
    """The runs of lower-case letters in a host or path, repeats included."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str | None, str | None]]:
    """(url, html) of a batch, in slices of bounded size."""
    for part in slices(batch, "html"):
        yield from zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): how often each run of letters of up to LONGEST occurs in the pages' visible text and URLs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(r"[a-z]+")
        for batch in batches:
            found: Counter = Counter()
            for url, html in _rows(batch):
                found.update(words.findall(HIDDEN.sub(" ", html or "").lower()))
                found.update(words.findall((url or "").lower()))
            kept = {w: n for w, n in found.items() if len(w) <= LONGEST}
            yield pa.RecordBatch.from_pydict({"word": list(kept), "n": list(kept.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    return small_batches(pages).select("url", "html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def outside_words(pages: DataFrame) -> DataFrame:
    """(word, n, itself): runs of letters as words, known from elsewhere than the names that are to be split.

    ``n`` is how often visible text has the word, addresses and the page's own URL runs taken out, and in how many
    distinct labels of hosts and parts of paths it stands beside another run ("cheap-pills"); a run alone in its
    label ("cheappills") is no word by that. ``itself``, for the split of the same run, leaves one such label out.
    SEEDS are words in any case.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        address, words = re.compile(r"\b\w+://\S+|\bwww\.\S+"), re.compile(r"[a-z]+")
        for batch in batches:
            found: Counter = Counter()
            for url, html in _rows(batch):
                seen = words.findall(address.sub(" ", HIDDEN.sub(" ", html or "").lower()))
                found.update(seen)
                for own in set(words.findall((url or "").lower())):
                    if own in found:
                        found[own] -= seen.count(own)
            kept = {w: n for w, n in found.items() if n and len(w) <= LONGEST}
            yield pa.RecordBatch.from_pydict({"word": list(kept), "n": list(kept.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    text = small_batches(pages).select("url", "html").mapInArrow(count, "word string, n long").select("word", "n", F.lit(0).alias("labels"))
    host, path = host_and_path(F.col("url"))
    named = pages.select(host.alias("host"), path.alias("path")).distinct()
    labels = named.select(F.explode(F.concat(F.split("host", "[.]"), F.split("path", "/"))).alias("label")).distinct()
    apart = labels.select(F.array_distinct(runs(F.col("label"))).alias("found")).filter("size(found) > 1").select(F.explode("found").alias("word")).filter(F.length("word") <= LONGEST)
    seeds = pages.sparkSession.createDataFrame([(w,) for w in SEEDS], "word string").select("word", F.lit(1).cast("long").alias("n"), F.lit(0).alias("labels"))
    both = text.unionByName(apart.select("word", F.lit(0).cast("long").alias("n"), F.lit(1).alias("labels"))).unionByName(seeds)
    summed = both.groupBy("word").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"))
    return summed.select("word", (F.col("n") + F.col("labels")).alias("n"), (F.col("n") + F.greatest(F.col("labels") - 1, F.lit(0))).alias("itself"))


def viterbi(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of a run into words; a word that was never seen has 1 / (total * 10^length)."""
    best = [0.0] + [-math.inf] * len(run)
    back = [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for begin in range(max(0, end - LONGEST), end):
            n = counts.get(run[begin:end], 0)
            p = best[begin] + (math.log(n / total) if n else -math.log(total) - (end - begin) * math.log(10))
            if p > best[end]:
                best[end], back[end] = p, begin
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def _pieces(run: str) -> Iterator[set[str]]:
    """The distinct pieces of up to LONGEST letters of a run, in sets for each SLICE of places that they begin at."""
    for begin in range(0, len(run), SLICE):
        yield {run[i:j] for i in range(begin, min(begin + SLICE, len(run))) for j in range(i + 1, min(i + LONGEST, len(run)) + 1)}


def segmented(kinds: DataFrame, words: DataFrame) -> DataFrame:
    """(run, tokens) for each distinct ``run``: its pieces are looked up in the word counts by a join; the whole run has the count ``itself``, if there is one.

    Runs are numbered in a written table, and pieces carry the number alone, a bounded number of them at a time: a
    run of a million letters costs no more for each letter than a short one.
    """
    if "itself" not in words.columns:
        words = words.withColumn("itself", F.col("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    numbered = durable(small_batches(kinds).select(F.monotonically_increasing_id().alias("id"), "run"), "runs")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("word", pa.string())])
        ids: list[int] = []
        found: list[str] = []
        for batch in batches:
            for part in slices(batch, "run"):
                for number, run in zip(part.column("id").to_pylist(), part.column("run").to_pylist(), strict=True):
                    for some in _pieces(run):
                        ids += [number] * len(some)
                        found += some
                        if len(found) >= 50_000:
                            yield pa.RecordBatch.from_pydict({"id": ids, "word": found}, schema)
                            ids, found = [], []
        yield pa.RecordBatch.from_pydict({"id": ids, "word": found}, schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "run"):
                names = part.column("run").to_pylist()
                tokens = [viterbi(r, {x["word"]: x["itself" if x["word"] == r else "n"] for x in known or ()}, total) for r, known in zip(names, part.column("known").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"run": part.column("run"), "tokens": pa.array(tokens, pa.list_(pa.string()))})

    found = numbered.mapInArrow(pieces, "id long, word string").join(words, "word")
    known = found.groupBy("id").agg(F.collect_set(F.struct("word", "n", "itself")).alias("known"))
    return numbered.join(known, "id", "left").select("run", "known").mapInArrow(split, "run string, tokens array<string>")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, seeds: tuple[str, ...] = SEEDS, words: Callable[[DataFrame], DataFrame] = word_counts) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages (page_id, url, html).

    ``words`` counts the words that names are split into: with ``word_counts`` every run of up to LONGEST is one of
    its own and stays whole, with ``outside_words`` (the query's) only what stands elsewhere as a word does.

    The longest rule that fits decides. Else naive Bayes does: hosts that hold a seed word are its examples of
    what to block, all others of what to allow, every page counting; score is the log odds of block, which must
    be over 0. Null URLs, and those without ``://``, have empty host and path and are allowed unless a rule or
    the prior says otherwise; without any example to block all is allowed; repeated rows and null page_id stay;
    null html adds no words; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    sites = durable(parsed.groupBy("host", "path").agg(F.count("*").alias("n")), "sites")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"))
    # each distinct host or path, with how many pages have it
    of_host = hosts.select("host", F.lit("").alias("path"), "n", F.explode(runs(F.col("host"))).alias("run"))
    of_path = sites.select("host", "path", "n", F.explode(runs(F.col("path"))).alias("run"))
    kinds = of_host.select("run").unionByName(of_path.select("run")).distinct()
    tokens = durable(segmented(kinds, durable(words(pages.select(F.col("url").cast("string"), F.col("html").cast("string"))), "words")), "tokens")
    bad = of_host.join(tokens, "run").filter(F.arrays_overlap("tokens", F.array(*map(F.lit, seeds)))).select("host").distinct().withColumn("bad", F.lit(1))
    # pre-aggregated by run: a hot run ("com") is one row for each host's kind before tokens are joined
    salt = F.pmod(F.xxhash64("path", "run"), F.lit(SALTS)).cast("int").alias("salt")
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = of_host.select("host", "run", "n", salt).unionByName(of_path.select("host", "run", "n", salt)).join(salted, ["host", "salt"], "left")
    per_run = seen.groupBy("run").agg(F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("bad").isNull(), F.col("n")).otherwise(0)).alias("allow"))
    per_token = per_run.join(tokens, "run").select(F.explode("tokens").alias("token"), "block", "allow").groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    per_token = durable(per_token, "token-counts")
    kinds_n, block_n, allow_n = (x or 0 for x in per_token.agg(F.count("*"), F.sum("block"), F.sum("allow")).first())
    block_pages, all_pages = (x or 0 for x in hosts.join(bad, "host", "left").agg(F.sum(F.when(F.col("bad").isNotNull(), F.col("n"))), F.sum("n")).first())
    if not block_pages or block_pages == all_pages:
        return parsed.select("page_id", "host", "path", *(c.alias(n) for c, n in zip(_decided(rules, F.lit(-1.0)), ("rule", "verdict", "score"), strict=True)))
    prior = math.log(block_pages / (all_pages - block_pages))
    weight = F.log((F.col("block") + 1) / (block_n + kinds_n)) - F.log((F.col("allow") + 1) / (allow_n + kinds_n))
    weights = tokens.select("run", F.explode("tokens").alias("token")).join(per_token.select("token", weight.alias("w")), "token").groupBy("run").agg(F.sum("w").alias("w"))
    host_score = of_host.join(weights, "run").groupBy("host").agg(F.sum("w").alias("host_w"))
    path_score = sites.select("path").distinct().select("path", F.explode(runs(F.col("path"))).alias("run")).join(weights, "run").groupBy("path").agg(F.sum("w").alias("path_w"))
    scored = parsed.join(host_score, "host", "left").join(path_score, "path", "left")
    score = F.lit(prior) + F.coalesce("host_w", F.lit(0.0)) + F.coalesce("path_w", F.lit(0.0))
    return scored.select("page_id", "host", "path", *(c.alias(n) for c, n in zip(_decided(rules, score), ("rule", "verdict", "score"), strict=True)))


def _decided(rules: tuple[Rule, ...], score: Column) -> tuple[Column, Column, Column]:
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    # rounded: sums of weights may differ in their last digits by the order of rows
    return rule, F.coalesce(verdict, F.when(F.round(score, 9) > 0, "block").otherwise("allow")), F.round(score, 9)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), words=outside_words)
