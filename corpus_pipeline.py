"""The corpus pipeline: quality, language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of ``docs``, whatever their names: operators hold a row in a struct. Texts are taken whole, rows with equal
doc_id are rows of their own, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import jaccard, langid, packing, quality, substring
from candlewick.llm.common import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; its labels are the labels table, its sites the documents given.

    Null and empty texts go; null lang or source is a site of its own; of equal rows all stay or all go.
    """
    found = quality.posterior(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"), written=False)
    return found.filter("keep").select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: texts without a letter (null and empty too), and those unlike any profile, go.

    A score at the floor stays; between two languages with equal scores it makes no difference here.
    """
    return langid.known(docs).select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null, empty and blank texts are one group, as all texts without a word are alike.
    """
    return jaccard.representatives(docs).select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id has; those of which nothing is left go.

    Texts without words (null too) stay as they are; rows with one doc_id, and a null doc_id, take nothing from each other.
    """
    found = substring.substring_dedup(docs).filter("n_words = 0 OR n_removed < n_words")
    others = [f"row.`{c}`" for c in docs.columns if c not in ("text", "n_chars")]
    size = [f"CAST(length(text) AS {docs.schema['n_chars'].dataType.simpleString()}) AS n_chars"] if "n_chars" in docs.columns else []
    return found.selectExpr(*others, "text", *size).select(*(f"`{c}`" for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_each_group),
    ("passages", drop_repeated_passages),
    ("packing", packed),
]

#: No SQL expresses the classifier, the profiles or the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
