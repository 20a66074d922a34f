"""The pipeline's stages, one by one, against what their operators must keep."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from candlewick.llm import langid, simhash


def corpus(spark, folder):
    pick = random.Random(12)
    kinds = {"en": "the of and tion ing er".split(), "fr": "le la eau ment ère çan".split()}
    rows, labels = [], []
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(240):
        lang = "en" if i % 3 else "fr"
        words = ["".join(pick.choices(kinds[lang], k=pick.randint(1, 4))) for _ in range(pick.randint(30, 90))]
        good = i % 5 != 0
        text = " ".join(words) if good else " ".join(w.upper() + "$$$ !!" for w in words)
        if i % 20 == 7:
            text += "\n" + passage
        rows.append([i, text, lang, "hot" if i % 3 == 0 else f"s{i % 7}", len(text)])
        if i % 2:
            labels.append((i, int(good), 0))
    for i in range(240, 270):
        rows.append([i, rows[i - 240][1], *rows[i - 240][2:]])  # exact copies
    rows += [[270, None, None, None, None], [271, "", "en", "hot", 0], [272, "12 34 " * 20, "en", "hot", 120], [None, rows[1][1], "en", None, 5], rows[2]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").cache()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_copies", "passages", "packing"]

    good = stages["quality"](spark, docs, str(tmp_path)).cache()
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    # numbers alone have no letter case or marks to judge by: either way is right for 272
    assert {i for i in range(240) if i % 5} <= ids and not {i for i in range(240) if i % 5 == 0} & ids and not {270, 271} & ids

    spoken = stages["language"](spark, docs, str(tmp_path)).cache()
    assert spoken.columns == columns
    assert {r.doc_id for r in spoken.collect()} == {r[0] for r in rows} - {270, 271, 272}

    single = stages["near_copies"](spark, docs, str(tmp_path)).cache()
    assert single.columns == columns
    components = {r.component_id for r in simhash.simhash_components(docs).collect()}
    kept = [r.doc_id for r in single.collect()]
    assert sorted(kept) == sorted(components) and not set(range(240, 270)) & set(kept)

    cut = stages["passages"](spark, docs, str(tmp_path)).cache()
    assert cut.columns == columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert "p30" in texts[7] and not any("p30" in texts[i] for i in range(27, 240, 20)) and 240 not in texts and texts[1] == rows[1][1]
    assert all(r.n_chars == len(r.text) for r in cut.filter("text is not null").collect() if r.doc_id is not None)

    # one after another: each works on what its predecessor kept
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in found}
    assert left <= ids & set(components) and 1 in left and 7 in left
    assert {r.doc_id for r in found if r.start == 0} == left


def test_stages_take_empty_tables(spark, tmp_path):
    corpus(spark, str(tmp_path))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_language_score_has_a_floor(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog", "en") for i in range(8)] + [(9, "щщщ жжж ъъъ " * 40, None)], "doc_id long, text string, lang string")
    assert langid.known(docs, least=0.2).count() == 8


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    corpus(spark, str(tmp_path))
    names = ["row", "fp", "repeats", "keep", "others", "words", "component_id", "id"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    long = docs.filter("doc_id = 1").withColumns({"doc_id": F.lit(999).cast("long"), "text": F.repeat(F.lit("the of and tion "), 50_000)})
    docs = docs.unionByName(long)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        rows = found.filter("doc_id is not null").collect()
        assert len(rows) > 100 and all(r[n] == f"{n} of {r.doc_id if r.doc_id != 999 else 1}" for r in rows for n in names), name


def test_quality_leaves_no_copy_of_the_texts(spark, monkeypatch):
    from candlewick.llm import quality

    folder, wrote, durable = "/root/testdata/sf0.001", [], quality.durable
    monkeypatch.setattr(quality, "durable", lambda df, name: (wrote.append((name, df.columns)), durable(df, name))[1])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = sorted(map(tuple, dict(corpus_pipeline.STAGES)["quality"](spark, docs, folder).collect()))
    assert wrote == [("paths", ["host", "path", "n_path", "s_path"])]
    whole = quality.posterior(docs, labels=spark.read.parquet(f"{folder}/labels.parquet")).filter("keep").select("row.*")
    assert kept == sorted(map(tuple, whole.collect()))
