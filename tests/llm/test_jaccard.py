"""The pipeline's near-copy stage against exact Jaccard similarity over all pairs."""

import random

import corpus_pipeline
from candlewick.llm import jaccard


def near(a, b):
    words = [t.lower().split() for t in (a, b)]
    p, q = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in words)
    return len(p & q) >= 0.8 * len(p | q)


def test_stage_keeps_one_of_each_group(spark):
    pick = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = pick.choices(words, k=pick.choice([4, 60, 150]))
        texts.append(" ".join(base))
        for _ in range(pick.choice([1, 3, 12])):
            parts = list(base)
            for _ in range(pick.randint(0, 4)):
                parts[pick.randrange(len(parts))] = pick.choice(words)
            texts.append(" ".join(parts))
    pick.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    kept = [r.doc_id for r in stage(spark, df, "").collect()]
    assert len(kept) == len(set(kept)) > 25
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near(texts[i], texts[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    lowest = {find(i) for i in range(len(texts))}
    # op1's links may join more, never less
    assert set(kept) <= lowest and len(kept) >= 0.9 * len(lowest)


def test_links_that_no_pivot_has_are_found(spark):
    # a chain: neighbours are near copies, those further apart aren't, so that most pairs aren't with a pivot
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(14):
        texts.append(" ".join(base))
        for j in range(5):
            base[k * 20 + 4 * j] = f"x{k}y{j}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near_pairs = {(i, j) for i in range(14) for j in range(14) if i < j and near(texts[i], texts[j])}
    assert {(i, i + 1) for i in range(13)} <= near_pairs and (0, 13) not in near_pairs
    prints, named = jaccard._named(docs)
    assert {r.component_id for r in named.collect()} == {0}


def test_odd_rows(spark):
    long = "la " * 200_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "A b c d e f"), (5, long), (5, long), (6, long), (7, "one")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, bands string")
    kept = [(r.row.doc_id, r.row.bands) for r in jaccard.representatives(docs).collect()]
    assert sorted(kept) == [(1, "c"), (4, "c"), (5, "c"), (7, "c")]
    assert jaccard.representatives(docs.limit(0)).collect() == []


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    steps, durable = {}, jaccard.durable

    def noted(df, name):
        steps[name] = max(steps.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return durable(df, name)

    monkeypatch.setattr(jaccard, "durable", noted)
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z 0 1 2 3 4 5 6 7 8 9"
    rows = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id long, text string")
    assert sorted(r.row.doc_id for r in jaccard.representatives(rows).collect()) == [1, 3]
    assert steps["near-texts"] == steps["near-prints"] == 1 and max(steps.values()) == 1
