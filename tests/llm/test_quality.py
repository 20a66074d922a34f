"""Quality: the posteriors against plain arithmetic, held-out accuracy, odd rows."""

import random

import numpy as np

from candlewick.llm import quality


def table(spark, n=600):
    pick = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = pick.random() < 0.8
        words = [pick.choice(["alpha", "beta", "of", "the", "gamma"]) for _ in range(pick.randint(5, 60))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + pick.choice(["!!", "$$$", " |"]) for w in words)
        rows.append((i, text, "hot" if i % 3 == 0 else f"s{i % 40}", pick.choice(["en", "de", None]), "x"))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(n, None, "hot", "en", "x"), (n + 1, "", None, None, "x"), (3, rows[3][1], rows[3][2], rows[3][3], "x"), (None, rows[4][1], "s9", "en", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    rows, docs, labels = table(spark)
    found = quality.posterior(docs, labels=labels).select("row.*", "p_quality", "row.keep", quality.F.col("keep").alias("kept")).collect()
    assert len(found) == len(rows) and {r.keep for r in found} == {"x"}
    out = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 == 0]
    assert sum(r.kept == (r.text.endswith(".") and r.text.islower()) for r in out) >= 0.98 * len(out)
    assert not any(r.kept for r in found if not r.text)
    assert quality.posterior(docs.limit(0), labels=labels).collect() == []
    assert quality.posterior(docs, labels=labels.limit(0)).filter("keep").count() > 0


def strength(groups, prior):
    """Beta strength by moments, in plain arithmetic: groups of (documents, sum), each with a prior rate."""
    v = noise = spread = n_all = 0
    for (n, s), m in zip(groups, prior, strict=True):
        m = min(max(m, 1e-4), 1 - 1e-4)
        v += n * (s / n - m) ** 2
        noise += m * (1 - m)
        spread += n * m * (1 - m)
        n_all += n
    if v <= noise * (1 + 1e-9):
        return quality.FIRM
    return min(quality.FIRM, max(0.5, spread / n_all / ((v - noise) / n_all) - 1))


def test_posteriors_against_plain_arithmetic(spark):
    rows, docs, labels = table(spark)
    found = quality.posterior(docs, labels=labels).select("row.source", "row.lang", "p_document", "p_host", "p_path", "p_quality").collect()
    mean = np.mean([r.p_document for r in found])
    hosts, paths = {}, {}
    for r in found:
        for sums, key in ((hosts, r.source), (paths, (r.source, r.lang))):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = n + 1, s + r.p_document
    outer = strength(hosts.values(), [mean] * len(hosts))
    inner = strength(paths.values(), [(hosts[h][1] + outer * mean) / (hosts[h][0] + outer) for h, _ in paths])
    odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    for r in found:  # each document is left out of its own sites
        n, s = hosts[r.source]
        host = (s - r.p_document + outer * mean) / (n - 1 + outer)
        n, s = paths[r.source, r.lang]
        path = (s - r.p_document + inner * host) / (n - 1 + inner)
        z = odds(r.p_document) + odds(path) - odds(mean)
        assert abs(r.p_host - host) < 2e-6 and abs(r.p_path - path) < 2e-6 and abs(1 / (1 + np.exp(-z)) - r.p_quality) < 2e-6


def test_features_against_plain_counts():
    text = "Ab c, 12!\nAb c, 12!\nwörd"
    got = dict(zip(quality.FEATURES, quality.features(text), strict=True))
    size = len(text.encode())
    assert abs(got["upper"] - (2 / size) ** 0.5) < 1e-12 and abs(got["digit"] - (4 / size) ** 0.5) < 1e-12 and abs(got["wide"] - (2 / size) ** 0.5) < 1e-12
    assert abs(got["line_repeats"] - 1 / 3) < 1e-12 and abs(got["word_repeats"] - 3 / 7) < 1e-12 and abs(got["short_words"] - 6 / 7) < 1e-12
    assert not quality.features(None).any() and not quality.features("").any() and np.isfinite(quality.features("a " * 10**6)).all()


def test_a_site_changes_a_decision(spark):
    rows, docs, labels = table(spark)
    fair = "alpha beta THE OF! gamma of"
    more = [(1000 + i, "alpha of the gamma beta of the.", "clean", "en", "x") for i in range(200)] + [(2000 + i, "ALPHA!! OF$$$ THE | BETA!!", "junk", "en", "x") for i in range(200)]
    pick = [(3000, fair, "clean", "en", "x"), (3001, fair, "junk", "en", "x"), (3002, fair, "alone", "en", "x")]
    both = docs.unionByName(spark.createDataFrame(more + pick, docs.schema))
    found = {r.doc_id: r for r in quality.posterior(both, labels=labels).filter("row.doc_id >= 3000").select("row.doc_id", "p_document", "p_quality", "keep").collect()}
    assert found[3000].p_document == found[3001].p_document
    assert found[3000].keep and not found[3001].keep and found[3000].p_quality > found[3002].p_quality > found[3001].p_quality


def test_repeated_rows_of_a_label_and_ties(spark):
    docs = spark.createDataFrame([(i % 5, "abc " * (i + 1), None, None) for i in range(40)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    one, two = (quality.learned(d, labels) for d in (docs, docs.repartition(7)))
    assert np.array_equal(one.weights, two.weights)
    # without a classifier all have a half, which is kept
    assert quality.posterior(docs).filter("keep and p_document = 0.5").count() == 40
