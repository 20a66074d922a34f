"""Substring dedup against a plain rule on small tables."""

import hashlib
import random
import re

from candlewick.llm import substring


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            if doc is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(doc, first.get(k, doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 12):
            if doc is not None and first[tuple(w[i : i + 13])] < doc:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_matches_brute_force(spark):
    pick = random.Random(1)
    vocabulary = [f"é{i}" for i in range(40)] + ["a", "A", "x y", "\x1c"]
    passages = [" ".join(pick.choices(vocabulary, k=k)) for k in (12, 13, 14, 40)] + ["la " * 30]
    rows = []
    for i in range(70):
        parts = [" ".join(pick.choices(vocabulary, k=pick.randint(0, 30))) if pick.random() < 0.5 else pick.choice(passages) for _ in range(pick.randint(0, 5))]
        rows.append((pick.randrange(-500, 10**12) if i % 3 else i, pick.choice(["\n", " ", "\t "]).join(parts)))
    rows += [(7, None), (8, ""), (-3, rows[4][1]), (rows[5][0], rows[5][1]), (rows[6][0], rows[9][1]), (None, rows[4][1]), (None, rows[4][1]), (10**15, "w " * 5000)]
    df = spark.createDataFrame([(t, d, "k", 1) for d, t in rows], "text string, doc_id long, starts string, anchors int")
    found = substring.substring_dedup(df, batches=6).selectExpr("row.doc_id", "n_words", "n_removed", "kept_sha256", "text", "row.starts").collect()
    assert sorted(map(str, (tuple(r)[:4] for r in found))) == sorted(map(str, brute(rows)))
    assert {r.starts for r in found} == {"k"}
    for r in found:
        assert hashlib.sha256(" ".join((r.text or "").encode().decode().split(" ")).encode()).hexdigest() == r.kept_sha256 or not r.n_removed


def test_index_is_opened_again_and_compacted(spark, tmp_path):
    pick = random.Random(3)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(6)]
    rows = []
    for i in range(60):
        words = [f"d{i}x{j}" for j in range(pick.randint(0, 20))] + pick.choice(passages)[pick.randint(0, 5) :] + [f"d{i}y{j}" for j in range(5)]
        rows.append((i, " ".join(words)))
    want = {r[0]: r[1:] for r in brute(rows)}
    found = {}
    for at in range(0, 60, 15):  # each batch in a session of its own
        session = spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", str(3 + at // 15))  # buckets are those of the first
        index = substring.WindowIndex(session, f"{tmp_path}/index", most=2)
        assert index.runs == (0, 1, 2, 2)[at // 15]
        batch = session.createDataFrame(rows[at : at + 15], "doc_id long, text string")
        for r in substring.substring_dedup(batch, batches=1, index=index).collect():
            found[r.row.doc_id] = (r.n_words, r.n_removed, r.kept_sha256)
        index.close()
    assert found == want and any(r[1] for r in found.values())
    last = substring.WindowIndex(spark, f"{tmp_path}/index")
    assert last.generation == 2 and last.runs == 2 and last.buckets == 3
    last.delete()
    assert not (tmp_path / "index").exists() and not [t for t in spark.catalog.listTables() if t.name.startswith("window_index")]


def test_hot_passages_are_a_row_for_each_slice(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40))) for i in range(200)], "doc_id long, text string").coalesce(1)
    rows = docs.mapInArrow(substring._runs, "anchor long, windows array<long>, doc_id long, more array<long>").collect()
    assert len(rows) <= 28 and all(r.doc_id == 0 and r.more == list(range(1, 200)) for r in rows)
    assert sum(len(r.windows) for r in rows) == 28


def test_empty_table(spark):
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_depend_on_the_window_alone():
    import numpy as np

    lane = np.random.default_rng(0).integers(0, 2**63, 60, dtype=np.uint64)
    whole = substring.anchors(lane)
    assert [int(substring.anchors(lane[i : i + 13])[0]) for i in range(48)] == whole.tolist()


def test_a_common_phrase_makes_no_false_repeats(spark):
    texts = [
        "w12451 w29244 w3705 w6243 c17 c17 c13 c4 c32 w15532 w8020 w23879 w1141",
        "w1697 w26421 w10193 w8310 c17 c17 c13 c4 c32 w4815 w24314 w27476 w26591",
        "w2251 w9440 w25998 w28495 c17 c17 c13 c4 c32 w3451 w24791 w2981 w13265",
        "w27084 w3577 w16908 w22822 c17 c17 c13 c4 c32 w1124 w29042 w3203 w18862",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in substring.substring_dedup(docs).collect()] == [0] * 4


def test_a_million_windows_of_one_anchor_differ():
    import numpy as np

    pick = np.random.default_rng(5)
    size, phrase = 1_000_000, pick.integers(0, 2**63, 5, dtype=np.uint64)
    # in place of each document's words their fingerprints: four of its own, the phrase, four of its own
    around = [pick.integers(0, 2**63, size, dtype=np.uint64) for _ in range(8)]
    words = around[:4] + [np.full(size, w) for w in phrase] + around[4:]
    sums = sum(w * substring._LANES[1, j] for j, w in enumerate(words))
    assert len(np.unique(substring._mixed(sums))) == size > len(np.unique(substring._mixed(sums) >> np.uint64(32)))
