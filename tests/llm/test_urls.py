"""URL verdicts against a plain loop."""

import math
import random
import re
from collections import Counter

from candlewick.llm import urls

PAGES = [
    (1, "https://Blog.CheapPills.example.net/en/1?x#y", "<p>cheap pills and pills</p>"),
    (2, "http://example.org", "<script>cheap</script> pills &amp; win"),
    (3, "http://example.org/es/4", "spam"), (4, "http://a.example.org/en/12", None), (5, "http://xexample.org/en/12", ""),
    (6, "ftp://shop.COM/fr/x", "the shop"), (7, "http://shop.com/de/#q", "shop shop"), (8, "http://com/de/", "x"),
    (9, None, "nothing"), (10, "no scheme/at all", "x"), (11, "http://winspam.net/cheap/win", "win spam spam"),
    (12, "http://theshop.net/en/shop", "the the shop"), (13, "http://cheapshop.net/en/cheap", "cheap"), (14, "http://a://b/c", "x"), (15, "http://?q", "x"),
    (15, "http://?q", "x"), (None, "http://casino.net/", "casino"), (17, "http://CHEAP.example.net/win/cheap", ""), (18, "http://org/x", "y"), (19, "http://" + "verylongname" * 40 + ".net/", "very long name"),
]


def brute(pages):
    words = Counter()
    for _, url, html in pages:
        text = re.sub(r"<[^>]*>|&#?\w+;", " ", re.sub(r"(?is)<script\b.*?</script>", " ", html or ""))
        words.update(w for w in re.findall("[a-z]+", text.lower()) + re.findall("[a-z]+", (url or "").lower()) if len(w) <= urls.LONGEST)
    total = sum(words.values())
    parts = []
    for page, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        split = lambda s: [t for r in re.findall("[a-z]+", s.lower()) for t in urls.viterbi(r, words, total)]
        parts.append((page, host, path, split(host), split(path)))
    bad = {h for _, h, _, t, _ in parts if set(t) & set(urls.SEEDS)}
    # every distinct host counts once for each of its pages
    counts = {True: Counter(), False: Counter()}
    for _, h, _, a, b in parts:
        counts[h in bad].update(a + b)
    kinds = set(counts[True]) | set(counts[False])
    n = sum(h in bad for _, h, *_ in parts)
    weight = {t: math.log((counts[True][t] + 1) / (counts[True].total() + len(kinds))) - math.log((counts[False][t] + 1) / (counts[False].total() + len(kinds))) for t in kinds}
    out = []
    for page, h, p, a, b in parts:
        fits = [r for r in urls.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text)) if fits else None
        score = round(math.log(n / (len(parts) - n)) + sum(weight[t] for t in a + b), 6)
        out.append((page, h, p, rule and rule.text, rule.verdict if rule else "block" if score > 0 else "allow", score))
    return out


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, host string")
    found = [(*r[:5], round(r.score, 6)) for r in urls.judge(df).collect()]
    want = brute(PAGES)
    assert sorted(map(str, found)) == sorted(map(str, want))
    verdicts = {r[0]: r[3:5] for r in found}
    assert verdicts[4] == ("example.org/en/1", "block") and verdicts[5] == ("org/", "allow") and verdicts[2] == (None, "allow")
    assert verdicts[11] == (None, "block") and verdicts[12] == (None, "allow") and verdicts[1] == (None, "block")


def test_segmentation():
    counts = {"cheap": 9, "pills": 9, "che": 1, "the": 50, "rapist": 1, "therapist": 5}
    assert urls.viterbi("cheappills", counts, 100) == ["cheap", "pills"]
    assert urls.viterbi("therapist", counts, 100) == ["therapist"]
    assert urls.viterbi("qq", {}, 100) == ["qq"] and urls.viterbi("", counts, 100) == []


def test_odd_tables(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert urls.judge(df.limit(0)).collect() == []
    assert {r.verdict for r in urls.judge(df.filter("page_id = 12")).collect()} == {"allow"}


def test_query_splits_concatenated_hosts(spark, tmp_path):
    # the names stand on many pages, in these pages' own texts too, and one of them in a link of other pages
    rows = [(i, f"http://cheappills.net/{i}", "<p>CheapPills at cheappills.net, order</p>") for i in range(100)]
    rows += [(i, f"http://www.freecasinowin.net/{i}", "<h1>freecasinowin</h1>") for i in range(100, 130)]
    rows += [(130, "http://cheap-pills.net/", "x"), (131, "http://free-casino.net/", "x"), (132, "http://win-bets.net/", "x"), (133, "http://casinobets.net/", "x")]
    rows += [(i, f"http://daily{i % 9}.net/news/{i}", "<p>cheap tea, free win, pills for the daily news</p> see http://cheappills.net/a") for i in range(200, 500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    names = spark.createDataFrame([(r,) for r in ("cheappills", "freecasinowin", "casinobets", "daily", "casino", "cheap")], "run string")
    split = {r.run: r.tokens for r in urls.segmented(names, urls.outside_words(pages)).collect()}
    assert split == {"cheappills": ["cheap", "pills"], "freecasinowin": ["free", "casino", "win"], "casinobets": ["casino", "bets"], "daily": ["daily"], "casino": ["casino"], "cheap": ["cheap"]}
    verdicts = {r.page_id: r.verdict for r in urls.op7_urls(spark, str(tmp_path)).collect()}
    assert {verdicts[i] for i in range(134)} == {"block"} and {verdicts[i] for i in range(200, 500)} == {"allow"}


def test_bayes_decides_beyond_seed_words(spark, tmp_path):
    rows = [(i, f"http://{a}-{b}.net/{a}/{i}", "<p>cheap, free, win, now</p>") for i, (a, b) in enumerate([(a, b) for a in ("cheap", "free", "win", "now") for b in ("casino", "pills", "bets")] * 9)]
    rows += [(1000 + i, f"http://daily-news{i % 9}.net/news/{i}", "<p>daily news of the town</p>") for i in range(300)]
    rows += [(2000, "http://winfreecheap.net/free/now", "x"), (2001, "http://farm.daily-news.net/news/daily", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    verdicts = {r.page_id: r.verdict for r in urls.op7_urls(spark, str(tmp_path)).collect()}
    assert verdicts[2000] == "block"  # no seed word, but words of the hosts that have one
    assert verdicts[2001] == "allow"  # a seed word among words of the others
    assert {verdicts[i] for i in range(108)} == {"block"} and {verdicts[1000 + i] for i in range(300)} == {"allow"}


def test_viterbi_against_all_splits():
    counts = {"a": 3, "ab": 5, "ba": 2, "aba": 1, "b": 1, "bab": 4, "abab": 1}

    def splits(run):
        return [[]] if not run else [[run[:i], *rest] for i in range(1, len(run) + 1) for rest in splits(run[i:])]

    def log_p(words):
        return sum(math.log(counts[w] / 20) if w in counts else -math.log(20) - len(w) * math.log(10) for w in words)

    for n in range(1, 9):
        for k in range(2**n):
            run = "".join("ab"[k >> i & 1] for i in range(n))
            found = urls.viterbi(run, counts, 20)
            assert "".join(found) == run and abs(log_p(found) - max(map(log_p, splits(run)))) < 1e-9


def test_hidden_text_of_broken_pages_is_linear():
    import time

    begin = time.perf_counter()
    assert urls.HIDDEN.sub(" ", "seen <script>a</script> too <style>b").split() == ["seen", "too"]
    urls.HIDDEN.sub(" ", "<script " * 200_000)
    urls.HIDDEN.sub(" ", "<" * 400_000)
    assert time.perf_counter() - begin < 5


def test_urls_of_very_many_letters_are_judged(spark):
    pick = random.Random(9)
    long = "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    rows = [(1, "https://spamfarm.com/x", "spam farm"), (2, f"https://{long[:20_000]}.net/spam", None), (3, f"https://good.net/{long}", "good text"), (4, "https://good.net/", None)]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), words=urls.outside_words).collect()}
    assert len(found) == 4 and found[3].path == f"/{long}" and found[4].verdict == "allow" and all(r.verdict in ("allow", "block") for r in found.values())


def test_pieces_of_a_run_are_whole_over_slices():
    run = "".join(random.Random(2).choices("abc", k=urls.SLICE * 2 + 100))
    want = {run[i:j] for i in range(len(run)) for j in range(i + 1, min(i + urls.LONGEST, len(run)) + 1)}
    assert set().union(*urls._pieces(run)) == want
