"""Phrases, page texts and centroids against models of their own."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import kmeans, page_text, phrases

# ---- 11: phrases


def _phrase_model(rows, least, longest=5, top=2000, share=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    many = {p: a for p, a in f.items() if a >= least}
    inside = Counter()
    for (lang, w), a in many.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], a)
    out = []
    for (lang, w), a in many.items():
        if len(w) == 1 or 100 * inside[lang, w] >= share * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r, n[lang]))
    best, place = [], Counter()
    for lang, score, a, phrase, l, r, all_ in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            best.append((lang, place[lang], phrase.decode(), -a, l, r, all_, -score))
    return best


@pytest.mark.parametrize(("least", "top", "share"), [(3, 2000, 100), (2, 7, 100), (4, 50, 60)])
def test_phrases_are_those_of_all_ngrams(spark, corpus, least, top, share):
    docs = corpus.unionByName(corpus.sparkSession.createDataFrame([(500, "Der Hund. der HUND\tder hund", None, "s", 1, "x"), (501, "ba ba ba ba ba ba ba", "und", "s", 1, "x")], corpus.schema))
    docs = docs.withColumns({c: F.lit("own") for c in ("phrase", "f", "words", "k", "n", "rank", "salt", "cut")})
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = phrases.collocations(docs, least, 5, top, share)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    want = _phrase_model(rows, least, 5, top, share)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(want) > 10 and {"und"} <= {w[0] for w in want}


def test_phrases_of_an_empty_table(spark, corpus):
    assert phrases.collocations(corpus.where("false")).count() == 0
    assert phrases.collocations(corpus.where("doc_id IN (90, 91, 92)"), 1).count() == 0


def test_suffix_intervals_are_ngram_counts():
    rng = random.Random(3)
    for _ in range(60):
        ids = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randrange(0, 60))], np.int64)
        want = Counter(tuple(ids[i : i + n]) for n in range(1, 6) for i in range(len(ids) - n + 1) if ids[i : i + n].all())
        got = {tuple(ids[a : a + n]): c for n, at, counts in phrases.intervals(ids, 1, 5) for a, c in zip(at, counts)}
        assert got == dict(want)


def test_a_text_longer_than_a_shard_is_cut_between_pieces(monkeypatch):
    data = b"a b c\nd e\n" * 300 + b"one very long piece " * 20
    whole = phrases.shard_counts("en", data, 1, 1).to_pandas().set_index("phrase")["f"].to_dict()
    monkeypatch.setattr(phrases, "SHARD_BYTES", 64)
    parts = list(phrases._pieces(data))
    assert len(parts) > 20 and sum(sum(map(len, p.split(b"\n"))) for p in parts) == sum(map(len, data.split(b"\n")))
    sums = Counter()
    for p in parts:
        sums.update(phrases.shard_counts("en", p, 1, 1).to_pandas().set_index("phrase")["f"].to_dict())
    assert dict(sums) == whole


def test_a_full_filter_changes_no_count():
    rng = random.Random(5)
    data = " ".join(rng.choice("abcde") + rng.choice("xyz") for _ in range(4000)).encode()
    full = np.full(phrases.BITS // 8, 255, np.uint8)
    got = phrases.shard_counts("en", data, 2, 3, full, full).to_pandas().set_index("phrase")["f"].to_dict()
    words = data.decode().split()
    assert got == Counter(" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1))


# ---- 12: page texts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div id="cookie-notice">we use cookies</div>
<article><header><h2>Head &amp; line</h2><p>by Someone</p></header><p>First <b>bold</b>ly\n  said<br>here<p>Second &lt;b&gt; &#233;&nbsp;x
<div class="advert">buy</div><form><p>mail</p></form><ul><li>one<li>two</ul><aside>see</aside><!-- a > b --><p title="1 > 0">Third</p>
<section class="comments"><p>nice!</p></section></article><article class="comment"><p>no</p></article><footer>&copy;</footer>"""


def test_article_text():
    assert page_text.page_text(PAGE) == (False, "Head & line\nFirst boldly said here\nSecond <b> é x\none\ntwo\nThird")
    assert page_text.page_text("<main><p>a</p></main><p>b</p>") == (False, "a")
    assert page_text.page_text("<body><p>a</p><div>b<span hidden>c</span></div><noscript>d</noscript>") == (True, "a\nb")
    assert page_text.page_text("plain & simple <3") == (True, "plain & simple <3")
    assert page_text.page_text(None) == page_text.page_text("") == page_text.page_text("<script>x") == (False, "")
    assert page_text.page_text("<article><p>cut o&am") == (False, "cut o&am")
    long = "<article>" + "<p><b>x y<br><p>z" * 20_000 + "</article>"
    assert page_text.page_text(long)[1].count("\n") == 39_999
    page_text.page_text('<a "' * 5_000 + "<p>x")  # unbalanced quotes cost no squares


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    def best(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(7)
    for bits in (1 << 28, 40):
        monkeypatch.setattr(page_text, "STATE_BITS", bits)
        for _ in range(150):
            a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
            got = page_text.common(a, b)
            assert all(a[i] == b[j] for i, j in got) and len(got) == best(a, b)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    same = ["x"] * 5000
    assert len(page_text.common(same, same[:-1])) == 4999


def test_frames_of_open_pages_go(spark):
    body = lambda i, frame=True: ("<div>Welcome to us</div>" if frame else "") + f"<p>text of page {i} which is its own and long enough to tell</p><p>more {i}</p>" + ("<div>All rights kept</div>" if frame else "")
    rows = [(i, f"http://a.org/p/{i:03d}", body(i)) for i in range(40)]
    rows += [(100 + i, f"http://a.org/p/{5:03d}?again={i}", body(5)) for i in range(30)]  # copies of one page
    rows += [(200, "http://b.org/alone", body(1)), (201, None, body(3)), (202, "http://c.org/x", None), (203, "http://c.org/y", "<article>Welcome to us</article>"), (None, "http://a.org/p/zzz", body(9)), (7, "http://a.org/p/007", body(7))]
    rows += [(300 + i, f"http://d.org/{i}", f"<p>a shared article of some length, whole and the same for both of them</p><p>{i}</p>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("text", "lines", "host", "path", "open", "n_chars", "digest", "salt", "n")})
    lines = lambda h: "\n".join(re.findall(r"<(?:p|div|article)>(.*?)</", h or ""))
    bare = lambda t: t.replace("Welcome to us\n", "").replace("\nAll rights kept", "")
    want = sorted((-1 if p is None else p, bare(lines(h)) if "//a.org" in (u or "") else lines(h)) for p, u, h in rows)
    for parts in (1, 7):
        got = page_text.main_text(pages.repartition(parts))
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        found = got.collect()
        assert sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in found) == want
        assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert page_text.main_text(pages.where("false")).count() == 0


def test_differencing_judges_pages_that_declare_articles(spark, monkeypatch):
    article = lambda *ps: "<article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>"
    body = [f"what page {i} has to say, long enough to be told from all of the others" for i in range(12)]
    teasers, licence = article("See also", "Ten more things"), "This text is free for all"
    rows = [(i, f"http://a.org/{i:02d}", teasers + article("By us", body[i], licence)) for i in range(10)]
    rows += [(10, "http://b.org/alone", teasers + article(body[10])), (11, "http://c.org/1", article("one", "two") + article("three")), (12, "http://c.org/2", article("one", "two") + article("three"))]
    rows += [(13, "http://a.org/05/open", "<p>See also</p><p>Ten more things</p><p>open</p>"), (14, "http://a.org/03", article("See also", "Ten more things", "By us", body[3], licence))]
    want = {i: f"By us\n{body[i]}\n{licence}" for i in range(10)}  # shared lines of an article with its own ones stay
    want |= {10: f"See also\nTen more things\n{body[10]}", 11: "one\ntwo\nthree", 12: "one\ntwo\nthree", 13: "See also\nTen more things\nopen", 14: f"See also\nTen more things\nBy us\n{body[3]}\n{licence}"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = page_text.main_text(pages).collect()
    assert len(found) == len(rows) and {r["page_id"]: r["text"] for r in found} == want
    seen, compare = [], page_text.frame_lines
    monkeypatch.setattr(page_text, "frame_lines", lambda compared: seen.append(compared.count()) or compare(compared))
    page_text.main_text(pages)
    assert seen == [len(rows)]  # every page with text is compared


# ---- 13: centroids


def _lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(at))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        at = [[sum(x) // len(h) for x in zip(*h)] if (h := [v for (_, v), m in zip(kept, mine) if m == n]) else at[n] for n in range(len(at))]
    took = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in took:
        sums[c] += d
    cap = (1 << 63) - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(-1 if i is None else i, c, min(d, cap), min(sums[c], cap), min(sum(sums.values()), cap), digest[c]) for i, c, d in took]


def _vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("own") for c in ("cluster", "distance", "inertia", "digest", "points", "_c", "wide")}).repartition(3)


def _found(df):
    assert [c for c, _ in df.dtypes[:3]] == ["vec_id", "cluster", "distance"] and set(df.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("case", ["spread", "close", "large", "few"])
def test_centroids_are_lloyds(spark, case):
    rng = random.Random(case)
    f32 = lambda x: float(np.float32(x))
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    spread = {"spread": 0.02, "close": 1.0, "large": 1.0, "few": 1.0}[case]
    rows = [(i, [f32(x + rng.gauss(0, spread)) for x in rng.choice(middle)]) for i in range(9 if case == "few" else 900)]
    rows += [(i % 4, rows[0][1]) for i in range(3 if case == "few" else 400)]  # one vector again and again
    rows += [(None, [0.0] * 64), (None, [f32(0.5)] * 64), (-5, None), (-6, [1.0] * 63), (-7, [float("nan")] * 64), (-8, [float("inf")] + [0.0] * 63), (-9, [None] + [0.0] * 63)]
    if case == "large":
        rows += [(2000 + i, [f32(rng.gauss(0, 10.0 ** rng.choice([5, 7, 8])))] * 64) for i in range(40)] + [(3000, [f32(3e38)] * 64)]
    assert _found(kmeans.clusters(_vectors(spark, rows))) == sorted(_lloyd(rows))


def test_no_vectors(spark):
    assert kmeans.clusters(_vectors(spark, [(1, None)])).count() == 0


def test_trees_prune_and_take_whole_nodes():
    rng = np.random.default_rng(1)
    middle = rng.integers(-60, 60, (16, 64))
    points = np.concatenate([m + rng.integers(-2, 3, (300, 64)) for m in middle]).astype(np.float64)
    tree = kmeans.kd_tree(points)
    found = list(kmeans.assigned(tree, middle.astype(np.float64)))
    whole = sum(high - low for low, high, _, one in found if one is not None)
    assert whole > 0.9 * len(points)  # most vectors are never compared one by one
    assert sorted(x for low, high, *_ in found for x in range(low, high)) == list(range(len(points)))
    tie = kmeans.undominated(np.array([[0.0] * 64, [2.0] * 64]), np.arange(2), np.ones(64), np.ones(64))
    assert list(tie) == [0, 1]  # a tie is left to the leaves, where the smaller number wins
