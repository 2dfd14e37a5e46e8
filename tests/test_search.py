"""Search: one tokenizer for texts and queries, the stored index, block bounds, prefixes, substrings."""

from __future__ import annotations

import contextlib
import io
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from recollect import GraphState, Memory
from recollect.functions.text import search_terms, search_tokens
from recollect.operators import retrieval, search
from recollect.sources import segments
from recollect.sources.segments import build

from test_graph import links, nodes

WORDS = ["йод", "мой", "ёлка", "здесь", "άλφα", "ΟΔΟΣ", "한국", "ガイド", "ぱん", "äpfel", "café", "Ångström", "straße", "naïve", "x1_y2", "٣٤", "İstanbul", "数据库"]


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_texts_and_queries_are_cut_alike(spark):
    rng = random.Random(2)
    texts = [form(w) for w in WORDS for form in (str, str.upper, lambda w: unicodedata.normalize("NFD", w))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x530), rng.randrange(0x1E00, 0x1F00), rng.randrange(0x3040, 0x3100), 0xAC00 + rng.randrange(11172)])) for _ in range(30)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search_tokens(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [search_terms(r["t"]) for r in rows]


@pytest.mark.parametrize("word", WORDS)
def test_words_of_every_script_are_found(spark, word):
    kinds = ["NFC"] if "가" <= word[0] <= "힣" else ["NFC", "NFD"]  # taken apart, Hangul is another text
    df = nodes(spark, [{"id": k, "content": f"one {unicodedata.normalize(k, word)} two"} for k in kinds] + [{"id": "other", "content": "one two"}])
    for k in kinds:
        asked = unicodedata.normalize(k, word)
        assert {r["id"] for r in search.search(df, f'"{asked}"').collect()} == set(kinds), k


def scores(index, query):
    return {r["node_id"]: round(r["score"], 9) for r in search.bm25(index, query).collect()}


def test_stored_index_after_many_changes(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [a + b for a in "abcdef" for b in "xyz"]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))) or None
    held = {f"n{i}": text() for i in range(30)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id string, content string")
    index, most = build(spark, str(tmp_path), frame(held)), 1
    for step in range(7):
        before, ids = dict(held), [rng.choice([*held, f"new{step}", "nobody"]) for _ in range(3)]
        for i in ids:
            if i in held and rng.random() < 0.4:
                del held[i]
            elif i != "nobody":
                held[i] = text()
        index = index.changed(frame(before), frame(held), spark.createDataFrame([(i,) for i in ids], "id string"))
        most = max(most, len(index.segments))
    fresh = search.build_index(frame(held))
    whole = index.merged(whole=True)
    assert len(whole.segments) == 1 and not whole.segments[0].dead and most <= 4 and len(index.segments) > 1
    for found in (index, whole):
        assert tuple(found.totals.first()) == tuple(fresh.totals.first())
        for query in ("ax OR by", "cz NOT ax", '"ax by"', "a*", "ax dz"):
            assert scores(found, query) == scores(fresh, query), query
        words = {w for t in held.values() for w in (t or "").split()}
        assert found.counts(sorted(vocabulary)) == {w: sum(w in (t or "").split() for t in held.values()) for w in vocabulary} and words
        for limit in (1, 5, 100):
            want = sorted(scores(fresh, "ax OR by").items(), key=lambda x: (-x[1], x[0]))[:limit]
            assert [(r["node_id"], round(r["score"], 9)) for r in search.top_hits(found, "ax OR by", limit).collect()] == want


def test_store_keeps_its_index(spark, tmp_path):
    path = f"{tmp_path}/store"
    with Memory.open(spark, path) as m:
        m.create_node("a", "Redis caches data", strength=0.9)
        m.create_node("b", "Python and data")
        m.update_node("b", content="Kotlin and data")
        m.create_link("a", "b")
    m = Memory.open(spark, path)
    assert [n["id"] for n in m.fts5_search("kotlin")] == ["b"] and m.fts5_search("python") == []
    assert {n["id"] for n in m.fts5_search("data")} == {"a", "b"}
    plan = plan_of(search.search(m.state.nodes, "data", 5, m.index()).drop("content"))
    assert "postings" in plan and "content:string" not in plan  # no text is read
    recalled = retrieval.retrieve(m.state, "data", tier=retrieval.RecallTier.WARM, index=m.index())
    assert recalled.paths.count() == 2
    m.delete_node("a")
    assert {n["id"] for n in m.fts5_search("data")} == {"b"}
    version, known = m.state.version, m.state.index
    m.update_link(1, weight=0.9)  # texts are as they were: the index is too
    assert m.state.version == version + 1 and m.state.index == known
    bare = Memory.open(spark, f"{tmp_path}/bare", indexed=False)
    bare.create_node("x", "some text")
    assert bare.index() is None and [n["id"] for n in bare.fts5_search("text")] == ["x"]


def test_top_hits_open_few_blocks(spark, tmp_path):
    common = F.concat(F.lit("common word "), F.repeat(F.lit("filler "), (F.col("id") % 40 + 5).cast("int")))
    rows = spark.range(12_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 30, F.lit("rare common")).otherwise(common).alias("content"))
    index = build(spark, str(tmp_path), rows)
    everything = index.blocks.where("term = 'common'").count()
    opened = search.open_blocks(index, "rare OR common", 10)[0]
    assert everything >= 90 and 0 < opened.count() < everything / 10
    for query in ("rare OR common", "common NOT rare", "rare common", "word"):
        want = search.bm25(index, query).orderBy(F.desc("score"), "node_id").limit(10).collect()
        assert search.top_hits(index, query, 10).collect() == want, query
    assert search.open_blocks(index, '"common word"', 10) is None and search.open_blocks(index, "NEAR(common word)", 10) is None
    assert search.top_hits(index, "nothing", 5).count() == 0


def test_prefixes_meet_their_bin(spark):
    terms = ["a", "ab", "abc", "abcd", "abce", "b", "été", "étéx", "数据", "数据库"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    wanted = spark.createDataFrame([(p,) for p in ["a", "abc", "abcde", "ét", "数", "数据库", "z"]], "token string")
    found = search.completions(df, wanted)
    assert sorted(map(tuple, found.collect())) == sorted((p, t) for p in ["a", "abc", "abcde", "ét", "数", "数据库", "z"] for t in terms if t.startswith(p))
    assert "sequence" not in plan_of(found) and "NestedLoop" not in plan_of(found)


def _like(text, query):
    import re

    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in low(query))
    return text is not None and re.search(pattern, low(text), re.S) is not None


def test_substrings_for_a_table_of_queries(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abAB é%_\\\n") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", "ÉCOLE", "école", "x\\y", "aaaaaaaa"]
    rows = [{"id": f"n{i:03d}", "content": t, "entities": [texts[-i]] if i % 3 else None} for i, t in enumerate(texts)]
    queries = ["ab", "abA", "a%b", "aba_b", "b%%ab", "École", "ÉCOLE", "x\\y", "\\", "", "_", "%", "aaaa", "zzz", "ab\n", None]
    df = nodes(spark, rows)
    asked = spark.createDataFrame([(i, q, 1000 if i % 2 else 3) for i, q in enumerate(queries)], "query_id int, query string, limit int")
    want = []
    for i, q in enumerate(queries):
        hits = [r["id"] for r in rows if q is not None and any(_like(t, q) for t in [r["content"], *(r["entities"] or [])])]
        want += [(i, k + 1, h) for k, h in enumerate(hits[: 1000 if i % 2 else 3])]
        if q:
            assert [r["id"] for r in search.like_search(df, q, 1000).collect()] == hits, q
    found = search.like_many(df, asked)
    assert sorted(map(tuple, found.select("query_id", "place", "id").collect())) == sorted(want)
    long = search.like_many(df, asked.where("length(query) > 3 AND NOT query LIKE '%!%%' ESCAPE '!'"))
    assert "NestedLoop" not in plan_of(long) and "CartesianProduct" not in plan_of(long)


def test_recall_looks_for_entities_among_all_nodes(spark):
    state = GraphState.of(nodes(spark, [{"id": f"s{i:02d}", "strength": 0.9, "entities": ["other"]} for i in range(60)] + [{"id": "weak", "strength": 0.4, "entities": ["Redis"]}]), links(spark, []))
    ids = lambda found: [r["node_ids"] for r in found.paths.collect()]
    assert "weak" not in sum(ids(retrieval.retrieve(state, "Redis")), [])
    assert ids(retrieval.retrieve(state, "Redis", prelimit=None)) == [["weak"]]
    asked = spark.createDataFrame([(1, "Redis")], "query_id int, query string")
    assert [r["node_ids"] for r in retrieval.retrieve_many(state, asked, prelimit=None).collect()] == [["weak"]]


def test_segment_sizes_bound_their_number(spark, tmp_path, monkeypatch):
    index = segments.StoredIndex(spark, "", tuple(segments.Segment(f"s{i}", i, n, n, n, 0) for i, n in enumerate([1000, 150, 20, 3])))
    written = []
    monkeypatch.setattr(segments.StoredIndex, "_nodes", lambda self, young: spark.createDataFrame([], "seg long, node_id string, content array<string>, content_zh array<string>, dl long"))
    monkeypatch.setattr(segments.StoredIndex, "_write", lambda self, rows, seg, dead: written.append(seg) or segments.Segment("m", seg, 0, 0, 0, 0))
    assert index.merged() is index  # each over four times the next: nothing to do
    assert len(segments.StoredIndex(spark, "", (*index.segments, segments.Segment("s4", 4, 1, 1, 1, 0))).merged().segments) == 4 and written == [4]


def test_best_nodes_by_rounded_scores(spark, tmp_path):
    rows = [{"id": f"n{i:02d}", "content": "rare word" if i < 3 else "word " * (i % 7 + 1)} for i in range(40)]
    index = build(spark, str(tmp_path), nodes(spark, rows))
    every = sorted(((-round(r["score"], 6), r["node_id"]) for r in search.bm25(index, "rare OR word").collect()))
    for limit in (2, 5, 20):
        found = search.top_hits(index, "rare OR word", limit, digits=6).collect()
        assert [(-r["score"], r["node_id"]) for r in found] == every[:limit]


def test_a_known_name_is_an_entity():
    from recollect.functions.ner import extract_entities

    assert extract_entities(" redis ") == ["Redis"] and extract_entities("Redis") == ["Redis"] and extract_entities("hation") == []


def test_segments_are_made_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Runs that end within blocks, both columns, empty texts: as from tables."""
    monkeypatch.setattr(segments, "RUN", 200)
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", None)
    rng = random.Random(5)
    rows = [(f"n{i}", " ".join(rng.choice("abcde") for _ in range(rng.randrange(12))) or None) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, content string")
    words = F.when(F.col("id").endswith("7"), F.lit("数 a a"))
    index = segments.StoredIndex(spark, str(tmp_path))
    index = segments.replace(index, segments=(index._write(segments.tokenized(df, words), 1, None),))
    fresh = search.build_index(df, words)
    columns = ("term", "node_id", "col", "positions", "dl")
    assert sorted(map(str, index.postings.select(*columns).collect())) == sorted(map(str, fresh.postings.select(*columns).collect()))
    assert tuple(index.totals.first()) == tuple(fresh.totals.first())
    assert index.blocks.groupBy("block", "term").count().where("count > 1").count() > 0
    want = sorted(((-r["score"], r["node_id"]) for r in search.bm25(fresh, "a OR b").collect()))[:7]
    assert [(round(-r["score"], 9), r["node_id"]) for r in search.top_hits(index, "a OR b", 7).collect()] == [(round(s, 9), i) for s, i in want]


def test_equal_queries_are_searched_once(spark, monkeypatch):
    real, seen = search._each_of, []
    monkeypatch.setattr(search, "_each_of", lambda nodes, asked, index: seen.append(asked.count()) or real(nodes, asked, index))
    df = nodes(spark, [{"id": f"n{i}", "content": "alpha " * (i + 1) + "beta" * (i % 2)} for i in range(6)])
    asked = spark.createDataFrame([(1, "alp*", 2), (2, " alp*", 4), (3, "alpha AND beta", 9), (4, "alpha AND beta", 1), (5, "a, b", 3), (6, "pha ,", 3)], "query_id int, query string, limit int")
    found = {}
    for r in search.search_many(df, asked).orderBy("query_id", "place").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["score"] and round(r["score"], 9)))
    one = lambda q, n: [(r["id"], r["score"] and round(r["score"], 9)) for r in search.search(df, q, n).orderBy("place").collect()]
    assert seen == [4] and {k: v for k, v in found.items()} == {k: one(q, n) for k, q, n in ((1, "alp*", 2), (2, "alp*", 4), (3, "alpha AND beta", 9), (4, "alpha AND beta", 1))}


def test_patterns_meet_texts_by_one_piece(spark):
    """A piece a pattern, not all its trigrams with all texts."""
    df = nodes(spark, [{"id": f"n{i:02d}", "content": f"some common words {i:02d}xyzzy{i % 3}"} for i in range(30)])
    asked = spark.createDataFrame([(i, q, 30) for i, q in enumerate(["common words 07xyzzy", "zzy1", "mmo%zy2", "mmo%zy2", "some_common"])], "query_id int, query string, limit int")
    found = search.like_many(df, asked)
    assert {r["query_id"]: r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 10, 2: 10, 3: 10, 4: 30}
    assert "BroadcastHashJoin" in plan_of(found) and "count(distinct" not in plan_of(found)


def test_a_search_without_an_index_reads_texts_once_and_holds_asked_words_only(spark):
    texts = ["redis caches data", "plain data", None, "", "Café data, redis", "rediscovered plans"] * 3
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    plain = nodes(spark, [{"id": f"n{i:02}", "content": t or ""} for i, t in enumerate(texts)])
    counted = plain.withColumn("content", told.asNondeterministic()("content"))
    index = search.build_index(plain)
    asked = spark.createDataFrame([(i, q, 20) for i, q in enumerate(("redis data", "cafe OR plans", '"plain data"', "none of it"))], "query_id int, query string, limit int")
    rows = lambda df: sorted(map(str, df.collect()))
    want, read.value = rows(search.search_many(plain, asked, index)), 0
    assert want and rows(search.search_many(counted, asked)) == want and read.value == len(texts)
    for q in ("redis data", "redis*", '"plain data" OR cafe', "data NOT redis"):
        want, read.value = rows(search.search(plain, q, index=index).select("id", "score", "place")), 0
        assert want and rows(search.search(counted, q).select("id", "score", "place")) == want and read.value == len(texts)
    assert rows(search.search_many(plain, asked.withColumn("query", F.lit("re*")))) == rows(search.search_many(plain, asked.withColumn("query", F.lit("re*")), index))
    part = search.index_for(plain, spark.createDataFrame([("data",), ("no",)], "term string"))
    assert rows(part.postings) == rows(index.postings.where("term = 'data'")) and rows(part.totals) == rows(index.totals)


def test_patterns_pass_texts_without_their_pieces_being_rows(spark, monkeypatch):
    from recollect.operators import patterns

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["lorem", "Ipsum", "dölor", "sit_amet", "99%", "x"]) for _ in range(rng.randrange(0, 30))) for _ in range(90)]
    df = nodes(spark, [{"id": f"n{i}", "content": t, "entities": [texts[-i][:9]] if i % 2 else None} for i, t in enumerate(texts)]).repartition(3)
    asked_for = ["lorem%dölor x", "m ipsum", "d_lor%_it", "sit_amet x lorem", "x x x", "99% lorem", "x", "", "none of it", "lorem lorem lorem"]
    asked = spark.createDataFrame([(i, q, 1 + 2 * i) for i, q in enumerate(asked_for)], "query_id int, query string, limit int")
    order = sorted(range(90), key=lambda i: f"n{i}")
    want = []
    for k, q in enumerate(asked_for):
        hits = [f"n{i}" for i in order if _like(texts[i], q) or (i % 2 and _like(texts[-i][:9], q))]
        want += [(k, place + 1, h) for place, h in enumerate(hits[: 1 + 2 * k])]
    for head, many in ((4096, 50_000), (7, 50_000), (7, 3)):  # one phase; two; several passes
        monkeypatch.setattr(search, "HEAD", head)
        monkeypatch.setattr(search, "PATTERNS", many)
        found = search.like_many(df, asked)
        assert sorted(map(tuple, found.select("query_id", "place", "id").collect())) == sorted(want)
        assert "regexp_extract_all" not in plan_of(found)  # a row for each piece of each text before
    data = [t.encode() for t in texts]
    monkeypatch.setattr(patterns, "LOOKED", 50)  # windows are looked at in parts that overlap
    state = patterns.Matcher([("lorem%x", 100)])
    import numpy as np

    state.take([f"n{i}" for i in range(90)], np.arange(90), np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(t) for t in data]))
    assert state.patterns[0].ids == sorted(f"n{i}" for i, t in enumerate(texts) if _like(t, "lorem%x"))


def test_texts_meet_no_labels_where_outcomes_are_not_asked_for(spark):
    from recollect.sources import fixtures

    sf = "/root/testdata/sf0.001"
    with_, without = fixtures.nodes(spark, sf), fixtures.nodes(spark, sf, outcome=False)
    assert "Join" not in plan_of(without) and without.schema == with_.schema
    rows = lambda df: sorted(map(str, df.drop("outcome").collect()))
    assert rows(without) == rows(with_)


def test_prefixes_make_no_row_of_each_node_that_has_them(spark, monkeypatch):
    rng = random.Random(6)
    words = "alpha alps alone beta better bet gamma".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(60)] + ["alpha beta"] * 30  # many tie
    df = nodes(spark, [{"id": f"n{i:02}", "content": t} for i, t in enumerate(texts)]).repartition(2)
    asked = spark.createDataFrame([(i, q, n) for i, (q, n) in enumerate([("al*", 5), ("alp*", 3), ("b*", 7), ("be *", 2), ("alpha*", 90), ("z*", 4), ("gamma", 4)])], "query_id int, query string, limit int")
    index = search.build_index(df)
    want = sorted((r["query_id"], k + 1, h["node_id"], round(h["score"], 9)) for r in asked.collect() for k, h in enumerate(search.top_hits(index, r["query"], r["limit"]).collect()))
    for held, many, given in ((500, 50_000, None), (7, 2, None), (7, 50_000, index)):
        monkeypatch.setattr(search, "HELD_NODES", held)
        monkeypatch.setattr(search, "PATTERNS", many)
        found = search.search_many(df, asked, given).select("query_id", "place", "id", F.round("score", 9).alias("s")).collect()
        assert sorted(map(tuple, found)) == want
    task = next(iter(spark.createDataFrame([("n%03d" % i, "alpha beta", "", 2) for i in range(400)], "node_id string, content string, content_zh string, dl long").coalesce(1).mapInArrow(search.begun([("al*", "al", ["content"], 3)], 2.0), "query string, id string, dl long, tf double").groupBy().count().collect()))
    assert task["count"] == 4  # three nodes and how many there are, of 400
