"""Goldens and models for the memory graph."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect import GraphState, Memory, extract_entities, extract_implicit_references, normalize_entity
from recollect.functions import ner
from recollect.functions.text import jaccard, word_set
from recollect.operators import consolidation, crud, dynamics, inspection, profile, retrieval, search, walk
from recollect.schema import LINKS, NODES
from recollect.sources.store import Conflict

NOW = 1_720_000_000
DAY = 86400


def nodes(spark, rows):
    """rows of dicts; missing columns get plain values."""
    base = {"content": "x", "node_type": "fact", "strength": 0.5, "created_at": NOW, "last_accessed": None, "access_count": 0, "decay_rate": 0.05, "entities": [], "outcome": None, "last_inspected": None, "inspection_verdict": None}
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in NODES) for r in rows], NODES)


def links(spark, rows):
    base = {"relation": "related_to", "weight": 0.3, "created_at": NOW, "last_traversed": None, "traverse_count": 0}
    return spark.createDataFrame([tuple({**base, "id": i + 1, **r}[f.name] for f in LINKS) for i, r in enumerate(rows)], LINKS)


def link(s, t, w, **more):
    return {"source_id": s, "target_id": t, "weight": w, **more}


# ---- entities


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("I like Kotlin and Haskell", ["Kotlin", "Haskell"]),
        ("I prefer Postgres over Oracle", ["PostgreSQL", "Oracle"]),
        ("the PyTorch framework is great for models", ["PyTorch", "models"]),
        ("We keep using Docker for caching", ["Docker", "cache"]),
        ("My favorite shell is Zsh", ["Zsh"]),
        ("Famous for careful release notes", ["careful release notes"]),
        ("", []),
        (" \t ", []),
        (None, []),
        ("nothing named in this line", []),
        ("我们推荐Docker和Kotlin", ["Docker", "Kotlin"]),
        ("那个排序的问题", ["排序"]),
        ("那个向量检索的方案", ["vector"]),
        ("rest api", ["REST API"]),
        ("memory system", ["memory system"]),
        ("It runs on Redis 7.2", ["Redis"]),
    ],
)
def test_entities(text, expected):
    found = [e.lower() for e in extract_entities(text)]
    assert all(any(f.startswith(e.lower()) for f in found) for e in expected)
    assert expected or not found


def test_segmenter_and_compounds():
    assert extract_entities("数据库设计", words=lambda t: ["数据库设计"]) == ["数据库设计"]  # only even prefixes are tried
    assert extract_entities("缓存性能", words=lambda t: ["缓存性能"]) == ["cache", "performance"]
    assert extract_implicit_references("刚才说的LLM架构") == ["LLM架构"]
    assert normalize_entity(" K8S ") == "Kubernetes"


def test_entities_column(spark):
    from recollect.functions.ner import entities_of, normalized

    df = spark.createDataFrame([("I like Python and Rust",), (None,)], "t string")
    assert [r[0] for r in df.select(entities_of(F.col("t"))).collect()] == [["Python", "Rust"], []]
    assert spark.range(1).select(normalized(F.lit(" Postgres "))).first()[0] == "PostgreSQL"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("I like use Python and over the MySQL project 3.12 v2 \"quoted 'x API CamelCase good great favorite docker known famous don't prefer 我喜欢 数据库设计 缓存性能 那个 的问题 「标题」 Redis的方案 pg rest api plain words , . \n É ſ".split(" ")), max_size=9).map(" ".join))
def test_texts_behind_the_gate_have_no_entities(text):
    gate = re.compile(ner.GATE.replace("(?iu:", "(?i:").replace(r"\p{Nd}", r"\d").replace("\\u4e00-\\u9fff", "一-鿿"))
    assert gate.search(text) or extract_entities(text) == []


# ---- changes


def test_two_writers_and_a_dead_one(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one, two = Memory.open(spark, path), Memory.open(spark, path)
    one.create_node("a", "one", now=NOW)
    two.create_node("b", "two", now=NOW)  # made again on the other's version
    assert [n["id"] for n in two.get_all_nodes()] == ["a", "b"] and one.count_nodes() == 1
    with pytest.raises(Conflict):
        one.commit(one.state)
    assert [n["id"] for n in Memory.open(spark, path).get_all_nodes()] == ["a", "b"]
    state = GraphState.load(spark, path)
    assert {state.save(path), state.save(path)} == {3, 4}  # no number twice
    (tmp_path / "store" / "v=00000005.claim").touch()  # a writer that died, or is at work
    with pytest.raises(Conflict):
        GraphState.load(spark, path).save(path, after=4)
    assert GraphState.load(spark, path).save(path, after=4, abandoned=-1) == 5 and GraphState.load(spark, path).version == 5


def test_memory_handle_persists(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with Memory.open(spark, path) as m:
        m.create_node("a", "one", "fact", now=NOW)
        m.create_node("b", "two", "preference", now=NOW)
        made = m.create_link("a", "b", now=NOW)
        assert made["id"] == 1 and made["relation"] == "related_to"
        assert m.delete_link(1) and not m.delete_link(1)
        assert m.create_link("a", "b", now=NOW)["id"] == 2  # ids are never used again
        m.create_session("s", NOW)
        m.increment_turns("s")
        m.increment_turns("nobody")
    with Memory.open(spark, path) as m:
        assert m.count_nodes() == 2 and m.count_links() == 1
        assert m.get_node("b")["decay_rate"] == 0.01
        assert m.state.sessions.first()["turn_count"] == 1
        with pytest.raises(ValueError):
            m.create_node("a", "again")
        with pytest.raises(ValueError):
            m.create_node("c", "x", "no such type")
        with pytest.raises(ValueError):
            m.create_link("a", "zz")
        with pytest.raises(ValueError):
            m.create_link("a", "b")
        assert m.update_node("a", strength=0.9, node_type="temp", nothing=1)["node_type"] == "fact"
        assert m.delete_node("b") and m.count_links() == 0 and not m.delete_node("b")


def test_find_by_entities_sees_the_strongest_only(spark):
    rows = [{"id": f"n{i:02}", "strength": 0.9, "entities": ["other"]} for i in range(50)] + [{"id": "weak", "strength": 0.1, "entities": ["Redis", "redis"]}]
    df = nodes(spark, rows)
    assert crud.find_by_entities(df, ["REDIS"]).count() == 0
    assert crud.find_by_entities(df, ["REDIS"], prelimit=None).first()["matched"] == ["Redis", "redis"]


def test_numbering_is_gapless(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v")
    got = crud.numbered(df, ["v"], 5).collect()
    assert sorted((r["v"], r["_id"]) for r in got) == [(i, i + 5) for i in range(1000)]


# ---- dynamics


def test_reinforcement_golden(spark):
    one = links(spark, [link("a", "b", 0.5)])
    for signal, want in ((0.0, 0.627148), (1.0, 0.674179), (-1.0, 0.651168)):
        one = dynamics.on_traverse(one, spark.createDataFrame([(1, signal)], "link_id long, signal double"), NOW)
        assert one.first()["weight"] == pytest.approx(want, abs=1e-9)
    uses = spark.createDataFrame([(1, 0.0, 1), (1, 1.0, 2), (1, -1.0, 3), (9, 1.0, 1)], "link_id long, signal double, seq int")
    folded = dynamics.on_traverse(links(spark, [link("a", "b", 0.5), link("b", "a", 0.4)]), uses, NOW).orderBy("id").collect()
    assert folded[0]["weight"] == pytest.approx(0.651168) and folded[0]["traverse_count"] == 3
    assert folded[1]["weight"] == 0.4 and folded[1]["last_traversed"] is None


def test_long_histories_need_their_last_uses_only(spark):
    """Folds from both ends of the range against folds of every use, with long, short and shuffled histories."""

    def step(w, signal):
        x = w + (0.1 if signal > 0 else -0.05 if signal < 0 else 0.02)
        from decimal import ROUND_HALF_EVEN, Decimal
        import math

        return float(Decimal(1 / (1 + math.exp(-x))).quantize(Decimal("0.000001"), ROUND_HALF_EVEN))

    rng = random.Random(21)
    weights = {k: rng.choice([0.0, 0.2, 0.5, 0.99]) for k in range(1, 60)}
    uses = [(k, float(rng.choice([-1, 0, 1])), i) for k in weights for i in range(rng.choice([0, 1, 3, 4, 5, 40, 300]))]
    want = dict(weights)
    for k, signal, _ in sorted(uses, key=lambda u: (u[0], u[2])):
        want[k] = step(want[k], signal)
    rng.shuffle(uses)
    rows = links(spark, [link("a", "b", w, id=k) for k, w in weights.items()])
    df = spark.createDataFrame(uses, "link_id long, signal double, seq long").repartition(5)
    for suffix in (1, 3, dynamics.SUFFIX):  # 1 and 3 seldom settle a weight at once
        got = {r["id"]: r["weight"] for r in dynamics.on_traverse(rows, df, NOW, suffix).collect()}
        assert got == pytest.approx(want, abs=1e-9), suffix


def test_a_link_with_very_many_uses(spark):
    uses = spark.range(20_000_000).select(F.lit(1).cast("long").alias("link_id"), ((F.col("id") % 3) - 1).cast("double").alias("signal"), F.col("id").alias("seq"))
    after = dynamics.on_traverse(links(spark, [link("a", "b", 0.5)]), uses, NOW)
    short = dynamics.on_traverse(links(spark, [link("a", "b", 0.123)]), uses.where("seq >= 19999700"), NOW).first()
    row = after.first()
    assert row["traverse_count"] == 20_000_000 and row["weight"] == short["weight"]
    plan = after._jdf.queryExecution().toString()
    assert "sequence" not in plan


def test_decay(spark):
    n = nodes(spark, [{"id": "a", "decay_rate": 0.1}, {"id": "b", "decay_rate": 0.01}])
    rows = [link("a", "b", 0.5, last_traversed=NOW - 30 * DAY), link("b", "a", 0.5, last_traversed=NOW - 30 * DAY), link("zz", "a", 0.5, last_traversed=0), link("b", "b", 0.5, last_traversed=0)]
    after, pruned = dynamics.daily_decay(GraphState.of(n, links(spark, rows)), NOW)
    left = {r["id"]: r["weight"] for r in after.links.collect()}
    assert pruned == 1 and left == {2: pytest.approx(0.5 * 0.99**30, abs=1e-6), 3: 0.5, 4: 0.5}


def test_sigmoid_is_stable(spark):
    got = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(dynamics.sigmoid(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0]


# ---- inspection


def test_inspection(spark):
    old = NOW - 60 * DAY
    rows = [
        {"id": "failed", "strength": 0.2, "created_at": old, "last_accessed": old, "outcome": "FAILURE"},
        {"id": "old", "strength": 0.15, "created_at": old, "last_accessed": old},
        {"id": "fresh", "strength": 0.9},
        {"id": "young", "strength": 0.01},
    ]
    state = GraphState.of(nodes(spark, rows), links(spark, [link("failed", "fresh", 0.5)]))
    after, report = inspection.run_inspection(state, NOW, dry_run=False)
    assert report.summary == {"keep": 2, "archive": 0, "prune": 1, "review": 1, "inspected": 2}
    scores = {r["id"]: r["prune_score"] for r in report.rows.collect()}
    assert scores["failed"] == pytest.approx(0.8133, abs=1e-4) and scores["old"] == pytest.approx(0.5933, abs=1e-4)
    assert after.nodes.where("id = 'failed'").first()["inspection_verdict"] == "prune"
    assert after.nodes.where("id = 'fresh'").first()["last_inspected"] is None
    assert inspection.apply_prune(after, report)[1] == 0
    left, n = inspection.apply_prune(after, report, confirm=False)
    assert n == 1 and left.nodes.count() == 3 and left.links.count() == 0


# ---- search


def corpus(spark):
    texts = ["Python is a programming language", "I like python for data science", "Redis caches data in memory", "café data bases", "nothing here, Python Python"]
    return nodes(spark, [{"id": f"n{i}", "content": t} for i, t in enumerate(texts)])


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("python", {"n0", "n1", "n4"}),
        ("data*", {"n1", "n2", "n3"}),
        ('"data science"', {"n1"}),
        ("data + science", {"n1"}),
        ("content: redis", {"n2"}),
        ("- content: redis", set()),
        ("node_type: fact", set()),
        ("CAFE", {"n3"}),
        ("python data", {"n1"}),
        ("python AND data", {"n1"}),
        ("redis OR café", {"n2", "n3"}),
        ("data NOT (python OR redis)", {"n3"}),
        ("^python", {"n0"}),
        ("NEAR(like science, 4)", {"n1"}),
        ("NEAR(like science, 1)", set()),
        ("none", set()),
        ("", set()),
        ("a.b", set()),
        ("here,", {"n4"}),
    ],
)
def test_search(spark, query, expected):
    assert {r["id"] for r in search.search(corpus(spark), query).collect()} == expected


def test_search_order_and_refresh(spark):
    df = corpus(spark)
    assert [r["id"] for r in search.search(df, "python").orderBy("place").collect()][0] == "n4"  # two hits
    index = search.build_index(df)
    changed = df.withColumn("content", F.when(F.col("id") == "n0", "redis").otherwise(F.col("content"))).where("id <> 'n2'")
    fresh = search.refresh_index(index, spark.createDataFrame([("n0",), ("n2",)], "id string"), changed)
    assert {r["node_id"] for r in search.bm25(fresh, "redis").collect()} == {"n0"}
    merged = search.merged_search(df, "redis", "memory redis")
    assert {r["id"] for r in merged.collect()} == {"n2"}


@pytest.mark.parametrize("bad", ["(", '"open', "a AND", "OR", "nope: x", "a )", "*"])
def test_bad_queries(bad):
    with pytest.raises(search.QueryError):
        search.parse(bad)


def test_automatic_links_see_the_strongest_at_their_time(spark):
    """The lists of strongest nodes against a model, however rows are dealt."""
    rng = random.Random(8)
    new = [(seq, f"x{i:03}", [rng.choice("pqrs") for _ in range(rng.randrange(0, 4))], [f"o{rng.randrange(9)}"], rng.choice([0.1, 0.5, 0.9])) for i, seq in enumerate(sorted(rng.randrange(60) for _ in range(150)))]
    old = [{"id": f"o{i}", "entities": [rng.choice("PQRS") for _ in range(2)], "strength": rng.choice([0.2, 0.5, 0.8])} for i in range(12)]
    held = [(-o["strength"], o["id"], o["entities"]) for o in old]
    want = set()
    for seq in sorted({r[0] for r in new}):
        mine = [r for r in new if r[0] == seq]
        held += [(-r[4], r[1], r[2]) for r in mine]
        best = sorted(held, key=lambda h: h[:2])[:6]
        for _, s, entities, linked, _ in mine:
            for _, t, theirs in best:
                n = sum(e.lower() in entities for e in theirs)
                if s != t and t not in linked and (n >= 2 or (n and n == len(entities))):
                    want.add((seq, s, t))
    rng.shuffle(new)
    df = spark.createDataFrame(new, "seq long, id string, entities array<string>, linked array<string>, strength double")
    for parts in (1, 9):
        got = retrieval.auto_links(df.repartition(parts), nodes(spark, old), 6)
        assert {tuple(r) for r in got.select("seq", "source_id", "target_id").collect()} == want and want, parts


# ---- walks


def chain(spark):
    return nodes(spark, [{"id": f"n{i}"} for i in (1, 2, 3)]), links(spark, [link("n1", "n2", 0.8), link("n2", "n3", 0.6)])


def test_walk_golden(spark):
    n, e = chain(spark)
    got = {tuple(r["node_ids"]): r["score"] for r in walk.walk_graph(n, e, "n1").collect()}
    assert got == {("n1",): 0.5, ("n1", "n2"): pytest.approx(0.17), ("n1", "n2", "n3"): pytest.approx(0.04335)}
    assert walk.walk_graph(n, e, "missing").count() == 0
    scored = walk.score_path(walk.walk_graph(n, e, "n1"), n, e, NOW).orderBy("place").collect()
    assert [r["path_score"] for r in scored] == [pytest.approx(r["score"]) for r in scored]


def model_walk(strength, edges, entries, hops, pre):
    """The rules, one path at a time."""
    visited, out = set(pre), []
    for entry in entries:
        if entry not in strength:
            continue
        paths = [([entry], [], strength[entry])]
        for _ in range(hops):
            new = []
            for ids, ls, score in paths:
                tip = ids[-1]
                ahead = sorted((e for e in edges if e[1] == tip), key=lambda e: (-e[3], e[0]))[:100] + sorted((e for e in edges if e[2] == tip), key=lambda e: (-e[3], e[0]))[:100]
                n_out = len(sorted((e for e in edges if e[1] == tip), key=lambda e: (-e[3], e[0]))[:100])
                for k, (i, s, t, w) in enumerate(ahead):
                    nbr = t if k < n_out else s
                    if nbr in visited or nbr not in strength:
                        continue
                    visited.add(nbr)
                    x = score * w * strength[nbr] * 0.85
                    if x >= 0.01 and nbr not in ids:
                        new.append(([*ids, nbr], [*ls, i], x))
            if not new:
                break
            paths += new
        paths.sort(key=lambda p: -p[2])
        out.append(paths)
    return out


def test_walks_follow_the_model(spark):
    rng = random.Random(5)
    for _ in range(2):
        strength = {f"n{i}": rng.choice([0.3, 0.6, 0.9, 1.0]) for i in range(14)}
        edges = [(i + 1, f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice([0.2, 0.5, 0.9, 1.0])) for i in range(30)]
        n, e = nodes(spark, [{"id": k, "strength": v} for k, v in strength.items()]), links(spark, [link(s, t, w, id=i) for i, s, t, w in edges])
        want = model_walk(strength, edges, ["n0"], 3, ["n0"])[0]
        got = walk.walk_graph(n, e, "n0", 3).orderBy("place").collect()
        assert [(r["node_ids"], r["link_ids"]) for r in got] == [(a, b) for a, b, _ in want]
        simple = {tuple(r["node_ids"]) for r in walk.simple_paths(n, e, spark.createDataFrame([("n0",)], "id string"), 3).collect()}
        assert {tuple(a) for a, _, _ in model_walk(strength, edges, ["n0"], 3, ["n0"])[0]} <= simple


def test_walks_that_share_their_nodes_follow_the_model(spark):
    """3,000 random graphs in one batch, each a query of its own with its own depth and entries."""
    rng = random.Random(17)
    strength, edges, entries, want = {}, [], [], {}
    for g in range(3000):
        n = rng.randrange(2, 12)
        name = lambda i: f"g{g}n{i:02}"  # noqa: E731, B023
        mine = {name(i): rng.choice([0.2, 0.6, 0.9, 1.0]) for i in range(n)}
        here = [(len(edges) + i + 1, name(rng.randrange(n)), name(rng.randrange(n)), rng.choice([0.04, 0.2, 0.5, 0.9, 1.0])) for i in range(rng.randrange(1, 3 * n))]
        starts, hops = [name(rng.randrange(n + 1)) for _ in range(rng.randrange(1, 5))], rng.randrange(0, 5)
        strength |= mine
        edges += here
        entries += [(g, 2 * k, x, hops) for k, x in enumerate(starts)]
        places = [2 * k for k, x in enumerate(starts) if x in mine]
        walks = model_walk(mine, [e for e in here if e[3] >= 0.05], starts, hops, [])
        want[g] = [(k, i, a, b) for k, paths in zip(places, walks, strict=True) for i, (a, b, _) in enumerate(paths)]
    n, e = nodes(spark, [{"id": k, "strength": v} for k, v in strength.items()]), links(spark, [link(s, t, w, id=i) for i, s, t, w in edges])
    rows = walk.walk_many(n, e, spark.createDataFrame(entries, "query_id int, place int, id string, hops int"), 4)
    got = {g: [] for g in want}
    for r in rows.orderBy("query_id", "entry_place", "walk_place").collect():
        got[r["query_id"]].append((r["entry_place"], r["walk_place"], r["node_ids"], r["link_ids"]))
    assert got == want
    assert sum(len(w) for w in want.values()) > 10_000


# ---- recall


def tiers(spark):
    rows = [("n1", "alpha topic", 0.8), ("n2", "alpha topic", 0.7), ("n3", "gamma", 0.6), ("n4", "delta", 0.6), ("n5", "epsilon", 0.4)]
    n = nodes(spark, [{"id": i, "content": c, "strength": s} for i, c, s in rows])
    return GraphState.of(n, links(spark, [link("n1", "n2", 0.8), link("n2", "n3", 0.7), link("n3", "n4", 0.9), link("n1", "n5", 0.3)]))


def test_tiers(spark):
    s = tiers(spark)
    got = {t: [(r["node_ids"], round(r["score"], 5)) for r in retrieval.retrieve(s, "alpha", top_k=10, tier=t).paths.orderBy("place").collect()] for t in retrieval.RecallTier}
    assert [p for p, _ in got[retrieval.RecallTier.WARM]] == [["n1"], ["n2"]]
    smoke = got[retrieval.RecallTier.SMOKE]
    assert smoke == [(["n1"], 0.8), (["n2"], 0.7), (["n1", "n2"], 0.3808), (["n2", "n1"], 0.3808), (["n2", "n3"], 0.2499)]
    burn = got[retrieval.RecallTier.BURN]
    assert burn[:3] == [(["n1"], 0.8), (["n2"], 0.7), (["n1", "n2"], 0.3808)] and (["n1", "n2", "n3"], 0.13595) in [(p, round(x, 5)) for p, x in burn] and (["n1", "n5"], 0.0816) in burn
    assert got[retrieval.RecallTier.INFERNO] == burn


def test_recall_branches(spark):
    n = nodes(spark, [{"id": "a", "content": "I use Redis", "entities": ["Redis"], "strength": 0.9}, {"id": "b", "content": "plain", "strength": 0.5}])
    s = GraphState.of(n, links(spark, [link("a", "b", 0.9)]))
    deep = retrieval.retrieve(s, "I use Redis")
    assert deep.branch == "entity walk" and deep.reinforce
    after = {r["id"]: r for r in deep.reinforced(s.links, NOW).collect()}
    assert after[1]["traverse_count"] == 1 and after[1]["weight"] == pytest.approx(0.715, abs=1e-3)
    assert retrieval.retrieve(s, "I use Docker").branch == "strength"
    assert retrieval.retrieve(s, "").branch == "strength"
    assert retrieval.retrieve(s, "plain", top_k=0).branch == "text walk"
    first, second = retrieval.to_dicts(s, deep.paths)
    assert {k: first[k] for k in ("content", "path", "node_ids", "link_ids", "score")} == {"content": "I use Redis", "path": "a", "node_ids": ["a"], "link_ids": [], "score": 0.9}
    assert second["path"] == "a → b" and second["content"] == "I use Redis → plain" and [n["strength"] for n in second["nodes"]] == [0.9, 0.5] and second["nodes"][1]["entities"] == []


def test_a_batch_goes_the_ways_of_its_queries(spark):
    rng = random.Random(8)
    words = "redis caches data plain alpha topic gamma docker python memory".split()
    rows = [{"id": f"n{i:02}", "content": " ".join(rng.choice(words) for _ in range(5)), "strength": rng.choice([0.1, 0.25, 0.4, 0.6, 0.9]), "entities": rng.sample(["Redis", "redis", "Python", "SQLite"], rng.randrange(3))} for i in range(40)]
    edges = [link(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}", rng.choice([0.3, 0.6, 0.9]), relation=f"r{i}") for i in range(90)]
    s = GraphState.of(nodes(spark, rows), links(spark, edges))
    asked = [(t.name if k % 2 else t.value, q) for k, t in enumerate(retrieval.RecallTier) for q in ("redis", "I use Redis and Python", "alpha OR topic", '"data plain"', "py* NOT redis", "^ redis", "NEAR(redis data, 2)", "", "content: gamma", "( data", ", d", "I use Docker", "XYZZY", "none of it")]
    queries = [(i, q, t, None, None, None) for i, (t, q) in enumerate(asked)] + [(900, "I use Redis", "?", 2, 1, 0.5), (901, "redis", None, 0, 0, 0.9), (902, None, "SMOKE", 7, None, None)]
    df = spark.createDataFrame(queries, "query_id int, query string, tier string, top_k int, max_hops int, min_node_strength double")
    index = search.build_index(s.nodes)
    got = {}
    for r in retrieval.retrieve_many(s, df, index).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["branch"], r["place"], tuple(r["node_ids"]), tuple(r["link_ids"]), round(r["score"], 9), r["reinforce"]))
    tiers = {t.name: t for t in retrieval.RecallTier} | {t.value: t for t in retrieval.RecallTier}
    ways = set()
    for i, q, t, k, hops, least in queries[::7] + queries[-3:] + queries[25:27]:
        one = retrieval.retrieve(s, q or "", k, tiers.get(t, retrieval.RecallTier.BURN), hops, least, index)
        want = [(one.branch, r["place"], tuple(r["node_ids"]), tuple(r["link_ids"]), round(r["score"], 9), one.reinforce) for r in one.paths.orderBy("place").collect()]
        assert got.get(i, []) == want, (q, t)
        ways.add(one.branch)
    assert ways == {"text", "text walk", "entity walk", "strength"}
    assert retrieval.retrieve_many(s, df.where("false")).count() == 0


def test_chinese_branch(spark):
    cut = lambda t: [w for w in ("缓存", "性能", "记忆", "设计") if w in t]
    m = Memory.open(spark, segment=cut)
    a = m.create_node("a", "缓存性能很好", now=NOW)
    m.create_node("b", "记忆设计", now=NOW)
    assert [n["id"] for n in m.fts5_search("性能问题")] == ["a"] and m.fts5_search("性能问题")[0] == a
    assert search.search(m.state.nodes, "性能问题").count() == 0  # whole runs only, without a segmenter
    assert [n["id"] for n in m.fts5_search("记忆设计")] == ["b"]
    assert retrieval.memory_recall(m, "性能", tier="温")[0]["path"] == "a"
    from recollect.functions.ner import entities_of

    texts = spark.createDataFrame([("缓存性能",), ("no Chinese",), (None,)], "t string")
    assert [r[0] for r in texts.select(entities_of(F.col("t"), lambda t: [t])).collect()] == [["cache", "performance"], [], []]
    done = retrieval.write_memories(GraphState.empty(spark), spark.createDataFrame([(0, "x", "缓存性能")], "seq long, id string, content string"), NOW, segment=lambda t: [t])
    assert done.nodes.first()["entities"] == ["cache", "performance"]


def test_reading_through_the_handle(spark):
    m = Memory(GraphState.of(nodes(spark, [{"id": "a", "content": "I use Redis", "entities": ["Redis"], "strength": 0.9}, {"id": "b", "node_type": "temp", "entities": None}]), links(spark, [link("a", "b", 0.9), link("b", "a", 0.2)])))
    assert [n["id"] for n in m.get_all_nodes()] == ["a", "b"] and [x["weight"] for x in m.get_all_links(1)] == [0.9]
    assert [n["id"] for n in m.search_nodes("temp")] == ["b"] and m.search_nodes("temp")[0]["entities"] == []
    assert [(n["id"], e) for n, e in m.find_nodes_by_entities(["REDIS"])] == [("a", ["Redis"])] and m.find_nodes_by_entities([]) == []
    assert [x["target_id"] for x in m.get_links("a", direction="outgoing")] == ["b"]
    assert [n["id"] for n in m.fts5_search("redis")] == ["a"] and list(m.get_node("a")) == [f.name for f in NODES]


def test_automatic_links_look_at_the_strongest_as_they_are_then(spark):
    rng = random.Random(4)
    names = ["Redis", "Python", "SQLite", "Docker"]
    old = [{"id": f"o{i}", "strength": rng.random(), "entities": rng.sample(names, 2)} for i in range(8)]
    new = [(i // 2, f"n{i:02}", rng.sample(names, rng.randrange(1, 4)), rng.random(), ["o1"]) for i in range(60)]
    df = spark.createDataFrame(new, "seq long, id string, entities array<string>, strength double, linked array<string>").repartition(5)
    got = {(r["source_id"], r["target_id"]) for r in retrieval.auto_links(df, nodes(spark, old), 6).collect()}
    want = set()
    for seq, i, entities, _, linked in new:
        pool = [(-o["strength"], o["id"], o["entities"]) for o in old] + [(-x[3], x[1], x[2]) for x in new if x[0] <= seq]
        for _, t, theirs in sorted(pool)[:6]:
            n = len([e for e in theirs if e in entities])
            if t != i and t not in linked and (n >= 2 or (n and n == len(entities))):
                want.add((i, t))
    assert got == want and len(want) > 20


def test_writing_and_wrappers(spark):
    m = Memory.open(spark)
    a = retrieval.memory_write(m, "I like Python and Redis", "preference", now=NOW)
    b = retrieval.memory_write(m, "I use Python and Redis", link_to=[a["id"], "missing"], now=NOW)
    c = retrieval.memory_write(m, "I love Redis and Python", now=NOW)
    kinds = {(r["source_id"], r["target_id"]): r["relation"] for r in m.state.links.collect()}
    assert kinds == {(b["id"], a["id"]): "inspired_by", (c["id"], a["id"]): "related_to", (c["id"], b["id"]): "related_to"}
    retrieval.memory_link(m, a["id"], b["id"], "extends", 0.8, now=NOW)
    assert retrieval.memory_recall(m, "I like Redis", tier="?", now=NOW)
    batch = spark.createDataFrame([(0, "x", "I like Python and Redis"), (1, "y", "I like Redis and Python")], "seq long, id string, content string")
    done = retrieval.write_memories(GraphState.empty(spark), batch, NOW)
    assert [(r["source_id"], r["target_id"]) for r in done.links.collect()] == [("y", "x")]


# ---- consolidation


def test_similarity(spark):
    row = spark.range(1).select(jaccard(word_set(F.lit("Python's great, for data!")), word_set(F.lit("pythons great data"))).alias("x"), jaccard(word_set(F.lit("a")), word_set(F.lit("b"))).alias("y")).first()
    assert row["x"] == 1.0 and row["y"] == 0.0


def test_consolidation(spark):
    rows = [
        {"id": "n1", "content": "Python is great for data science projects", "strength": 0.7, "entities": ["Python", "data science"]},
        {"id": "n2", "content": "Python is so good for data science projects", "strength": 0.5, "entities": ["python", "Data Science"]},
        {"id": "n3", "content": "completely different words", "strength": 0.6},
        {"id": "n4", "content": "another memory altogether", "strength": 0.9},
    ]
    e = links(spark, [link("n2", "n3", 0.5), link("n1", "n2", 0.4), link("n4", "gone", 0.4)])
    s = GraphState.of(nodes(spark, rows), e)
    same, dry = consolidation.run_consolidation(s)
    assert dry.nodes_merged == 1 and dry.nodes_deleted == 1 and same is s
    after, report = consolidation.run_consolidation(s, dry_run=False)
    kept = {r["id"]: r for r in after.nodes.collect()}
    assert set(kept) == {"n1", "n3", "n4"} and kept["n1"]["strength"] == pytest.approx(0.8)
    assert kept["n1"]["content"] == "Python is so good for data science projects | Python is great for data science projects"
    assert {(r["source_id"], r["target_id"]) for r in after.links.collect()} == {("n1", "n3")}
    assert report.links_pruned == 1
    looped, _ = consolidation.run_consolidation(s, dry_run=False, allow_self_loops=True)
    assert ("n1", "n1") in {(r["source_id"], r["target_id"]) for r in looped.links.collect()}


def test_merge_map_is_the_greedy_pass(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    rows = [{"id": f"n{i:02}", "content": " ".join(rng.sample(words, 6)), "strength": rng.choice([0.2, 0.5, 0.8])} for i in range(40)]
    rows += [{**r, "id": f"c{i:02}", "strength": rng.choice([0.2, 0.5, 0.8, 0.9])} for i, r in enumerate(rows[:15])]  # copies
    df = nodes(spark, rows)
    order = [r["id"] for r in sorted(rows, key=lambda r: (-r["strength"], r["id"]))]
    rep_of = {r["id"]: r["rep"] for r in consolidation.members(df).collect()}
    classes = {}
    for i in order:
        classes.setdefault(frozenset(next(r["content"] for r in rows if r["id"] == i).split()), []).append(i)
    assert rep_of == {i: c[0] for c in classes.values() for i in c}
    found = {(r["a"], r["b"]) for r in consolidation.duplicate_pairs(df).collect()}
    assert all(rep_of[x] == x for p in found for x in p) and len(found) < 200
    place = {i: k for k, i in enumerate(order)}
    pairs = {(a, b) for a in order for b in order if place[a] < place[b] and (rep_of[a] == rep_of[b] or (rep_of[a], rep_of[b]) in found or (rep_of[b], rep_of[a]) in found)}
    sets = {r["id"]: set(r["content"].split()) for r in rows}
    brute = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert pairs == brute
    into = {}
    for i, a in enumerate(order):
        if a not in into:
            for b in order[i + 1 :]:
                if b not in into and (a, b) in pairs:
                    into[b] = a
    got = {r["victim_id"]: r["survivor_id"] for r in consolidation.merges(df).collect()}
    assert got == into and not set(into) & set(into.values())


# ---- profile


def test_profile(spark):
    assert profile.generate_profile(nodes(spark, [{"id": "a", "strength": 0.1}])) == ""
    assert profile.generate_summary_line(nodes(spark, [{"id": "a", "strength": 0.1}])) == ""
    rows = [
        {"id": "p", "content": "likes tea ", "node_type": "preference", "strength": 0.9},
        {"id": "f", "content": "f" * 200, "strength": 0.8},
        {"id": "t", "content": "temporary", "node_type": "temp", "strength": 0.95},
        {"id": "v", "content": "vetoed", "strength": 0.9, "inspection_verdict": "prune"},
        {"id": "q", "content": "process", "node_type": "process", "strength": 0.9},
    ]
    text = profile.generate_profile(nodes(spark, rows))
    assert text == "## User Profile\n\n**Preferences**:\n- likes tea\n\n**Known facts**:\n- " + "f" * 147 + "...\n"
    assert profile.generate_profile(nodes(spark, rows), max_chars=40) == "## User Profile\n\n**Preferences**:\n- likes tea\n"
    assert profile.generate_summary_line(nodes(spark, rows)) == "[Profile: 1 preferences, 1 facts | Top: likes tea ]"


def test_only_prefixes_of_word_sets_are_kept(spark):
    from recollect.operators import consolidation

    rows = spark.createDataFrame([("a", ["x", "y", "common", "often"]), ("b", ["z", "common", "often"])], "id string, words array<string>")
    ranked = consolidation._ranked(rows.selectExpr("*", "size(words) AS size"), 0.8).collect()
    assert sorted((r["id"], r["w"], r["r"]) for r in ranked) == [("a", "x", 1), ("b", "z", 1)]


def test_classes_of_duplicates_cut_texts_once(spark):
    found = consolidation.members(nodes(spark, [{"id": f"n{i}", "content": f"alpha beta {'gamma' if i % 2 else 'delta'}"} for i in range(4)]))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()  # both sides of the join read a table
    assert {(r["id"], r["rep"]) for r in found.collect()} == {("n0", "n0"), ("n1", "n1"), ("n2", "n0"), ("n3", "n1")}


def test_similar_pairs_meet_in_chunks_whatever_their_codes(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"word{i:02}" for i in range(30)]
    sets = [rng.sample(words, rng.randrange(1, 14)) for _ in range(70)]
    sets += [[w for w in s if rng.random() > 0.1] or s for s in sets]
    df = nodes(spark, [{"id": f"n{i:03}", "content": " ".join(s), "strength": rng.choice([0.2, 0.8])} for i, s in enumerate(sets)])
    reps = {r["rep"] for r in consolidation.members(df).collect()}
    of = {f"n{i:03}": set(s) for i, s in enumerate(sets)}
    brute = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a in reps for b in reps if a < b}
    brute = {k: round(v, 9) for k, v in brute.items() if v >= 0.6}
    for most, known in ((1 << 14, 1000), (16, 1000), (16, 3)):  # many chunks; few words that have a code of their own
        monkeypatch.setattr(consolidation, "CHUNK_SETS", most)
        monkeypatch.setattr(consolidation, "VOCABULARY", known)
        found = consolidation.similar_pairs(df).collect()
        assert {(*sorted((r["a"], r["b"])),): round(r["similarity"], 9) for r in found} == brute and len(found) == len(brute)


def test_similar_pairs_shuffle_sets_and_no_prefixes(spark):
    plan = consolidation._near(*[spark.createDataFrame([("a", "fact", (0.0, "a"), ["x", "y"], [], 2)], "id string, node_type string, place struct<s: double, i: string>, words array<string>, ents array<string>, size int")] * 2, 0.6)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "MapInArrow" in text  # candidates are made within tasks
