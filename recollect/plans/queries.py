"""Queries over the test tables, one or more for each operator, with their SQL twins.

``QUERIES[name](spark, sf_dir)`` builds a DataFrame, ``SQL[name]`` is DuckDB SQL for the
same rows. A query without SQL depends on order (folds, ordered walks) or on Python's
regular expressions; tests hold it against independent models instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ner
from ..functions.text import search_tokens
from ..operators import consolidation, crud, dynamics, inspection, profile, retrieval, search, walk
from ..sources import fixtures
from ..sources.fixtures import NOW
from ..sources.store import Memory, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = f"WITH RECURSIVE {fixtures.SQL.strip()}{sql}" if not sql.lstrip().startswith("SELECT") else f"WITH {fixtures.SQL.strip()}\n{sql}"
        return f

    return add


def _six(c) -> F.Column:
    return F.round(c, 6)


# ---- scans and filters


@_query("SELECT id, strength FROM nodes ORDER BY strength DESC, id LIMIT 1000")
def node_scan_topk(spark, sf_dir):
    return crud.all_nodes(fixtures.nodes(spark, sf_dir), 1000).select("id", "strength")


@_query("SELECT id, weight FROM links ORDER BY weight DESC, id LIMIT 5000")
def link_scan_topk(spark, sf_dir):
    return crud.all_links(fixtures.links(spark, sf_dir), 5000).select("id", "weight")


@_query("SELECT id, content, node_type, strength FROM nodes WHERE node_type = 'fact' AND strength >= 0.5 ORDER BY strength DESC, id LIMIT 50")
def search_nodes_type_strength(spark, sf_dir):
    return crud.search_nodes(fixtures.nodes(spark, sf_dir), "fact", 0.5).select("id", "content", "node_type", "strength")


@_query("SELECT id, strength, entities[2] AS source FROM nodes WHERE id = 'd7'")
def node_by_id(spark, sf_dir):
    return crud.node_by_id(fixtures.nodes(spark, sf_dir), "d7").select("id", "strength", F.col("entities")[1].alias("source"))


@_query("SELECT id, source_id, target_id, weight FROM links WHERE id = 15")
def link_by_id(spark, sf_dir):
    return crud.link_by_id(fixtures.links(spark, sf_dir), 15).select("id", "source_id", "target_id", "weight")


for _name, _condition in (("outgoing", "source_id = 'd7'"), ("incoming", "target_id = 'd7'"), ("both", "(source_id = 'd7' OR target_id = 'd7')")):

    @_query(f"SELECT id, source_id, target_id, relation, weight FROM links WHERE weight >= 0.3 AND {_condition} ORDER BY weight DESC, id LIMIT 100", f"links_{_name}")
    def _links(spark, sf_dir, direction=_name):
        return crud.get_links(fixtures.links(spark, sf_dir), "d7", min_weight=0.3, direction=direction).select("id", "source_id", "target_id", "relation", "weight")


@_query("SELECT id, source_id, target_id FROM links WHERE relation = 'contradicts' AND weight >= 0.5 ORDER BY weight DESC, id LIMIT 100")
def links_relation(spark, sf_dir):
    return crud.get_links(fixtures.links(spark, sf_dir), relation="contradicts", min_weight=0.5).select("id", "source_id", "target_id")


@_query("SELECT id FROM nodes WHERE content ILIKE '%Th_nd%' OR entities[1] ILIKE '%Th_nd%' OR entities[2] ILIKE '%Th_nd%' ORDER BY id LIMIT 20")
def like_fallback(spark, sf_dir):
    return search.like_search(fixtures.nodes(spark, sf_dir), "Th_nd").select("id")


@_query("SELECT id FROM nodes WHERE content ILIKE '%, the%' OR entities[1] ILIKE '%, the%' OR entities[2] ILIKE '%, the%' ORDER BY id LIMIT 20")
def search_falls_back(spark, sf_dir):
    """A text that is no query."""
    return search.search(fixtures.nodes(spark, sf_dir), ", the").select("id")


# ---- changes


@_query(
    f""", new AS (
  SELECT 'd' || (doc_id * 2) AS id, text AS content, doc_id AS seq,
         CASE doc_id % 5 WHEN 0 THEN 'bogus' WHEN 1 THEN 'temp' ELSE 'fact' END AS node_type FROM documents)
SELECT id, content, node_type, strength, decay_rate, created_at FROM nodes
UNION ALL
SELECT id, content, node_type, 0.5, CASE node_type WHEN 'temp' THEN 0.10 ELSE 0.05 END, {NOW}
FROM new WHERE node_type <> 'bogus' AND id NOT IN (SELECT id FROM nodes)"""
)
def node_insert_dedup(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 5 == 0, "bogus").when(F.col("doc_id") % 5 == 1, "temp").otherwise("fact")
    new = fixtures.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id") * 2).alias("id"), F.col("text").alias("content"), F.col("doc_id").alias("seq"), kind.alias("node_type"))
    return crud.create_nodes(fixtures.state(spark, sf_dir), new, NOW).nodes.select("id", "content", "node_type", "strength", "decay_rate", "created_at")


@_query(
    f"""SELECT id, CASE WHEN access_count = 3 THEN 0.9 ELSE strength END AS strength,
       CASE WHEN access_count <> 3 THEN outcome END AS outcome,
       CASE WHEN access_count = 3 THEN {NOW} ELSE last_accessed END AS last_accessed FROM nodes"""
)
def node_update(spark, sf_dir):
    state = fixtures.state(spark, sf_dir)
    ids = state.nodes.where("access_count = 3").select("id")
    after = crud.update_nodes(state, ids, {"strength": 0.9, "outcome": None, "last_accessed": NOW, "entities": None, "no_such": 1})
    return after.nodes.select("id", "strength", "outcome", "last_accessed")


@_query(", gone AS (SELECT id FROM nodes WHERE access_count = 4)\nSELECT id, source_id, target_id FROM links WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def node_delete_cascade(spark, sf_dir):
    state = fixtures.state(spark, sf_dir)
    return crud.delete_nodes(state, state.nodes.where("access_count = 4").select("id")).links.select("id", "source_id", "target_id")


@_query(
    f""", new AS (
  SELECT 'd' || doc_id AS source_id, 'd' || (doc_id * 3) AS target_id, doc_id AS seq,
         CASE doc_id % 4 WHEN 0 THEN 'no_such' WHEN 1 THEN 'extends' ELSE 'related_to' END AS relation FROM documents),
ok AS (
  SELECT n.*, row_number() OVER (ORDER BY seq, source_id, target_id, relation) AS place FROM new n
  WHERE relation <> 'no_such' AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)
    AND NOT EXISTS (SELECT 1 FROM links l WHERE l.source_id = n.source_id AND l.target_id = n.target_id AND l.relation = n.relation))
SELECT CAST({1 << 40} + place - 1 AS BIGINT) AS id, source_id, target_id, relation, 0.3 AS weight FROM ok"""
)
def link_insert_valid(spark, sf_dir):
    state = fixtures.state(spark, sf_dir)
    i = F.col("doc_id")
    relation = F.when(i % 4 == 0, "no_such").when(i % 4 == 1, "extends").otherwise("related_to")
    new = fixtures.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), i).alias("source_id"), F.concat(F.lit("d"), i * 3).alias("target_id"), i.alias("seq"), relation.alias("relation"))
    after = crud.create_links(state, new, NOW)
    return after.links.where(F.col("id") >= 1 << 40).select("id", "source_id", "target_id", "relation", "weight")


@_query("SELECT id, CASE WHEN relation = 'extends' THEN 0.75 ELSE weight END AS weight, CAST(CASE WHEN relation = 'extends' THEN 1 ELSE 0 END AS BIGINT) AS traverse_count FROM links")
def link_update(spark, sf_dir):
    state = fixtures.state(spark, sf_dir)
    ids = state.links.where("relation = 'extends'").select("id")
    return crud.update_links(state, ids, {"weight": 0.75, "traverse_count": 1, "relation": "contradicts"}).links.select("id", "weight", "traverse_count")


@_query("SELECT id FROM links WHERE relation <> 'extends'")
def link_delete(spark, sf_dir):
    state = fixtures.state(spark, sf_dir)
    return crud.delete_links(state, state.links.where("relation = 'extends'").select("id")).links.select("id")


@_query(
    f""", s AS (SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY 1)
SELECT id, CAST({NOW} AS BIGINT) AS started_at, CASE WHEN users > 2 THEN CAST({NOW + 60} AS BIGINT) END AS ended_at, n AS turn_count FROM s"""
)
def session_turns(spark, sf_dir):
    from ..sources.store import GraphState

    turns = fixtures.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), "role")
    state = crud.create_sessions(GraphState.empty(spark), turns, NOW)
    state = crud.increment_turns(state, turns)
    done = turns.where("role = 'user'").groupBy("id").count().where("count > 2").select("id")
    return crud.end_sessions(state, done, NOW + 60).sessions


# ---- entities


@_query(
    """, top AS (SELECT * FROM nodes WHERE strength >= 0.2 ORDER BY strength DESC, id LIMIT 50),
m AS (SELECT id, strength, CAST(lower(entities[1]) = 'en' AS INT) + CAST(lower(entities[2]) = 'src1' AS INT) AS n_matched FROM top)
SELECT id, strength, n_matched FROM m WHERE n_matched > 0"""
)
def entity_overlap_topk(spark, sf_dir):
    found = crud.find_by_entities(fixtures.nodes(spark, sf_dir), ["EN", "src1"], 0.2)
    return found.select("id", "strength", F.size("matched").alias("n_matched"))


_ITEMS = ", items AS (SELECT item_id AS query_id, ['EN', 'src' || (item_id % 20)] AS entities FROM benchmark)"


def _items(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.lit("EN"), F.concat(F.lit("src"), F.col("item_id") % 20)).alias("entities"))


@_query(
    _ITEMS
    + """
SELECT query_id, id, CAST(CAST(n.entities[1] = 'en' AS INT) + CAST(n.entities[2] = i.entities[2] AS INT) AS BIGINT) AS n_matched
FROM items i, nodes n WHERE n.entities[1] = 'en' OR n.entities[2] = i.entities[2]"""
)
def entity_matches_batch(spark, sf_dir):
    return crud.entity_matches(_items(spark, sf_dir), fixtures.nodes(spark, sf_dir))


@_query(
    _ITEMS
    + """, top AS (SELECT * FROM nodes ORDER BY strength DESC, id LIMIT 50)
SELECT 'b' || query_id AS source_id, id AS target_id FROM items i, top n WHERE n.entities[1] = 'en' AND n.entities[2] = i.entities[2]"""
)
def auto_links(spark, sf_dir):
    new = _items(spark, sf_dir).select(F.col("query_id").alias("seq"), F.concat(F.lit("b"), "query_id").alias("id"), "entities", F.array().cast("array<string>").alias("linked"), F.lit(0.0).alias("strength"))
    found = retrieval.auto_links(new, fixtures.nodes(spark, sf_dir)).where("target_id LIKE 'd%'")
    return found.select("source_id", "target_id")


@_query(
    _ITEMS
    + """
SELECT 'b' || query_id AS source_id, id AS target_id FROM items i, nodes n WHERE n.entities[1] = 'en' AND n.entities[2] = i.entities[2]
UNION ALL
SELECT 'b' || a.query_id, 'b' || b.query_id FROM items a, items b WHERE b.query_id < a.query_id AND a.entities[2] = b.entities[2]"""
)
def auto_links_exhaustive(spark, sf_dir):
    new = _items(spark, sf_dir).select(F.col("query_id").alias("seq"), F.concat(F.lit("b"), "query_id").alias("id"), "entities", F.array().cast("array<string>").alias("linked"))
    return retrieval.auto_links(new, fixtures.nodes(spark, sf_dir), None).select("source_id", "target_id")


@_query(
    """, given AS (SELECT * FROM (VALUES ('postgresql'), (' PG database '), ('数据库'), ('redis cache'), ('K8s'), ('unknown thing '), ('大模型'), ('Rest')) t(alias)),
names AS (SELECT * FROM (VALUES ('postgresql', 'PostgreSQL'), ('pg database', 'PostgreSQL'), ('数据库', 'DB'), ('redis cache', 'Redis'), ('k8s', 'Kubernetes'), ('大模型', 'LLM'), ('rest', 'REST API')) t(k, v))
SELECT alias, coalesce(v, trim(alias)) AS entity FROM given LEFT JOIN names ON lower(trim(alias)) = k"""
)
def synonym_normalize(spark, sf_dir):
    given = ["postgresql", " PG database ", "数据库", "redis cache", "K8s", "unknown thing ", "大模型", "Rest"]
    return spark.createDataFrame([(g,) for g in given], "alias string").select("alias", ner.normalized(F.col("alias")).alias("entity"))


@_query()
def ner_entities(spark, sf_dir):
    """Entities of every document, whole texts."""
    docs = fixtures.table(spark, sf_dir, "documents")
    return docs.select("doc_id", ner.entities_of(F.col("text")).alias("entities"))


@_query(
    """SELECT 'm' || item_id AS source_id, 'd' || (item_id * 30) AS target_id, 'inspired_by' AS relation, 0.4 AS weight
FROM benchmark WHERE 'd' || (item_id * 30) IN (SELECT id FROM nodes)"""
)
def write_explicit_links(spark, sf_dir):
    """Benchmark items written as memories, each linked to a document that may be missing."""
    i = F.col("item_id")
    new = fixtures.table(spark, sf_dir, "benchmark").select(i.alias("seq"), F.concat(F.lit("m"), i).alias("id"), F.col("text").alias("content"), F.array(F.concat(F.lit("d"), i * 30), F.lit("nowhere")).alias("link_to"))
    after = retrieval.write_memories(fixtures.state(spark, sf_dir), new, NOW, auto_entities=False)
    return after.links.where("source_id LIKE 'm%'").select("source_id", "target_id", "relation", "weight")


# ---- counts and ranks


@_query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM links) AS links")
def counts(spark, sf_dir):
    n = fixtures.nodes(spark, sf_dir).agg(F.count("*").alias("nodes"))
    return n.join(fixtures.links(spark, sf_dir).agg(F.count("*").alias("links")), F.lit(True))


@_query("SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type")
def type_counts(spark, sf_dir):
    return fixtures.nodes(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"))


@_query(
    """, e AS (
  SELECT source_id AS node_id, 'outgoing' AS direction, id, weight FROM links WHERE weight >= 0.05
  UNION ALL SELECT target_id, 'incoming', id, weight FROM links WHERE weight >= 0.05),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY weight DESC, id) AS place FROM e)
SELECT node_id, direction, id, CAST(place AS INT) AS place FROM r WHERE place <= 3"""
)
def topk_links_per_node(spark, sf_dir):
    return crud.top_links_per_node(fixtures.links(spark, sf_dir), 0.05, 3).select("node_id", "direction", "id", "place")


# ---- full-text search


_TOK = r""", split AS (
  SELECT id, regexp_split_to_array(lower(strip_accents(content)), '[^\p{L}\p{N}\p{Co}]+') AS t FROM nodes),
tok AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM split),
len AS (SELECT id, count(*) FILTER (term <> '') AS dl FROM tok GROUP BY id),
"""


def _fts_sql(counts: list[str], holds: str) -> str:
    """BM25 over the given per-node counts (subqueries of id, c)."""
    tables = "".join(f"c{k} AS ({c}),\n" for k, c in enumerate(counts))
    joins = " ".join(f"LEFT JOIN c{k} ON c{k}.id = len.id" for k in range(len(counts)))
    columns = ", ".join(f"coalesce(c{k}.c, 0) AS t{k}" for k in range(len(counts)))
    part = "greatest(ln((s.n - (SELECT count(*) FROM c{k}) + 0.5) / ((SELECT count(*) FROM c{k}) + 0.5)), 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * dl / s.mean))"
    score = " + ".join(part.format(k=k) for k in range(len(counts)))
    return f"""{_TOK}{tables}s AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM len),
w AS (SELECT len.id, dl, {columns} FROM len {joins})
SELECT w.id, round({score}, 6) AS score FROM w, s WHERE {holds}"""


def _term_sql(condition: str) -> str:
    return f"SELECT id, count(*) AS c FROM tok WHERE {condition} GROUP BY id"


_PHRASE_SQL = "SELECT a.id, count(*) AS c FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.id"

for _name, _text, _counts, _holds in (
    ("fts_term", "hation", [_term_sql("term = 'hation'")], "t0 > 0"),
    ("fts_and", "the hation", [_term_sql("term = 'the'"), _term_sql("term = 'hation'")], "t0 > 0 AND t1 > 0"),
    ("fts_or_not", "(hation OR enti) NOT with", [_term_sql("term = 'hation'"), _term_sql("term = 'enti'"), _term_sql("term = 'with'")], "(t0 > 0 OR t1 > 0) AND t2 = 0"),
    ("fts_prefix", "thin*", [_term_sql("term LIKE 'thin%'")], "t0 > 0"),
    ("fts_phrase", '"of the"', [_PHRASE_SQL], "t0 > 0"),
    ("fts_plus", "of + the", [_PHRASE_SQL], "t0 > 0"),
    ("fts_near", "NEAR(of the, 3)", [_term_sql("term = 'of'"), _term_sql("term = 'the'")], "w.id IN (SELECT a.id FROM tok a JOIN tok b ON a.id = b.id WHERE a.term = 'of' AND b.term = 'the' AND abs(b.pos - a.pos) <= 4)"),
    ("fts_column", "content: ÉEAU", [_term_sql("term = 'eeau'")], "t0 > 0"),
    ("fts_first", "^ the", ["SELECT id, count(*) AS c FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM tok WHERE term <> '') WHERE r = 1 AND term = 'the' GROUP BY id"], "t0 > 0"),
):

    @_query(_fts_sql(_counts, _holds), _name)
    def _fts(spark, sf_dir, text=_text):
        return search.bm25(fixtures.index(spark, sf_dir), text).select(F.col("node_id").alias("id"), _six("score").alias("score"))


_AFTER = ", after AS (SELECT id, CASE WHEN access_count = 2 THEN 'hation again' ELSE content END AS content FROM nodes WHERE access_count <> 3)"


@_query(_AFTER + _fts_sql([_term_sql("term = 'hation'")], "t0 > 0").replace("FROM nodes)", "FROM after)"))
def fts_refreshed(spark, sf_dir):
    """The index after some nodes were rewritten and others deleted."""
    nodes = fixtures.nodes(spark, sf_dir)
    after = nodes.where("access_count <> 3").withColumn("content", F.when(F.col("access_count") == 2, "hation again").otherwise(F.col("content")))
    index = search.refresh_index(search.build_index(nodes), nodes.where("access_count IN (2, 3)").select("id"), after)
    return search.bm25(index, "hation").select(F.col("node_id").alias("id"), _six("score").alias("score"))


_STORED = """, after AS (
  SELECT id, CASE WHEN access_count = 2 THEN 'hation again' ELSE content END AS content FROM nodes WHERE access_count <> 3
  UNION ALL SELECT 'new ' || id, 'hation anew ' || content FROM nodes WHERE access_count = 4)"""


@_query(_STORED + _fts_sql([_term_sql("term = 'hation'"), _term_sql("term = 'again'")], "t0 > 0 OR t1 > 0").replace("FROM nodes)", "FROM after)"))
def fts_store_refreshed(spark, sf_dir):
    """A store's index after nodes were rewritten, deleted and added: a segment a change, and a merge."""
    memory = Memory.open(spark, f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}")
    memory.commit(fixtures.state(spark, sf_dir))
    again = F.when(F.col("access_count") == 2, "hation again").otherwise(F.col("content"))
    memory.change(lambda s: s.with_(nodes=s.nodes.withColumn("content", again)))
    memory.change(lambda s: s.with_(nodes=s.nodes.where("access_count <> 3")))
    more = F.struct(F.concat(F.lit("new "), "id").alias("id"), F.concat(F.lit("hation anew "), "content").alias("content"))
    added = lambda n: n.where("access_count = 4").withColumn("x", more).withColumns({"id": F.col("x.id"), "content": F.col("x.content")}).drop("x")
    memory.change(lambda s: s.with_(nodes=s.nodes.unionByName(added(s.nodes))))
    return search.bm25(memory.index().merged(whole=True), "hation OR again").select(F.col("node_id").alias("id"), _six("score").alias("score"))


_TOP = _fts_sql([_term_sql("term = 'hation'"), _term_sql("term = 'the'")], "t0 > 0 OR t1 > 0")


@_query(f"{_TOP[: _TOP.rindex('SELECT w.id')]}SELECT * FROM ({_TOP[_TOP.rindex('SELECT w.id') :]}) ORDER BY score DESC, id LIMIT 25")
def fts_topk(spark, sf_dir):
    """The best nodes, from the blocks that can hold them."""
    return search.top_hits(fixtures.index(spark, sf_dir), "hation OR the", 25, digits=6).select(F.col("node_id").alias("id"), "score")


def _asked(spark, sf_dir, query):
    """A query from every hundredth document."""
    rows = fixtures.table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    return rows.select(F.col("doc_id").alias("query_id"), query.alias("query"), F.lit(10).alias("limit"))


@_query(
    _TOK.rstrip().rstrip(",")
    + """, q AS (SELECT CAST(substr(id, 2) AS BIGINT) AS query_id, substr(term, 1, 4) AS p FROM tok WHERE CAST(substr(id, 2) AS BIGINT) % 100 = 0 AND term <> ''
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
c AS (SELECT query_id, id, count(*) AS t FROM tok JOIN q ON starts_with(term, p) GROUP BY ALL),
d AS (SELECT query_id, count(*) AS df FROM c GROUP BY 1), s AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM len),
w AS (SELECT query_id, id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM c JOIN d USING (query_id) JOIN len USING (id), s)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place, round(score, 6) AS score FROM w QUALIFY place <= 10"""
)
def fts_prefix_batch(spark, sf_dir):
    """The beginning of each first word, for a table of queries."""
    asked = _asked(spark, sf_dir, F.concat(F.lit('"'), F.substring(F.get(search_tokens(F.col("text")), 0), 1, 4), F.lit('" *')))
    return search.search_many(fixtures.nodes(spark, sf_dir, outcome=False), asked.where("query IS NOT NULL")).select("query_id", "id", "place", _six("score").alias("score"))


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    f"""SELECT query_id, place, id FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) AS place, id
  FROM (SELECT doc_id AS query_id, '%' || {_FOLDED.format("substr(text, 11, 5) || '%' || substr(text, 40, 4)")} || '%' AS p FROM documents WHERE doc_id % 100 = 0)
  JOIN nodes ON {_FOLDED.format("content")} LIKE p OR {_FOLDED.format("entities[1]")} LIKE p OR {_FOLDED.format("entities[2]")} LIKE p) WHERE place <= 10"""
)
def like_batch(spark, sf_dir):
    """Two pieces of every hundredth document, one behind the other."""
    return search.like_many(fixtures.nodes(spark, sf_dir, outcome=False), _asked(spark, sf_dir, F.concat(F.substring("text", 11, 5), F.lit("%"), F.substring("text", 40, 4))))


# ---- walks


_EDGES = """, e AS (
  SELECT source_id AS tip, target_id AS nbr, 0 AS dir, weight, id AS link_id FROM links WHERE weight >= 0.05
  UNION ALL SELECT target_id, source_id, 1, weight, id FROM links WHERE weight >= 0.05),
"""


def _simple_sql(hops: int) -> str:
    tables = ["p0 AS (SELECT ['d7'] AS ids, strength AS score, id AS tip FROM nodes WHERE id = 'd7')"]
    for h in range(1, hops + 1):
        tables.append(
            f"p{h} AS (SELECT list_append(p.ids, e.nbr) AS ids, p.score * e.weight * n.strength * 0.85 AS score, e.nbr AS tip "
            f"FROM p{h - 1} p JOIN e ON e.tip = p.tip JOIN nodes n ON n.id = e.nbr WHERE NOT list_contains(p.ids, e.nbr) AND p.score * e.weight * n.strength * 0.85 >= 0.01)"
        )
    parts = " UNION ALL ".join(f"SELECT array_to_string(ids, '>') AS path, round(score, 6) AS score, {h} AS hops FROM p{h}" for h in range(hops + 1))
    return f"{_EDGES}{', '.join(tables)}\n{parts}"


for _hops, _name in ((1, "walk_1hop"), (2, "walk_2hop"), (3, "walk_3hop_simple")):

    @_query(_simple_sql(_hops), _name)
    def _walk(spark, sf_dir, hops=_hops):
        s = fixtures.state(spark, sf_dir)
        found = walk.simple_paths(s.nodes, s.links, s.nodes.where("id = 'd7'"), hops)
        return found.select(F.array_join("node_ids", ">").alias("path"), _six("score").alias("score"), "hops")


@_query(
    _EDGES
    + """r AS (SELECT *, row_number() OVER (PARTITION BY tip, dir ORDER BY weight DESC, link_id) AS place FROM e),
x AS (SELECT r.*, n.strength AS s FROM r JOIN nodes n ON n.id = r.nbr WHERE place <= 100),
p0 AS (SELECT 'd7' AS path, 'd7' AS tip, strength AS score FROM nodes WHERE id = 'd7'),
w1 AS (
  SELECT * FROM (SELECT p0.path || '>' || nbr AS path, nbr AS tip, score * weight * s * 0.85 AS score, dir, weight, link_id,
         row_number() OVER (PARTITION BY nbr ORDER BY dir, weight DESC, link_id) AS first
  FROM p0 JOIN x ON x.tip = p0.tip WHERE nbr <> 'd7') WHERE first = 1),
p1 AS (SELECT *, row_number() OVER (ORDER BY dir, weight DESC, link_id) AS pos FROM w1 WHERE score >= 0.01),
w2 AS (
  SELECT * FROM (SELECT p1.path || '>' || x.nbr AS path, p1.score * x.weight * s * 0.85 AS score,
         row_number() OVER (PARTITION BY x.nbr ORDER BY pos, x.dir, x.weight DESC, x.link_id) AS first
  FROM p1 JOIN x ON x.tip = p1.tip WHERE x.nbr <> 'd7' AND x.nbr NOT IN (SELECT tip FROM w1)) WHERE first = 1)
SELECT path, round(score, 6) AS score FROM p0 UNION ALL SELECT path, round(score, 6) FROM p1 UNION ALL SELECT path, round(score, 6) FROM w2 WHERE score >= 0.01"""
)
def walk_strict_single(spark, sf_dir):
    s = fixtures.state(spark, sf_dir)
    return walk.walk_graph(s.nodes, s.links, "d7", 2).select(F.array_join("node_ids", ">").alias("path"), _six("score").alias("score"))


@_query()
def walk_strict_many(spark, sf_dir):
    """Walks from every strong node, each benchmark item's source a query of its own."""
    s = fixtures.state(spark, sf_dir)
    q = fixtures.table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).alias("query_id")).distinct()
    best = s.nodes.where("strength >= 0.9").select("id", (-F.col("strength")).alias("o"), F.col("entities")[1].alias("source"))
    entries = q.join(best, F.concat(F.lit("src"), "query_id") == F.col("source")).select("query_id", F.struct("o", "id").alias("place"), "id")
    from pyspark.sql import Window

    entries = entries.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return walk.walk_many(s.nodes, s.links, entries, 2).withColumn("score", _six("score"))


@_query(
    f"""SELECT l.id AS link_id, round(a.strength * l.weight * b.strength * 0.85 * exp(-greatest(0.0, ({NOW} - a.created_at) / 86400.0) / 30), 9) AS path_score
FROM links l JOIN nodes a ON a.id = l.source_id JOIN nodes b ON b.id = l.target_id"""
)
def path_score_time_decay(spark, sf_dir):
    s = fixtures.state(spark, sf_dir)
    ends = s.links.join(s.nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    paths = ends.select(F.array("source_id", "target_id").alias("node_ids"), F.array("id").alias("link_ids"), F.col("id").alias("link_id"))
    # a walk never visits a node twice: loops of the table are no paths
    return walk.score_path(paths, s.nodes, s.links, NOW).select("link_id", F.round("path_score", 9).alias("path_score"))


# ---- recall


def _paths(found: retrieval.Recall) -> DataFrame:
    return found.paths.select("place", F.array_join("node_ids", ">").alias("path"), _six("score").alias("score"))


_WARM = _fts_sql([_term_sql("term = 'hation'")], "t0 > 0")


@_query(
    f"""{_WARM[: _WARM.rindex("SELECT w.id")].rstrip()},
hits AS ({_WARM[_WARM.rindex("SELECT w.id") :]} ORDER BY score DESC, w.id LIMIT 3)
SELECT CAST(row_number() OVER (ORDER BY h.score DESC, h.id) AS INT) AS place, h.id AS path, round(strength, 6) AS score
FROM hits h JOIN nodes n ON n.id = h.id WHERE strength >= 0.2"""
)
def retrieve_warm(spark, sf_dir):
    return _paths(retrieval.retrieve(fixtures.state(spark, sf_dir), "hation", tier=retrieval.RecallTier.WARM))


@_query("SELECT CAST(row_number() OVER (ORDER BY strength DESC, id) AS INT) AS place, id AS path, round(strength, 6) AS score FROM nodes WHERE strength >= 0.3 ORDER BY strength DESC, id LIMIT 5")
def retrieve_strength_fallback(spark, sf_dir):
    return _paths(retrieval.retrieve(fixtures.state(spark, sf_dir), ""))


for _tier, _text in (("smoke", "hation enti"), ("burn", "EN SRC1"), ("inferno", "EN SRC1"), ("burn_text", "hation enti")):

    @_query(None, f"retrieve_{_tier}")
    def _retrieve(spark, sf_dir, tier=_tier, text=_text):
        return _paths(retrieval.retrieve(fixtures.state(spark, sf_dir), text, tier=retrieval.RecallTier[tier.split("_")[0].upper()]))


def _text_hits(name: str, counts: list[str], holds: str, limit: int, least: float) -> str:
    """CTEs up to ``name`` (k, id, strength): hits of a text search that are strong enough."""
    sql = _fts_sql(counts, holds)
    cut = sql.rindex("SELECT w.id")
    best = f"SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM ({sql[cut:]}) ORDER BY k LIMIT {limit}"
    return f"{sql[:cut].rstrip()},\n{name} AS (SELECT h.k, h.id, n.strength FROM ({best}) h JOIN nodes n ON n.id = h.id WHERE n.strength >= {least})"


_ENTITY_HITS = """, top AS (SELECT * FROM nodes WHERE strength >= {least} ORDER BY strength DESC, id LIMIT 50),
m AS (SELECT id, strength, CAST(lower(entities[1]) = 'en' AS INT) + CAST(lower(entities[2]) = 'src1' AS INT) AS n FROM top),
{name} AS (SELECT row_number() OVER (ORDER BY n DESC, strength DESC, id) AS k, id, strength FROM m WHERE n > 0)"""


def _one_hop(entries: str, min_score: float, top_k: int) -> str:
    """CTEs up to paths (place, path, score, link) of ordered walks of one hop from ``entries`` (k, id, strength)."""
    return (
        _EDGES.rstrip()
        + f"""
r AS (SELECT *, row_number() OVER (PARTITION BY tip, dir ORDER BY weight DESC, link_id) AS place FROM e),
won AS (
  SELECT * FROM (SELECT h.k, h.id, r.nbr, r.dir, r.weight, r.link_id, h.strength * r.weight * n.strength * 0.85 AS score,
         row_number() OVER (PARTITION BY r.nbr ORDER BY h.k, r.dir, r.weight DESC, r.link_id) AS first
  FROM {entries} h JOIN r ON r.tip = h.id JOIN nodes n ON n.id = r.nbr WHERE r.place <= 100) WHERE first = 1),
every AS (
  SELECT k, id AS path, strength AS score, 0 AS hop, 0 AS dir, 0.0 AS weight, CAST(NULL AS BIGINT) AS link FROM {entries}
  UNION ALL SELECT k, id || '>' || nbr, score, 1, dir, weight, link_id FROM won WHERE nbr <> id AND score >= 0.01),
paths AS (
  SELECT CAST(row_number() OVER (ORDER BY score DESC, k, hop, dir, weight DESC, link) AS INT) AS place, path, score, link
  FROM every WHERE score >= {min_score} ORDER BY place LIMIT {top_k})"""
    )


_TWO_TERMS = ([_term_sql("term = 'hation'"), _term_sql("term = 'enti'")], "t0 > 0 AND t1 > 0")
_SMOKE_SQL = _text_hits("hits", *_TWO_TERMS, 5, 0.3) + _one_hop("hits", 0.1, 5)


@_query(_SMOKE_SQL + "\nSELECT place, path, round(score, 6) AS score FROM paths")
def retrieve_text_walk(spark, sf_dir):
    """Text hits as entries of one-hop walks."""
    return _paths(retrieval.retrieve(fixtures.state(spark, sf_dir), "hation enti", tier=retrieval.RecallTier.SMOKE))


_BURN_SQL = _ENTITY_HITS.format(name="hits", least=0.3) + _one_hop("hits", 0.01, 5)


@_query(_BURN_SQL + "\nSELECT place, path, round(score, 6) AS score FROM paths")
def retrieve_entity_walk(spark, sf_dir):
    """Nodes that share entities as entries of one-hop walks."""
    return _paths(retrieval.retrieve(fixtures.state(spark, sf_dir), "EN SRC1", max_hops=1))


@_query(_text_hits("hits", [_term_sql("term = 'hation'")], "t0 > 0", 5, 0.3) + "\nSELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS place, id AS path, round(strength, 6) AS score FROM hits")
def retrieve_entity_text(spark, sf_dir):
    """An entity that no node has: text hits, flat."""
    return _paths(retrieval.retrieve(fixtures.state(spark, sf_dir), "HATION"))


_STRONGEST = "SELECT CAST(row_number() OVER (ORDER BY strength DESC, id) AS INT) AS place, id AS path, round(strength, 6) AS score FROM nodes WHERE strength >= {least} ORDER BY strength DESC, id LIMIT {k}"


@_query(_STRONGEST.format(least=0.1, k=20))
def retrieve_entity_nothing(spark, sf_dir):
    """An entity that nothing has: the strongest nodes."""
    return _paths(retrieval.retrieve(fixtures.state(spark, sf_dir), "ZZQX", tier=retrieval.RecallTier.INFERNO))


def _batch(spark):
    rows = [(1, "hation enti", "SMOKE", None), (2, "", "BURN", None), (3, None, "烟", 7), (4, "ZZQX", "INFERNO", None), (5, "hation enti", "WARM", None)]
    return spark.createDataFrame(rows, "query_id int, query string, tier string, top_k int")


@_query(
    _SMOKE_SQL
    + f""",
b AS (SELECT 1 AS query_id, 'text walk' AS branch, place, path, score FROM paths
  UNION ALL SELECT 2, 'strength', * FROM ({_STRONGEST.format(least=0.3, k=5)})
  UNION ALL SELECT 3, 'strength', * FROM ({_STRONGEST.format(least=0.3, k=7)})
  UNION ALL SELECT 4, 'strength', * FROM ({_STRONGEST.format(least=0.1, k=20)})
  UNION ALL SELECT 5, 'text', CAST(row_number() OVER (ORDER BY k) AS INT), id, strength FROM (
    SELECT h.k, h.id, n.strength FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM ({_fts_sql(*_TWO_TERMS)[_fts_sql(*_TWO_TERMS).rindex("SELECT w.id"):]}) ORDER BY k LIMIT 3) h JOIN nodes n ON n.id = h.id WHERE n.strength >= 0.2))
SELECT query_id, branch, place, path, round(score, 6) AS score FROM b"""
)
def retrieve_batch(spark, sf_dir):
    """A table of queries that go different ways."""
    found = retrieval.retrieve_many(fixtures.state(spark, sf_dir), _batch(spark))
    return found.select("query_id", "branch", "place", F.array_join("node_ids", ">").alias("path"), _six("score").alias("score"))


def _sigmoid_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-abs({x}))) ELSE exp(-abs({x})) / (1 + exp(-abs({x}))) END"


_FOLD = f"list_reduce(list_prepend(weight, ds), lambda w, d: round_even({_sigmoid_sql('(w + d)')}, 6))"


@_query(
    _ENTITY_HITS.format(name="hits", least=0.1)
    + _one_hop("hits", 0.01, 500)
    + f""",
u AS (SELECT link AS id, list(0.02::DOUBLE) AS ds, count(*) AS n FROM paths WHERE link IS NOT NULL GROUP BY 1)
SELECT id, round({_FOLD}, 6) AS weight, n AS traverse_count, CAST({NOW} AS BIGINT) AS last_traversed FROM u JOIN links USING (id)"""
)
def retrieve_reinforced_links(spark, sf_dir):
    """Links after a deep recall: those of its paths are strengthened, once for each path."""
    s = fixtures.state(spark, sf_dir)
    after = retrieval.retrieve(s, "EN SRC1", 500, retrieval.RecallTier.INFERNO, max_hops=1).reinforced(s.links, NOW)
    return after.where("traverse_count > 0").select("id", _six("weight").alias("weight"), "traverse_count", "last_traversed")


# ---- dynamics


@_query(f"SELECT id, round({_sigmoid_sql('(weight * 20 - 10)')}, 9) AS s FROM links")
def sigmoid_values(spark, sf_dir):
    return fixtures.links(spark, sf_dir).select("id", F.round(dynamics.sigmoid(F.col("weight") * 20 - 10), 9).alias("s"))


@_query(
    f""", u AS (SELECT id, weight AS w0, id % 4 AS n FROM links),
a AS (SELECT *, round_even({_sigmoid_sql("(w0 + 0.02)")}, 6) AS w1 FROM u),
b AS (SELECT *, round_even({_sigmoid_sql("(w1 + 0.02)")}, 6) AS w2 FROM a),
c AS (SELECT *, round_even({_sigmoid_sql("(w2 + 0.02)")}, 6) AS w3 FROM b)
SELECT id, round(CASE n WHEN 0 THEN w0 WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END, 6) AS weight, n AS traverse_count FROM c"""
)
def hebbian_neutral_repeat(spark, sf_dir):
    links = fixtures.links(spark, sf_dir)
    uses = links.where("id % 4 > 0").select(F.col("id").alias("link_id"), F.explode(F.sequence(F.lit(1), (F.col("id") % 4).cast("int")))).select("link_id", F.lit(0.0).alias("signal"))
    return dynamics.on_traverse(links, uses, NOW).select("id", _six("weight").alias("weight"), "traverse_count")


@_query(
    f""", f AS (
  SELECT 2 * (user_id % 200) + 1 AS id, count(*) AS n,
         list(CASE WHEN event_type IN ('purchase', 'signup') THEN 0.10::DOUBLE WHEN event_type = 'error' THEN -0.05::DOUBLE ELSE 0.02::DOUBLE END ORDER BY ts, event_id) AS ds
  FROM events GROUP BY 1)
SELECT id, round(CASE WHEN ds IS NULL THEN weight ELSE {_FOLD} END, 6) AS weight, coalesce(n, 0) AS traverse_count, CASE WHEN n > 0 THEN CAST({NOW} AS BIGINT) END AS last_traversed
FROM links LEFT JOIN f USING (id)"""
)
def hebbian_feedback(spark, sf_dir):
    links = fixtures.links(spark, sf_dir)
    after = dynamics.on_traverse(links, fixtures.feedback(spark, sf_dir), NOW)
    return after.select("id", _six("weight").alias("weight"), "traverse_count", "last_traversed")


@_query(
    f""", d AS (SELECT l.id, l.weight * pow(1 - n.decay_rate, greatest(0.0, ({NOW} - l.created_at) / 86400.0)) AS w FROM links l JOIN nodes n ON n.id = l.source_id)
SELECT id, round(w, 6) AS weight FROM d WHERE w >= 0.2"""
)
def daily_decay(spark, sf_dir):
    after, _ = dynamics.daily_decay(fixtures.state(spark, sf_dir), NOW)
    return after.links.select("id", _six("weight").alias("weight"))


# ---- inspection


_SCORE = f""", f AS (
  SELECT *, greatest(0.0, ({NOW} - created_at) / 86400.0) AS age, greatest(0.0, ({NOW} - coalesce(last_accessed, created_at)) / 86400.0) AS cold FROM nodes),
v AS (
  SELECT id, age, least(1.0,
      CASE WHEN strength < 0.25 THEN 0.4 * (1 - strength / 0.25) ELSE 0.0 END + CASE WHEN age > 7 AND access_count < 5 THEN 0.3 ELSE 0.0 END
    + CASE WHEN outcome = 'FAILURE' THEN 0.3 ELSE 0.0 END + CASE WHEN cold > 14 THEN 0.2 * least(1.0, cold / 90) ELSE 0.0 END) AS score FROM f),
i AS (
  SELECT id, round(score, 6) AS prune_score,
    CASE WHEN age < 1 THEN 'keep' WHEN score >= 0.7 THEN 'prune' WHEN score >= 0.5 THEN 'review' WHEN score >= 0.3 THEN 'archive' ELSE 'keep' END AS verdict FROM v)
"""


@_query(_SCORE + "SELECT id, prune_score, verdict FROM i")
def inspection_verdicts(spark, sf_dir):
    found = inspection.verdicts(fixtures.nodes(spark, sf_dir), NOW)
    return found.select("id", _six("prune_score").alias("prune_score"), "verdict")


@_query(_SCORE + "SELECT k.verdict, count(i.id) AS n FROM (VALUES ('keep'), ('archive'), ('prune'), ('review')) k(verdict) LEFT JOIN i ON i.verdict = k.verdict GROUP BY k.verdict")
def inspection_summary(spark, sf_dir):
    return inspection.summary(inspection.verdicts(fixtures.nodes(spark, sf_dir), NOW))


@_query(_SCORE + f"SELECT id, verdict AS inspection_verdict, CAST({NOW} AS BIGINT) AS last_inspected FROM i")
def inspection_written(spark, sf_dir):
    after, _ = inspection.run_inspection(fixtures.state(spark, sf_dir), NOW, dry_run=False, limit=None)
    return after.nodes.select("id", "inspection_verdict", "last_inspected")


@_query(_SCORE + ", g AS (SELECT id FROM i WHERE verdict = 'prune')\nSELECT id, source_id, target_id FROM links WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)")
def prune_apply(spark, sf_dir):
    state = fixtures.state(spark, sf_dir)
    _, report = inspection.run_inspection(state, NOW, limit=None)
    after, _ = inspection.apply_prune(state, report, confirm=False)
    return after.links.select("id", "source_id", "target_id")


# ---- consolidation


_WORDS = r""", ws AS (
  SELECT id, unnest(regexp_split_to_array(regexp_replace(lower(content), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+')) AS w FROM nodes),
wd AS (SELECT DISTINCT id, w FROM ws WHERE length(w) > 2 AND w NOT IN ('the','and','for','are','but','not','you','all','can','had','her','was','one','our','out','has','have','been','its','than','that','this','with','from','they','will')),
ks AS (SELECT id, list_sort(list(w)) AS ws FROM wd GROUP BY id),
mb AS (
  SELECT id, first_value(id) OVER (PARTITION BY ws, list_sort(list_distinct(list_transform(entities, lambda e: lower(trim(e))))), node_type ORDER BY strength DESC, id) AS rep
  FROM ks JOIN nodes USING (id)),
wr AS (SELECT wd.* FROM wd JOIN mb USING (id) WHERE mb.id = mb.rep),
sz AS (SELECT id, count(*) AS n FROM wr GROUP BY id),
co AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM wr a JOIN wr b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
sim AS (
  SELECT x, y, c / (p.n + q.n - c) AS s FROM co JOIN sz p ON p.id = x JOIN sz q ON q.id = y),
pr AS (
  SELECT CASE WHEN m.strength >= n.strength THEN x ELSE y END AS a, CASE WHEN m.strength >= n.strength THEN y ELSE x END AS b, s,
         CAST(m.entities[1] = n.entities[1] AS INT) + CAST(m.entities[2] = n.entities[2] AS INT) AS overlap, m.node_type = n.node_type AS same_type
  FROM sim JOIN nodes m ON m.id = x JOIN nodes n ON n.id = y WHERE s >= 0.6)
"""


@_query(_WORDS + "SELECT a, b, round(s, 6) AS similarity, overlap, same_type FROM pr")
def content_jaccard_pairs(spark, sf_dir):
    found = consolidation.similar_pairs(fixtures.nodes(spark, sf_dir, outcome=False))
    return found.select("a", "b", _six("similarity").alias("similarity"), "overlap", "same_type")


@_query(_WORDS + "SELECT a, b, round(s, 6) AS confidence FROM pr WHERE overlap >= 2 OR (same_type AND s >= 0.8)")
def duplicate_pairs(spark, sf_dir):
    found = consolidation.duplicate_pairs(fixtures.nodes(spark, sf_dir, outcome=False))
    return found.select("a", "b", _six("confidence").alias("confidence"))


@_query(_WORDS + "SELECT id, rep FROM mb")
def duplicate_members(spark, sf_dir):
    """The class of each node, by its strongest member."""
    return consolidation.members(fixtures.nodes(spark, sf_dir, outcome=False)).select("id", "rep")


@_query(
    _WORDS.rstrip()
    + """,
dp AS (SELECT a, b, s FROM pr WHERE overlap >= 2 OR (same_type AND s >= 0.8)),
od AS (SELECT id, row_number() OVER (ORDER BY strength DESC, id) AS k FROM nodes WHERE id IN (SELECT a FROM dp UNION SELECT b FROM dp)),
ad AS (SELECT o.k, o.id, coalesce(list(p.k) FILTER (p.k IS NOT NULL), []) AS before FROM od o LEFT JOIN dp ON dp.b = o.id LEFT JOIN od p ON p.id = dp.a GROUP BY o.k, o.id),
alive AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT ad.k, CASE WHEN len(list_intersect(before, kept)) = 0 THEN list_append(kept, ad.k) ELSE kept END FROM alive JOIN ad ON ad.k = alive.k + 1),
fin AS (SELECT kept FROM alive ORDER BY k DESC LIMIT 1),
vi AS (SELECT ad.id AS victim_id, list_min(list_intersect(before, kept)) AS sk FROM ad, fin WHERE NOT list_contains(kept, ad.k)),
ms AS (SELECT victim_id, od.id AS survivor_id, dp.s AS confidence FROM vi JOIN od ON od.k = vi.sk JOIN dp ON dp.a = od.id AND dp.b = victim_id)
SELECT victim_id, survivor_id, round(confidence, 6) AS confidence FROM ms
UNION ALL
SELECT mb.id, coalesce(ms.survivor_id, mb.rep), round(coalesce(ms.confidence, 1.0), 6) FROM mb LEFT JOIN ms ON ms.victim_id = mb.rep WHERE mb.id <> mb.rep"""
)
def consolidate_static(spark, sf_dir):
    return consolidation.merges(fixtures.nodes(spark, sf_dir, outcome=False)).select("victim_id", "survivor_id", _six("confidence").alias("confidence"))


@_query()
def consolidate_strict(spark, sf_dir):
    return consolidation.sequential_merges(fixtures.nodes(spark, sf_dir)).select("id", "survivor_id", "confidence", "strength", "content")


@_query(
    """, m AS (SELECT id AS v, 'd' || (CAST(substr(id, 2) AS BIGINT) - 1) AS s FROM nodes WHERE access_count = 7),
r AS (
  SELECT l.id, coalesce(a.s, l.source_id) AS source_id, coalesce(b.s, l.target_id) AS target_id, relation, weight, a.s IS NOT NULL OR b.s IS NOT NULL AS moved
  FROM links l LEFT JOIN m a ON a.v = l.source_id LEFT JOIN m b ON b.v = l.target_id),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation ORDER BY moved, id) AS n FROM r WHERE NOT moved OR source_id <> target_id)
SELECT id, source_id, target_id, relation, weight, moved FROM k WHERE n = 1"""
)
def link_transfer(spark, sf_dir):
    s = fixtures.state(spark, sf_dir)
    merges = s.nodes.where("access_count = 7").select(F.col("id").alias("victim_id"), F.concat(F.lit("d"), F.substring("id", 2, 20).cast("long") - 1).alias("survivor_id"))
    return consolidation.moved_links(s.links, merges).select("id", "source_id", "target_id", "relation", "weight", "moved")


@_query(", left_ AS (SELECT id FROM nodes WHERE access_count <> 4)\nSELECT id FROM links WHERE source_id NOT IN (SELECT id FROM left_) OR target_id NOT IN (SELECT id FROM left_)")
def orphan_links(spark, sf_dir):
    s = fixtures.state(spark, sf_dir)
    return crud.orphan_links(s.nodes.where("access_count <> 4"), s.links).select("id")


# ---- profile


def _sections_sql() -> str:
    parts = []
    for n, (kind, title, most, chars, drop) in enumerate(profile.SECTIONS):
        item = f"CASE WHEN length(t) > {chars} THEN substr(t, 1, {chars - 3}) || '...' ELSE t END"
        blank = " AND t <> ''" if drop else ""
        parts.append(f"SELECT {n} AS n, '{kind}' AS node_type, '**{title}**:' || chr(10) || string_agg('- ' || {item}, chr(10) ORDER BY place) || chr(10) AS section FROM c WHERE node_type = '{kind}' AND place <= {most}{blank} HAVING count(*) > 0")
    return (
        r""", top AS (SELECT * FROM nodes ORDER BY strength DESC, id LIMIT 500),
c AS (
  SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY node_type ORDER BY strength DESC, access_count DESC, id) AS place
  FROM top WHERE strength >= 0.6 AND node_type <> 'temp'),
"""
        + f"s AS ({' UNION ALL '.join(parts)})\n"
    )


@_query(_sections_sql() + "SELECT n, node_type, section FROM s")
def profile_sections(spark, sf_dir):
    return profile.sections(fixtures.nodes(spark, sf_dir))


_FIT = "CASE WHEN {used} + l{k} <= 2000 THEN {used} + l{k} ELSE {used} END"


def _profile_sql() -> str:
    used = ["0"] + [f"u{k}" for k in range(4)]
    tables = ", q AS (SELECT " + ", ".join(f"max(CASE WHEN n = {k} THEN section END) AS s{k}, coalesce(max(CASE WHEN n = {k} THEN length(section) END), 9999) AS l{k}" for k in range(4)) + " FROM s)"
    last = "q"
    for k in range(4):
        tables += f", q{k} AS (SELECT *, {_FIT.format(used=used[k], k=k)} AS u{k} FROM {last})"
        last = f"q{k}"
    kept = ", ".join(f"CASE WHEN u{k} > {used[k]} THEN s{k} END" for k in range(4))
    return _sections_sql() + tables + f" SELECT CASE WHEN u3 > 0 THEN '## User Profile' || chr(10) || chr(10) || concat_ws(chr(10), {kept}) ELSE '' END AS profile FROM q3"


@_query(_profile_sql())
def profile_text(spark, sf_dir):
    return profile.profile(fixtures.nodes(spark, sf_dir))


@_query(
    """, top AS (SELECT * FROM nodes ORDER BY strength DESC, id LIMIT 500),
c AS (SELECT * FROM top WHERE strength >= 0.7 AND node_type <> 'temp'),
a AS (SELECT count(*) AS n, count(*) FILTER (node_type = 'preference') AS p, count(*) FILTER (node_type = 'fact') AS f, (SELECT content FROM c ORDER BY strength DESC, access_count DESC, id LIMIT 1) AS t FROM c)
SELECT CASE WHEN n = 0 THEN '' ELSE '[Profile: ' || CASE WHEN p + f > 0 THEN concat_ws(', ', CASE WHEN p > 0 THEN p || ' preferences' END, CASE WHEN f > 0 THEN f || ' facts' END) ELSE n || ' memories' END
  || ' | Top: ' || replace(substr(t, 1, 60), chr(10), ' ') || ']' END AS summary FROM a"""
)
def summary_line(spark, sf_dir):
    return profile.summary_line(fixtures.nodes(spark, sf_dir))

