"""Recall in four depths, and the write path.

Recall returns paths and, for the two deep tiers, the links after reinforcement as a
second value: a query has no side effect until the caller commits it.
"""

from __future__ import annotations

import enum
import heapq
import uuid
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ner import entities_of, extract_entities
from ..sources.store import GraphState, Memory, settled
from . import crud
from .dynamics import on_traverse
from .search import SearchIndex, StoredIndex, search, search_many
from .walk import walk_many

# fixed values: relations and weights of links that writing makes
EXPLICIT, AUTOMATIC, CANDIDATES = ("inspired_by", 0.4), ("related_to", 0.3), 50


class RecallTier(enum.Enum):
    WARM = "温"
    SMOKE = "烟"
    BURN = "燃"
    INFERNO = "炎"


@dataclass(frozen=True)
class Depth:
    hops: int
    min_score: float
    min_strength: float
    top_k: int
    text_first: bool


# fixed values: hops, least path score, least entry strength, results, text search as a way in
DEPTHS = {
    RecallTier.WARM: Depth(0, 0.0, 0.2, 3, True),
    RecallTier.SMOKE: Depth(1, 0.1, 0.3, 5, True),
    RecallTier.BURN: Depth(3, 0.01, 0.3, 5, True),
    RecallTier.INFERNO: Depth(5, 0.01, 0.1, 20, False),
}
DEEP = (RecallTier.BURN, RecallTier.INFERNO)


@dataclass
class Recall:
    """``paths``: (place, node_ids, link_ids, score). ``branch`` says which way was taken,
    ``reinforce`` whether links of the paths are to be strengthened."""

    paths: DataFrame
    branch: str
    reinforce: bool = False

    def reinforced(self, links: DataFrame, now: int) -> DataFrame:
        """``links`` after this recall: each path's links count once for each path."""
        if not self.reinforce:
            return links
        uses = self.paths.select(F.explode("link_ids").alias("link_id"), F.lit(0.0).alias("signal"))
        return on_traverse(links, uses, now)


def _flat(nodes: DataFrame, order: list) -> DataFrame:
    """One-node paths, scored by strength, in the given order."""
    place = F.row_number().over(Window.orderBy(*order))
    return nodes.select(place.alias("place"), F.array("id").alias("node_ids"), F.array().cast("array<long>").alias("link_ids"), F.col("strength").alias("score"))


def _ranked(walked: DataFrame, min_score: float, top_k: int) -> DataFrame:
    """Best paths first, each chain of nodes once."""
    order = [F.desc("score"), "entry_place", "walk_place"]
    rows = walked.where(F.col("score") >= min_score)
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("node_ids").orderBy(*order))).where("_n = 1")
    best = once.orderBy(*order).limit(top_k)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "node_ids", "link_ids", "score")


def _walked(state: GraphState, entries: DataFrame, hops: int) -> DataFrame:
    return walk_many(state.nodes, state.links, entries.select(F.lit(0).alias("query_id"), "place", "id"), hops)


def retrieve(
    state: GraphState,
    query: str,
    top_k: int | None = None,
    tier: RecallTier = RecallTier.BURN,
    max_hops: int | None = None,
    min_node_strength: float | None = None,
    index: SearchIndex | StoredIndex | None = None,
    segment=None,
    prelimit: int | None = CANDIDATES,
) -> Recall:
    """Paths for a query. ``top_k`` of 0 means the tier's own. Entities are looked up among the
    ``prelimit`` strongest nodes, as the reference semantics have it, or (None) among all.

    Branches: text search alone (WARM); without entities text hits as entries of a walk,
    or the hits flat, or the strongest nodes; with entities nodes that share them as
    entries of a walk, or text hits flat, or the strongest nodes. Text is searched only
    where its hits are needed. ``segment`` serves Chinese queries.
    """
    depth = DEPTHS[tier]
    top_k = top_k or depth.top_k
    hops = depth.hops if max_hops is None else max_hops
    least = depth.min_strength if min_node_strength is None else min_node_strength
    hits = lambda: search(state.nodes, query, top_k, index, segment).where(F.col("strength") >= least)
    if tier is RecallTier.WARM:
        return Recall(_flat(hits(), ["place"]), "text")
    strongest = lambda: _flat(crud.search_nodes(state.nodes, min_strength=least, limit=top_k), [F.desc("strength"), "id"])
    entities = extract_entities(query, segment)
    if entities:
        matches = settled(crud.find_by_entities(state.nodes, entities, least, prelimit, prelimit).select("id", F.size("matched").alias("n"), "strength"))
        if not matches.isEmpty():
            place = crud.numbered(matches, [F.desc("n"), F.desc("strength"), "id"], 0).select(F.col("_id").cast("int").alias("place"), "id")
            walked = _walked(state, place, hops)
            return Recall(_ranked(walked, depth.min_score, top_k), "entity walk", tier in DEEP)
        if depth.text_first and not (text := hits()).isEmpty():
            return Recall(_flat(text, ["place"]), "text")
        return Recall(strongest(), "strength")
    text = hits()
    entries = text.select("place", "id").collect()  # at most top_k rows
    if not entries:
        return Recall(strongest(), "strength")
    walked = _walked(state, state.spark.createDataFrame(entries, "place int, id string"), hops)
    found = _ranked(walked, depth.min_score, top_k)
    if found.isEmpty():
        return Recall(_flat(text, ["place"]), "text")
    return Recall(found, "text walk")


def retrieve_many(state: GraphState, queries: DataFrame, index: SearchIndex | StoredIndex | None = None, prelimit: int | None = CANDIDATES) -> DataFrame:
    """Paths for a table of queries: (query_id, branch, place, node_ids, link_ids, score, reinforce).

    ``queries`` has query_id, query and, if wanted, tier (name or sign; unknown or null: BURN),
    top_k, max_hops, min_node_strength. Each query goes the way :func:`retrieve` goes; all of
    one way are worked out together. Ids must be unique; a null query counts as blank.
    """
    names = {t.name: t.name for t in RecallTier} | {t.value: t.name for t in RecallTier}
    tiers = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    depth = F.create_map(*[x for t, d in DEPTHS.items() for x in (F.lit(t.name), F.struct(*[F.lit(v).alias(k) for k, v in vars(d).items()]))])
    given = lambda name, kind: F.col(name).cast(kind) if name in queries.columns else F.lit(None).cast(kind)
    q = queries.select("query_id", F.coalesce(F.col("query"), F.lit("")).alias("query"), F.coalesce(F.try_element_at(tiers, given("tier", "string")), F.lit("BURN")).alias("tier"), *[given(n, k).alias(n) for n, k in (("top_k", "int"), ("max_hops", "int"), ("min_node_strength", "double"))])
    q = q.withColumn("d", F.element_at(depth, F.col("tier")))
    q = q.select(
        "query_id",
        "query",
        "tier",
        F.when(F.col("top_k") != 0, F.col("top_k")).otherwise(F.col("d.top_k")).alias("top_k"),
        F.coalesce("max_hops", "d.hops").alias("hops"),
        F.coalesce("min_node_strength", "d.min_strength").alias("least"),
        F.col("d.min_score").alias("min_score"),
        F.col("d.text_first").alias("text_first"),
        F.when(F.col("tier") != "WARM", entities_of(F.col("query"))).alias("entities"),
    )
    q = settled(q.withColumn("named", F.coalesce(F.size("entities"), F.lit(0)) > 0))

    # entities among the strongest nodes: those above any bound are the first of one list
    named = state.nodes.where(F.col("entities").isNotNull())
    pool = (named if prelimit is None else crud.all_nodes(named, prelimit)).select("id", "strength", F.explode("entities").alias("x")).select("id", "strength", F.lower("x").alias("e"))
    wanted = q.where("named").select("query_id", "least", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("e"))
    matched = wanted.join(pool, "e").where("strength >= least").groupBy("query_id", "id", "strength").agg(F.count("*").alias("n"))
    matched = settled(matched.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("strength"), "id")) - 1).select("query_id", "place", "id"))
    by_entity = matched.select("query_id").distinct()

    asked = q.where("NOT named OR text_first").join(by_entity, "query_id", "left_anti")
    strength = state.nodes.select("id", "strength")
    hits = search_many(state.nodes, asked.select("query_id", "query", F.col("top_k").alias("limit")), index)
    hits = settled(hits.join(strength, "id").join(q.select("query_id", "least"), "query_id").where("strength >= least").select("query_id", "place", "id", "strength"))

    from_text = hits.join(q.where("NOT named AND tier <> 'WARM'").select("query_id"), "query_id", "left_semi").select("query_id", "place", "id")
    entries = matched.unionByName(from_text).join(q.select("query_id", "hops"), "query_id")
    walked = walk_many(state.nodes, state.links, entries, q.agg(F.max("hops")).first()[0] or 0)
    columns = ["query_id", "branch", "place", "node_ids", "link_ids", "score"]
    none = F.array().cast("array<long>")
    flat = lambda rows, branch: rows.select("query_id", F.lit(branch).alias("branch"), "place", F.array("id").alias("node_ids"), none.alias("link_ids"), F.col("strength").alias("score"))
    order = [F.desc("score"), "entry_place", "walk_place"]
    rows = walked.join(q.select("query_id", "min_score", "top_k"), "query_id").where("score >= min_score")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "node_ids").orderBy(*order))).where("_n = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("place <= top_k")
    branch = F.when(F.col("_e").isNull(), "text walk").otherwise("entity walk")
    paths = settled(rows.join(by_entity.select("query_id", F.lit(1).alias("_e")), "query_id", "left").withColumn("branch", branch).select(*columns))

    done = by_entity.unionByName(paths.select("query_id")).distinct()
    text = hits.join(done, "query_id", "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    rest = q.where("tier <> 'WARM'").join(done, "query_id", "left_anti").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    most = rest.agg(F.max("top_k")).first()[0] or 0
    best = crud.all_nodes(strength, most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("strength"), "id")))  # as many as the largest top_k
    strongest = rest.select("query_id", "least", F.explode(F.sequence(F.lit(1), F.col("top_k"))).alias("place")).join(best, "place").where("strength >= least")
    every = paths.unionByName(flat(text, "text")).unionByName(flat(strongest, "strength"))
    deep = q.select("query_id", F.col("tier").isin(*[t.name for t in DEEP]).alias("_deep"))
    return every.join(deep, "query_id").select(*columns, ((F.col("branch") == "entity walk") & F.col("_deep")).alias("reinforce"))


def to_dicts(state: GraphState, paths: DataFrame) -> list[dict]:
    """Paths as plain values: texts and ids joined by arrows, scores to four places, whole nodes."""
    rows = paths.select("place", "score", "link_ids", F.posexplode("node_ids").alias("i", "id")).join(state.nodes, "id")
    out = rows.groupBy("place", "score", "link_ids").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(*state.nodes.columns).alias("node")))).alias("n")).orderBy("place")
    found = []
    for r in out.collect():  # top_k rows
        nodes = [{**x, "entities": x["entities"] or []} for x in (n["node"].asDict(recursive=True) for n in r["n"])]
        ids = [n["id"] for n in nodes]
        found.append({"content": " → ".join(n["content"] for n in nodes), "path": " → ".join(ids), "score": round(r["score"], 4), "node_ids": ids, "nodes": nodes, "link_ids": list(r["link_ids"])})
    return found


# ---- writing


def auto_links(new: DataFrame, nodes: DataFrame, prelimit: int | None = CANDIDATES) -> DataFrame:
    """(source_id, target_id) links that new nodes get to nodes that share entities: at
    least two, or all of the new node's.

    ``new`` has (seq, id, entities, linked): nodes in ``linked`` and the node itself are
    skipped, nodes of the batch count if they come earlier. ``prelimit`` looks at that many
    of the strongest nodes only, as they are when the new node is written (the new node
    included); None looks at all, by an equi-join on entities.
    """
    old = nodes.select("id", "entities", "strength", F.lit(-1).cast("long").alias("seq"))
    made = new.select("id", "entities", F.coalesce("strength", F.lit(0.5)).alias("strength") if "strength" in new.columns else F.lit(0.5).alias("strength"), F.col("seq").cast("long").alias("seq"))
    if prelimit is None:
        pool = old.unionByName(made).select(F.col("id").alias("t"), F.col("seq").alias("t_seq"), F.explode("entities").alias("x")).withColumn("e", F.lower("x"))
        mine = new.select("seq", F.col("id").alias("s"), "linked", F.size("entities").alias("own"), F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("e"))
        found = mine.join(pool, "e").where("t_seq < seq AND s <> t").groupBy("seq", "s", "t", "own", "linked").agg(F.count("*").alias("n"))
    else:
        lists = _strongest_lists(made, old, prelimit)
        seen = lists.select("seq", "s", F.explode("ts").alias("t")).where("s <> t")
        pool = old.unionByName(made).select(F.col("id").alias("t"), F.col("entities").alias("t_entities"))
        mine = new.select(F.col("seq").cast("long").alias("seq"), F.col("id").alias("s"), "linked", F.size("entities").alias("own"), F.transform("entities", F.lower).alias("wanted"))
        found = seen.join(pool, "t").join(mine, ["seq", "s"]).withColumn("n", F.size(F.filter("t_entities", lambda e: F.array_contains("wanted", F.lower(e)))))
    keep = (F.col("n") >= 2) | ((F.col("n") > 0) & (F.col("n") == F.col("own")))
    rows = found.where(keep & ~F.coalesce(F.array_contains("linked", F.col("t")), F.lit(False)))
    return rows.select("seq", F.col("s").alias("source_id"), F.col("t").alias("target_id"))


def _strongest_lists(made: DataFrame, old: DataFrame, most: int) -> DataFrame:
    """(seq, s, ts): for each new node the ids of the ``most`` strongest nodes once it is written.

    A prefix scan: rows are range-partitioned by seq; the strongest of each partition, and so
    of all partitions before one, are ``most`` rows; with these each partition goes through
    its own rows in order. Rows of one seq see each other.
    """
    order = [F.desc("strength"), "id"]
    rows = settled(made.select("seq", "id", "strength").repartitionByRange("seq").sortWithinPartitions("seq", "id")).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    tops = rows.withColumn("_r", place).where(F.col("_r") <= most).select("part", "id", "strength").collect()  # most rows a partition
    by_part: dict[int, list] = {}
    for r in tops:
        by_part.setdefault(r["part"], []).append((-r["strength"], r["id"]))
    best = [(-r["strength"], r["id"]) for r in crud.all_nodes(old, most).select("id", "strength").collect()]  # most rows
    before = {}
    for part in sorted(by_part):
        before[part] = best
        best = heapq.nsmallest(most, best + by_part[part])
    starts = rows.sparkSession.sparkContext.broadcast(before)

    def run(batches):
        best, held = None, []

        def settle():
            nonlocal best, held
            best = heapq.nsmallest(most, best + [(-strength, i) for _, i, strength in held])
            out = pd.DataFrame({"seq": [h[0] for h in held], "s": [h[1] for h in held], "ts": [[i for _, i in best]] * len(held)})
            held = []
            return out

        for pdf in batches:
            out = []
            for seq, node, strength, part in pdf.itertuples(index=False, name=None):
                if best is None:
                    best = starts.value[part]
                if held and held[0][0] != seq:
                    out.append(settle())
                held.append((seq, node, strength))
            if out:
                yield pd.concat(out)
        if held:
            yield settle()

    return rows.mapInPandas(run, "seq long, s string, ts array<string>")


def write_memories(state: GraphState, new: DataFrame, now: int, prelimit: int | None = CANDIDATES, auto_entities: bool = True, segment=None) -> GraphState:
    """Writes a batch of (seq, id, content[, node_type, strength, link_to]) rows in order of
    seq: entities, nodes, explicit links (missing targets are skipped), automatic links."""
    rows = new.withColumn("entities", entities_of(F.col("content"), segment) if auto_entities else F.array().cast("array<string>"))
    if "link_to" not in rows.columns:
        rows = rows.withColumn("link_to", F.array().cast("array<string>"))
    before = state.nodes
    after = crud.create_nodes(state, rows, now)
    wanted = rows.select("seq", F.col("id").alias("source_id"), F.explode("link_to").alias("target_id"))
    after = crud.create_links(after, wanted.withColumns({"relation": F.lit(EXPLICIT[0]), "weight": F.lit(EXPLICIT[1])}), now)
    found = auto_links(rows.withColumn("linked", F.coalesce("link_to", F.array().cast("array<string>"))), before, prelimit)
    return crud.create_links(after, found.withColumns({"relation": F.lit(AUTOMATIC[0]), "weight": F.lit(AUTOMATIC[1])}), now)


def write_memory(state: GraphState, content: str, now: int, node_type: str = "fact", strength: float = 0.5, node_id: str | None = None, link_to: list[str] | None = None, extract_auto_entities: bool = True, segment=None) -> tuple[GraphState, str]:
    """Writes one memory; returns the state and the node's id (made up if not given)."""
    node_id = node_id or str(uuid.uuid4())
    if node_type not in crud.VALID_NODE_TYPES:
        raise ValueError(f"unknown node type {node_type!r}")
    if not state.nodes.where(F.col("id") == node_id).isEmpty():
        raise ValueError(f"node {node_id!r} already exists")
    entities = extract_entities(content, segment) if extract_auto_entities else []
    row = state.spark.createDataFrame([(0, node_id, content, node_type, strength, link_to or [], entities)], "seq long, id string, content string, node_type string, strength double, link_to array<string>, entities array<string>")
    before = state.nodes
    state = crud.create_nodes(state, row, now)
    links = row.select("seq", F.col("id").alias("source_id"), F.explode("link_to").alias("target_id"), F.lit(EXPLICIT[0]).alias("relation"), F.lit(EXPLICIT[1]).alias("weight"))
    state = crud.create_links(state, links, now)
    auto = auto_links(row.withColumn("linked", F.col("link_to")), before).withColumns({"relation": F.lit(AUTOMATIC[0]), "weight": F.lit(AUTOMATIC[1])})
    return crud.create_links(state, auto, now), node_id


# ---- tool-shaped wrappers over a handle


def memory_recall(memory: Memory, query: str, top_k: int = 5, tier: str = "燃", now: int | None = None) -> list[dict]:
    """Recall by tier sign (unknown: BURN); reinforcement is committed."""
    from ..sources.store import _now

    found = retrieve(memory.state, query, top_k, next((t for t in RecallTier if t.value == tier), RecallTier.BURN), index=memory.index(), segment=memory.segment)
    found = replace(found, paths=settled(found.paths))
    out = to_dicts(memory.state, found.paths)
    if found.reinforce and any(r["link_ids"] for r in out):
        memory.change(lambda state: state.with_(links=found.reinforced(state.links, _now(now))), ids=[], touched={"nodes": False, "sessions": False, "links": F.col("id").isin(*{i for r in out for i in r["link_ids"]})})
    return out


def memory_write(memory: Memory, content: str, node_type: str = "fact", link_to: list[str] | None = None, now: int | None = None) -> dict:
    from ..sources.store import _now

    node_id = str(uuid.uuid4())
    memory.change(lambda state: write_memory(state, content, _now(now), node_type, node_id=node_id, link_to=link_to, segment=memory.segment)[0], ids=[node_id], touched={"nodes": F.col("id") == node_id, "sessions": False, "links": F.col("source_id") == node_id})
    return memory.get_node(node_id)


def memory_link(memory: Memory, source_id: str, target_id: str, relation: str = "related_to", weight: float = 0.3, now: int | None = None) -> dict:
    return memory.create_link(source_id, target_id, relation, weight, now)


