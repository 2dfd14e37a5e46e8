"""Scans, filters and batch changes of the graph tables.

Orders always end in the id, so results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LINKS, NODES, VALID_NODE_TYPES, VALID_RELATIONS, default_decay
from ..sources.store import GraphState

# ---- scans and filters


def all_nodes(nodes: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Strongest nodes first; ``limit=None`` for all."""
    rows = nodes.orderBy(F.desc("strength"), "id")
    return rows if limit is None else rows.limit(limit)


def all_links(links: DataFrame, limit: int | None = 5000) -> DataFrame:
    """Heaviest links first; ``limit=None`` for all."""
    rows = links.orderBy(F.desc("weight"), "id")
    return rows if limit is None else rows.limit(limit)


def search_nodes(nodes: DataFrame, node_type: str | None = None, min_strength: float = 0.0, limit: int | None = 50) -> DataFrame:
    """Nodes of a type with at least a strength; 0 sets no condition, so null strengths stay."""
    if node_type is not None:
        nodes = nodes.where(F.col("node_type") == node_type)
    if min_strength > 0:
        nodes = nodes.where(F.col("strength") >= min_strength)
    return all_nodes(nodes, limit)


def get_links(links: DataFrame, node_id: str | None = None, relation: str | None = None, min_weight: float = 0.0, direction: str = "both", limit: int | None = 100) -> DataFrame:
    """Links by weight, relation and incident node; a direction other than outgoing or
    incoming means both."""
    rows = links.where(F.col("weight") >= min_weight)
    if relation is not None:
        rows = rows.where(F.col("relation") == relation)
    if node_id is not None:
        out, into = F.col("source_id") == node_id, F.col("target_id") == node_id
        rows = rows.where({"outgoing": out, "incoming": into}.get(direction, out | into))
    return all_links(rows, limit)


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def link_by_id(links: DataFrame, link_id: int) -> DataFrame:
    return links.where(F.col("id") == link_id)


def find_by_entities(nodes: DataFrame, entities: list[str], min_strength: float = 0.0, limit: int | None = 50, prelimit: int | None = -1) -> DataFrame:
    """Nodes that share entities, most matches first: adds ``matched`` (array).

    Only the ``prelimit`` strongest nodes are looked at (by default as many as ``limit``,
    which is what callers of the original semantics expect); None looks at all. A ``limit`` of
    None returns all matches.
    """
    rows = nodes.where(F.col("entities").isNotNull() & (F.col("strength") >= min_strength))
    if prelimit is not None:
        rows = all_nodes(rows, limit if prelimit == -1 else prelimit)
    wanted = F.array(*[F.lit(e.lower()) for e in entities]).cast("array<string>")
    rows = rows.withColumn("matched", F.filter("entities", lambda e: F.array_contains(wanted, F.lower(e))))
    rows = rows.where(F.size("matched") > 0).orderBy(F.desc(F.size("matched")), F.desc("strength"), "id")
    return rows if limit is None else rows.limit(limit)


def entity_matches(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, n_matched) of all nodes that share an entity, for a batch of
    (query_id, entities): an equi-join on the lower-cased entity. Stored repeats count."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("e"))
    n = nodes.select("id", F.explode("entities").alias("x")).select("id", F.lower("x").alias("e"))
    return q.join(n, "e").groupBy("query_id", "id").agg(F.count("*").alias("n_matched"))


def top_links_per_node(links: DataFrame, min_weight: float = 0.0, limit: int = 100) -> DataFrame:
    """(node_id, direction, link): the heaviest links of every node and direction."""
    rows = links.where(F.col("weight") >= min_weight)
    both = rows.select(F.col("source_id").alias("node_id"), F.lit("outgoing").alias("direction"), "*").unionByName(rows.select(F.col("target_id").alias("node_id"), F.lit("incoming").alias("direction"), "*"))
    w = Window.partitionBy("node_id", "direction").orderBy(F.desc("weight"), "id")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


# ---- changes

#: What updates may set.
NODE_UPDATES = ("content", "strength", "last_accessed", "access_count", "decay_rate", "outcome", "last_inspected", "inspection_verdict")
LINK_UPDATES = ("weight", "last_traversed", "traverse_count")


def _first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def create_nodes(state: GraphState, new: DataFrame, now: int, strict: bool = False) -> GraphState:
    """Adds (id, content[, node_type, strength, entities, decay_rate, seq]) rows.

    A row with an unknown type, a missing id or content, or an id that is taken (in the
    table or by an earlier row, by ``seq`` then content) is left out; ``strict`` raises.
    """
    fill = {"node_type": F.lit("fact"), "strength": F.lit(0.5), "entities": F.array().cast("array<string>"), "decay_rate": F.lit(None).cast("double"), "seq": F.lit(0)}
    rows = new.withColumns({k: v for k, v in fill.items() if k not in new.columns})
    rows = rows.withColumn("decay_rate", F.coalesce("decay_rate", default_decay(F.col("node_type"))))
    fine = rows.where(F.col("node_type").isin(*VALID_NODE_TYPES) & F.col("id").isNotNull() & F.col("content").isNotNull())
    fine = _first_of(fine, ["id"], ["seq", "content"]).join(state.nodes.select("id"), "id", "left_anti")
    if strict and fine.count() < new.count():
        raise ValueError("a node has an unknown type, no id or content, or an id that already exists")
    constants = {"created_at": F.lit(now), "access_count": F.lit(0)}
    made = fine.select(*[constants.get(f.name, F.col(f.name) if f.name in fine.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES])
    return state.with_(nodes=state.nodes.unionByName(made))


def _updated(rows: DataFrame, key: str, ids: list | DataFrame, changes: dict, allowed: tuple) -> DataFrame:
    known = {k: v for k, v in changes.items() if k in allowed}
    if not known:
        return rows
    value = lambda k, v: (v if isinstance(v, Column) else F.lit(v)).cast(rows.schema[k].dataType)
    if isinstance(ids, list):
        hit = F.col(key).isin(*ids)
        return rows.withColumns({k: F.when(hit, value(k, v)).otherwise(F.col(k)) for k, v in known.items()})
    marks = ids.select(F.col(key).alias("_k")).distinct()
    hit = F.col("_k").isNotNull()
    return rows.join(marks, F.col(key) == F.col("_k"), "left").withColumns({k: F.when(hit, value(k, v)).otherwise(F.col(k)) for k, v in known.items()}).drop("_k")


def update_nodes(state: GraphState, ids: list | DataFrame, changes: dict) -> GraphState:
    """Sets columns (values or Columns, null too) of the named nodes; unknown names, types and entities are ignored."""
    return state.with_(nodes=_updated(state.nodes, "id", ids, changes, NODE_UPDATES))


def update_links(state: GraphState, ids: list | DataFrame, changes: dict) -> GraphState:
    """As :func:`update_nodes`, for links."""
    return state.with_(links=_updated(state.links, "id", ids, changes, LINK_UPDATES))


def touch_nodes(state: GraphState, ids: list | DataFrame, now: int) -> GraphState:
    """Counts an access of each node; nothing else in the library does."""
    return update_nodes(state, ids, {"last_accessed": now, "access_count": F.coalesce("access_count", F.lit(0)) + 1})


def delete_nodes(state: GraphState, ids: DataFrame) -> GraphState:
    """Drops nodes and every link at either end of them."""
    gone = ids.select("id").distinct()
    links = reduce(lambda rows, end: rows.join(gone.select(F.col("id").alias(end)), end, "left_anti"), ("source_id", "target_id"), state.links)
    return state.with_(nodes=state.nodes.join(gone, "id", "left_anti"), links=links.select(*LINKS.fieldNames()))


def create_links(state: GraphState, new: DataFrame, now: int, strict: bool = False) -> GraphState:
    """Adds (source_id, target_id[, relation, weight, seq]) rows between existing nodes.

    Left out (``strict`` raises): unknown relations, missing ends, and keys (source,
    target, relation) that are taken, by the table or by an earlier row. Self-loops are
    allowed. Ids follow the mark in order of (seq, source, target, relation).
    """
    fill = {"relation": F.lit("related_to"), "weight": F.lit(0.3), "seq": F.lit(0)}
    rows = new.withColumns({k: v for k, v in fill.items() if k not in new.columns})
    key = ["source_id", "target_id", "relation"]
    ids = state.nodes.select("id")
    fine = rows.where(F.col("relation").isin(*VALID_RELATIONS))
    for end in key[:2]:
        fine = fine.join(ids.withColumnRenamed("id", end), end, "left_semi")
    fine = _first_of(fine, key, ["seq", F.desc("weight")]).join(state.links.select(*key), key, "left_anti")
    made = numbered(fine, ["seq", *key], state.next_link_id)
    n = made.count()
    if strict and n < new.count():
        raise ValueError("a link has an unknown relation, a missing end, or exists already")
    constants = {"created_at": F.lit(now), "last_traversed": F.lit(None), "traverse_count": F.lit(0)}
    made = made.select(*[constants.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) if f.name != "id" else F.col("_id").alias("id") for f in LINKS])
    return state.with_(links=state.links.unionByName(made), next_link_id=state.next_link_id + n)


def numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Adds ``_id``: consecutive numbers from ``start`` in an order, without one global window.

    Rows are range-partitioned and sorted; each partition starts at the sum of the counts
    of those before it (one row a partition).
    """
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    counts = part.groupBy("_part").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = part.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(counts.select("_part", "_base")), "_part").withColumn("_id", (F.col("_base") + F.col("_local") + (start - 1)).cast("long")).drop("_part", "_local", "_base")


def delete_links(state: GraphState, ids: DataFrame) -> GraphState:
    return state.with_(links=state.links.join(ids.select("id").distinct(), "id", "left_anti").select(*LINKS.fieldNames()))


def orphan_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with a missing end."""
    ids = nodes.select(F.col("id").alias("n")).distinct()
    return links.join(ids.withColumnRenamed("n", "s"), F.col("source_id") == F.col("s"), "left").join(ids, F.col("target_id") == F.col("n"), "left").where("s IS NULL OR n IS NULL").drop("s", "n")


def create_sessions(state: GraphState, ids: DataFrame, now: int) -> GraphState:
    """Starts sessions that are not there yet."""
    new = ids.select("id").distinct().join(state.sessions.select("id"), "id", "left_anti")
    made = new.select("id", F.lit(now).cast("long").alias("started_at"), F.lit(None).cast("long").alias("ended_at"), F.lit(0).cast("long").alias("turn_count"))
    return state.with_(sessions=state.sessions.unionByName(made))


def end_sessions(state: GraphState, ids: DataFrame, now: int) -> GraphState:
    """Sets the end of known sessions, also where they had one."""
    return state.with_(sessions=_updated(state.sessions, "id", ids, {"ended_at": now}, ("ended_at",)))


def increment_turns(state: GraphState, turns: DataFrame) -> GraphState:
    """Adds the number of rows with each session's id to its turns; unknown ids are ignored."""
    more = turns.groupBy(F.col("id").alias("_k")).agg(F.count("*").alias("_n"))
    rows = state.sessions.join(more, F.col("id") == F.col("_k"), "left").withColumn("turn_count", F.col("turn_count") + F.coalesce("_n", F.lit(0)))
    return state.with_(sessions=rows.drop("_k", "_n"))
