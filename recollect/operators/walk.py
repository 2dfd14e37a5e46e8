"""Walks: scored paths from entry nodes along links in both directions.

``simple_paths`` is declarative and takes all paths without repeated nodes. The ordered
walks are breadth-first with a shared set of visited nodes: a node belongs to the first
path that finds it, even where that path is then dropped for its score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SECONDS_PER_DAY
from ..sources.store import settled
from .crud import numbered, top_links_per_node

# fixed values
HOP_DECAY, MIN_LINK_WEIGHT, MIN_PATH_SCORE, FAN_OUT = 0.85, 0.05, 0.01, 100


def _keep(max_hops: int):
    """How loops hold what they have: settled, as each level is used more than once; a walk of
    one hop is one plan."""
    return settled if max_hops > 1 else (lambda df: df)


def steps(links: DataFrame, min_link_weight: float = MIN_LINK_WEIGHT, fan_out: int | None = FAN_OUT, tips: DataFrame | None = None) -> DataFrame:
    """(tip, nbr, dir, weight, link_id): each link from both ends (0 out, 1 in), per tip and
    direction only the ``fan_out`` heaviest; of ``tips`` (tip) alone where they are given, so
    that links are ranked around those only."""
    if tips is not None:
        near = tips.select("tip").distinct()
        out = links.join(near, F.col("source_id") == F.col("tip"), "left_semi").select(F.lit("outgoing").alias("direction"), "*")
        into = links.join(near, F.col("target_id") == F.col("tip"), "left_semi").select(F.lit("incoming").alias("direction"), "*")
        rows = out.unionByName(into).where(F.col("weight") >= min_link_weight)
        if fan_out is not None:
            end = F.when(F.col("direction") == "outgoing", F.col("source_id")).otherwise(F.col("target_id"))
            best = Window.partitionBy(end, "direction").orderBy(F.desc("weight"), "id")
            rows = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= fan_out)
        return _ends(rows)
    rows = links.where(F.col("weight") >= min_link_weight) if fan_out is None else top_links_per_node(links, min_link_weight, fan_out)
    if fan_out is None:
        rows = rows.select(F.explode(F.array(F.lit("outgoing"), F.lit("incoming"))).alias("direction"), "*")
    return _ends(rows)


def _ends(rows: DataFrame) -> DataFrame:
    out = F.col("direction") == "outgoing"
    return rows.select(
        F.when(out, F.col("source_id")).otherwise(F.col("target_id")).alias("tip"),
        F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("nbr"),
        F.when(out, 0).otherwise(1).alias("dir"),
        "weight",
        F.col("id").alias("link_id"),
    )


def simple_paths(nodes: DataFrame, links: DataFrame, entries: DataFrame, max_hops: int, min_link_weight: float = MIN_LINK_WEIGHT, min_score: float = MIN_PATH_SCORE) -> DataFrame:
    """(node_ids, link_ids, score, hops) of all paths without repeated nodes from ``entries`` (id).

    Scores only fall along a path, so pruning by ``min_score`` at every hop loses nothing;
    the entry itself is always a path.
    """
    strength = nodes.select(F.col("id").alias("nbr"), F.col("strength").alias("s"))
    edges = steps(links, min_link_weight, None).join(strength, "nbr")
    now = nodes.join(entries.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("tip"), F.array("id").alias("node_ids"), F.array().cast("array<long>").alias("link_ids"), F.col("strength").alias("score"), F.lit(0).alias("hops")
    )
    every = now
    for hop in range(1, max_hops + 1):
        ahead = now.join(edges, "tip").where(~F.array_contains("node_ids", F.col("nbr")))
        now = ahead.select(
            F.col("nbr").alias("tip"),
            F.array_append("node_ids", F.col("nbr")).alias("node_ids"),
            F.array_append("link_ids", F.col("link_id")).alias("link_ids"),
            (F.col("score") * F.col("weight") * F.col("s") * HOP_DECAY).alias("score"),
            F.lit(hop).alias("hops"),
        ).where(F.col("score") >= min_score)
        every = every.unionByName(now)
    return every.drop("tip")


def walk_graph(nodes: DataFrame, links: DataFrame, entry: str, max_hops: int = 3, min_link_weight: float = MIN_LINK_WEIGHT, visited: list[str] | None = None) -> DataFrame:
    """The ordered walk from one entry: (place, node_ids, link_ids, score), best first.

    Level by level: of the steps from a level to nodes not visited, the first by position
    of the path, direction, weight and link wins a node. All winners are visited; those
    above the score floor make the next level. Without ``visited`` the entry is visited.
    """
    strength = nodes.select(F.col("id").alias("nbr"), F.col("strength").alias("s"))
    keep = _keep(max_hops)
    # ``order`` lists the steps of a path, as they compare: a level's paths go by the steps that found them
    level = nodes.where(F.col("id") == entry).select(F.array().cast("array<struct<dir:int,w:double,link:bigint>>").alias("order"), F.col("id").alias("tip"), F.array("id").alias("node_ids"), F.array().cast("array<long>").alias("link_ids"), F.col("strength").alias("score"))
    seen = nodes.sparkSession.createDataFrame([(v,) for v in (visited if visited is not None else [entry])], "nbr string")
    every = level.withColumn("hop", F.lit(0))
    for hop in range(1, max_hops + 1):
        ahead = level.join(steps(links, min_link_weight, tips=level), "tip").join(strength, "nbr").join(seen, "nbr", "left_anti")
        ahead = ahead.withColumn("order", F.array_append("order", F.struct("dir", (-F.col("weight")).alias("w"), F.col("link_id").alias("link"))))
        won = ahead.withColumn("_n", F.row_number().over(Window.partitionBy("nbr").orderBy("order"))).where("_n = 1")
        won = keep(won.withColumn("new", F.col("score") * F.col("weight") * F.col("s") * HOP_DECAY))
        seen = seen.unionByName(won.select("nbr"))
        kept = won.where((F.col("new") >= MIN_PATH_SCORE) & ~F.array_contains("node_ids", F.col("nbr")))
        level = kept.select(
            "order",
            F.col("nbr").alias("tip"),
            F.array_append("node_ids", F.col("nbr")).alias("node_ids"),
            F.array_append("link_ids", F.col("link_id")).alias("link_ids"),
            F.col("new").alias("score"),
        )
        every = every.unionByName(level.withColumn("hop", F.lit(hop)))
    every = every.withColumn("best", -F.col("score"))
    return numbered(every, ["best", "hop", "order"], 1).select(F.col("_id").alias("place"), "node_ids", "link_ids", "score")


def _around(links: DataFrame, starts: DataFrame, max_hops: int, min_link_weight: float) -> DataFrame:
    """(tip, nbr, dir, weight, link_id) of all nodes that a walk could pass, settled: every node is
    expanded once, whichever queries and entries reach it, and links are ranked around those only."""
    reach = inner = starts.select(F.col("id").alias("tip")).distinct()
    near = None
    for hop in range(max_hops):
        ahead = settled(steps(links, min_link_weight, tips=reach)) if max_hops > 1 else steps(links, min_link_weight, tips=reach)
        near = ahead if near is None else near.unionByName(ahead)
        if hop + 1 < max_hops:
            reach = settled(ahead.select(F.col("nbr").alias("tip")).distinct().join(inner, "tip", "left_anti"))
            if reach.isEmpty():
                break
            inner = inner.unionByName(reach)
    return near


def _claims(starts: DataFrame, around: DataFrame, before: DataFrame | None, max_hops: int) -> DataFrame:
    """All walks side by side: (query_id, place, nbr, hop, order, node_ids, link_ids, score, alive).

    A walk claims the nodes that its levels reach first, by the order of their steps, but none
    that ``before`` (query_id, nbr, by) gives to an earlier entry.
    """
    none = F.array().cast("array<struct<dir:int,w:double,link:bigint>>")
    level = starts.select("query_id", "place", "hops", none.alias("order"), F.col("id").alias("tip"), F.array("id").alias("node_ids"), F.array().cast("array<long>").alias("link_ids"), F.col("strength").alias("score"))
    every, held = None, []
    for hop in range(1, max_hops + 1):
        ahead = level.where(F.col("hops") >= hop).join(around, "tip")
        if before is not None:
            ahead = ahead.join(before, ["query_id", "nbr"], "left").where(F.col("by").isNull() | (F.col("by") >= F.col("place")))
        if every is not None:
            ahead = ahead.join(every.select("query_id", "place", "nbr"), ["query_id", "place", "nbr"], "left_anti")
        step = F.struct("dir", (-F.col("weight")).alias("w"), F.col("link_id").alias("link"))
        offer = F.struct(F.array_append("order", step).alias("order"), "node_ids", "link_ids", "hops", (F.col("score") * F.col("weight") * F.col("s") * HOP_DECAY).alias("score"))
        won = ahead.groupBy("query_id", "place", "nbr").agg(F.min(offer).alias("o")).select("query_id", "place", "nbr", F.lit(hop).alias("hop"), "o.*")
        won = won.withColumn("alive", (F.col("score") >= MIN_PATH_SCORE) & ~F.array_contains("node_ids", F.col("nbr")))
        link = F.element_at("order", F.lit(-1))["link"]
        won = won.withColumns({"node_ids": F.array_append("node_ids", F.col("nbr")), "link_ids": F.array_append("link_ids", link)})
        won = won.persist()  # a level is read by the next one and by the result
        held.append(won)
        every = won if every is None else every.unionByName(won)
        level = won.where("alive").select("query_id", "place", "hops", "order", F.col("nbr").alias("tip"), "node_ids", "link_ids", "score")
    out = settled(every.drop("hops"))
    for won in held:
        won.unpersist()
    return out


def walk_many(nodes: DataFrame, links: DataFrame, entries: DataFrame, max_hops: int, min_link_weight: float = MIN_LINK_WEIGHT) -> DataFrame:
    """Ordered walks that share their visited nodes, for a batch of queries.

    ``entries`` has (query_id, place, id) and perhaps ``hops``, a query's own depth of at most
    ``max_hops``. A query's entries walk one after the other, and a node belongs to the first
    walk that reaches it. All walks run side by side by joins instead, without what earlier
    entries have claimed in the round before; rounds go on until no claim changes. The first
    walk is right after one round, each other one a round after those before it at the latest,
    and as a rule all are after a few. Nobody holds a neighbourhood: claims are rows.
    Returns (query_id, entry_place, walk_place, node_ids, link_ids, score).
    """
    depth = F.col("hops") if "hops" in entries.columns else F.lit(max_hops)
    starts = entries.select("query_id", "place", "id", depth.cast("int").alias("hops")).join(nodes.select("id", "strength"), "id")
    every = starts.select("query_id", "place", F.lit(0).alias("hop"), F.array().cast("array<struct<dir:int,w:double,link:bigint>>").alias("order"), F.array("id").alias("node_ids"), F.array().cast("array<long>").alias("link_ids"), F.col("strength").alias("score"))
    if max_hops > 0:
        starts = settled(starts)
        around = _around(links, starts, max_hops, min_link_weight).join(nodes.select(F.col("id").alias("nbr"), F.col("strength").alias("s")), "nbr")
        around = settled(around)
        many = starts.groupBy("query_id").count().where("count > 1")
        shared = not many.isEmpty()
        before, found = None, _claims(starts, around, None, max_hops)
        while shared:
            now = settled(found.groupBy("query_id", "nbr").agg(F.min("place").alias("by")))
            if before is not None:
                was = before.select(F.col("query_id").alias("_q"), F.col("nbr").alias("_n"), F.col("by").alias("_by"))
                other = now.join(was, (F.col("query_id") == F.col("_q")) & (F.col("nbr") == F.col("_n")), "full").where("NOT by <=> _by")
                if other.isEmpty():
                    break
            before, found = now, _claims(starts, around, now, max_hops)
        every = every.unionByName(found.where("alive").select(every.columns))
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "hop", "order")
    return every.select("query_id", F.col("place").cast("int").alias("entry_place"), (F.row_number().over(best) - 1).alias("walk_place"), "node_ids", "link_ids", "score")


def score_path(paths: DataFrame, nodes: DataFrame, links: DataFrame, now: int, hop_decay: float = HOP_DECAY, time_decay_days: float = 30.0) -> DataFrame:
    """Adds ``path_score`` to (node_ids, link_ids) rows: the product of strengths and weights
    with hop decay, times exp(-age / time_decay_days) of the first node. An empty path
    scores 0; a creation time of 0 or a decay of 0 days or less sets no time factor."""
    rows = paths.withColumn("_k", F.struct("node_ids", "link_ids"))
    keys = rows.select("_k", "node_ids", "link_ids").distinct()
    ns = keys.select("_k", F.explode("node_ids").alias("id")).join(nodes.select("id", "strength"), "id").groupBy("_k").agg(F.product("strength").alias("_s"))
    ls = keys.select("_k", F.explode("link_ids").alias("id")).join(links.select("id", "weight"), "id").groupBy("_k").agg(F.product("weight").alias("_w"), F.count("*").alias("_n"))
    first = nodes.select(F.col("id").alias("_f"), F.col("created_at").alias("_c"))
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("_c")) / SECONDS_PER_DAY)
    factor = F.when(F.coalesce(F.col("_c"), F.lit(0)) == 0, 1.0).otherwise(F.exp(-age / time_decay_days)) if time_decay_days > 0 else F.lit(1.0)
    rows = rows.join(ns, "_k", "left").join(ls, "_k", "left").join(first, F.try_element_at("node_ids", F.lit(1)) == F.col("_f"), "left")
    score = F.when(F.size("node_ids") == 0, 0.0).otherwise(F.col("_s") * F.coalesce("_w", F.lit(1.0)) * F.pow(F.lit(hop_decay), F.coalesce("_n", F.lit(0))) * factor)
    return rows.withColumn("path_score", score).drop("_k", "_s", "_w", "_n", "_f", "_c")
