"""Link weights: reinforcement when links are used, decay when they are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LINKS, SECONDS_PER_DAY
from ..sources.store import GraphState, settled

# fixed values: changes by sign of the signal; weights under the threshold are pruned
POSITIVE, NEGATIVE, NEUTRAL, PRUNE_BELOW = 0.10, -0.05, 0.02, 0.2


def sigmoid(x: Column) -> Column:
    """The logistic function, from the side that cannot overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def delta(signal: Column) -> Column:
    return F.when(signal > 0, POSITIVE).when(signal < 0, NEGATIVE).otherwise(NEUTRAL)


def strengthened(weight: Column, change: Column) -> Column:
    """The weight after one use, to six places (halves to even)."""
    return F.bround(sigmoid(weight + change), 6)


#: Latest uses of a link that are folded at first, and how many times more where they do not settle its weight.
SUFFIX, LONGER = 64, 16


def _latest(rows: DataFrame, most: int) -> DataFrame:
    """(link_id, steps): the ``most`` latest uses of each link, in order; picked in every task
    before a link's rows meet."""
    place = F.row_number().over(Window.partitionBy("link_id").orderBy(F.desc("seq"), F.desc("d")))
    best = rows.withColumn("_r", place).where(F.col("_r") <= most)
    return best.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("seq", "d"))).alias("steps"))


def on_traverse(links: DataFrame, uses: DataFrame, now: int, suffix: int = SUFFIX) -> DataFrame:
    """``links`` after their uses.

    ``uses`` has (link_id, signal[, seq]) rows. Uses of one link apply one after another in
    order of seq (ties: by signal's change), links without any stay as they are. A step keeps
    the order of two weights and brings them four times closer, so only the latest steps
    matter: they are run from both ends of the range, 0 and 1, and where both agree every
    weight before ends there too. A link whose ends do not agree takes more steps, at last all
    it has; a link with no more than ``suffix`` uses is folded from its own weight.
    """
    change = delta(F.coalesce("signal", F.lit(0.0))).alias("d")
    rows = uses.select("link_id", *(["seq"] if "seq" in uses.columns else [F.lit(0).alias("seq")]), change)
    counts = rows.groupBy("link_id").agg(F.count("*").alias("n"))
    fold = lambda start: F.aggregate("steps", start, lambda w, s: strengthened(w, s["d"]))
    known = links.select(F.col("id").alias("link_id"), "weight")

    def folded(wanted: DataFrame, most: int) -> DataFrame:
        """(link_id, n, new) of (link_id, n); ``new`` is null where ``most`` uses do not tell."""
        held = wanted.join(_latest(rows.join(wanted.select("link_id"), "link_id", "left_semi"), most), "link_id").join(known, "link_id")
        low, high = fold(F.lit(0.0)), fold(F.lit(1.0))
        return held.select("link_id", "n", F.when(F.col("n") <= most, fold(F.col("weight"))).when(low == high, low).alias("new"))

    done = folded(counts, suffix)
    if not counts.where(F.col("n") > suffix).isEmpty():
        done = settled(done)
        most = suffix
        while not (left := done.where("new IS NULL")).isEmpty():
            most *= LONGER
            done = settled(done.where("new IS NOT NULL").unionByName(folded(left.select("link_id", "n"), most)))
    used = F.col("n").isNotNull()
    after = links.join(done.withColumnRenamed("link_id", "_k"), F.col("id") == F.col("_k"), "left").withColumns(
        {
            "weight": F.when(used, F.col("new")).otherwise(F.col("weight")),
            "traverse_count": F.coalesce("traverse_count", F.lit(0)) + F.coalesce("n", F.lit(0)),
            "last_traversed": F.when(used, F.lit(now).cast("long")).otherwise(F.col("last_traversed")),
        }
    )
    return after.select(*LINKS.fieldNames())


def decayed(links: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """``links`` with ``decayed`` (null where the source is missing): the weight times
    (1 - the source's rate) to the power of the days since the last use."""
    rates = nodes.select(F.col("id").alias("_s"), "decay_rate")
    since = F.coalesce(F.nullif("last_traversed", F.lit(0)), "created_at")
    days = F.greatest(F.lit(0.0), (F.lit(now) - since) / SECONDS_PER_DAY)
    return links.join(rates, F.col("source_id") == F.col("_s"), "left").withColumn("decayed", F.col("weight") * F.pow(1 - F.col("decay_rate"), days)).drop("_s", "decay_rate")


def daily_decay(state: GraphState, now: int, node_id: str | None = None, limit: int | None = None) -> tuple[GraphState, int]:
    """Applies decay; links that fall below the threshold go. Returns the state and how many.

    Links without a source stay untouched. The time of last use does not move, so running
    again compounds. ``node_id`` takes that node's links only; ``limit`` the heaviest.
    """
    from .crud import get_links

    chosen = state.links if node_id is None and limit is None else get_links(state.links, node_id=node_id, limit=limit)
    rows = settled(decayed(chosen, state.nodes, now))
    gone = rows.where(F.col("decayed") < PRUNE_BELOW).select("id")
    new = rows.where(F.col("decayed") >= PRUNE_BELOW).select(F.col("id").alias("_k"), F.bround("decayed", 6).alias("_w"))
    links = state.links.join(gone, "id", "left_anti").join(new, F.col("id") == F.col("_k"), "left").withColumn("weight", F.coalesce("_w", "weight"))
    return state.with_(links=links.select(*LINKS.fieldNames())), gone.count()
