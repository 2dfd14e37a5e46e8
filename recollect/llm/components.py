"""Connected components over an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) edges can reach.

    Labels start as the smallest neighbour. In every round all nodes of a label take the
    smallest label that any of them sees at a neighbour, and then that label's label, so
    labels merge at least in pairs: about log n rounds. Sums by label are pre-aggregated.
    Each round is a table in the shared folder, never a growing lineage. Null ends are
    dropped. An empty edge table gives no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropna()
    both = stored(both.distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        seen = stored(labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("new")), "cc-seen")
        # what one node of a label sees holds for all of them
        best = seen.groupBy(F.col("label").alias("_l")).agg(F.min("new").alias("best"))
        step = stored(seen.join(best, F.col("label") == F.col("_l")).select("node", "label", F.col("best").alias("new")), "cc-step")
        jump = step.select(F.col("node").alias("n2"), F.col("new").alias("up"))
        after = stored(
            step.join(jump, F.col("new") == F.col("n2"), "left").select("node", F.col("label").alias("was"), F.least("new", "up").alias("label")), "cc-labels"
        )
        changed = after.where("label <> was").limit(1).count()
        drop_stored(seen)
        drop_stored(step)
        drop_stored(labels)
        labels = after.select("node", "label")
        if not changed:
            drop_stored(both)
            return labels
    raise RuntimeError("labels did not settle")
