"""Health verdicts for nodes and pruning."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SECONDS_PER_DAY, VALID_VERDICTS
from ..sources.store import GraphState
from .crud import all_nodes, delete_nodes

# fixed values
STRENGTH_FLOOR, FEW_ACCESSES, ACCESS_AGE_DAYS = 0.25, 5, 7
FAILURE_PENALTY, COLD_DAYS, MIN_AGE_DAYS = 0.3, 14, 1.0
PRUNE, REVIEW, ARCHIVE = 0.7, 0.5, 0.3


def age_days(now: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now) - F.col("created_at")) / SECONDS_PER_DAY)


def cold_days(now: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce("last_accessed", "created_at")) / SECONDS_PER_DAY)


def prune_score(now: int) -> Column:
    """From 0 to 1: weak, old but rarely used, failed and cold nodes score high."""
    weak = F.when(F.col("strength") < STRENGTH_FLOOR, 0.4 * (1 - F.col("strength") / STRENGTH_FLOOR)).otherwise(0.0)
    unused = F.when((age_days(now) > ACCESS_AGE_DAYS) & (F.col("access_count") < FEW_ACCESSES), 0.3).otherwise(0.0)
    failed = F.when(F.col("outcome") == "FAILURE", FAILURE_PENALTY).otherwise(0.0)
    cold = F.when(cold_days(now) > COLD_DAYS, 0.2 * F.least(F.lit(1.0), cold_days(now) / 90)).otherwise(0.0)
    return F.least(F.lit(1.0), weak + unused + failed + cold)


def verdicts(nodes: DataFrame, now: int, min_strength: float = 0.0, limit: int | None = None) -> DataFrame:
    """(id, prune_score, verdict, young, old_verdict) of the nodes that are looked at."""
    rows = nodes if limit is None else all_nodes(nodes, limit)
    young = age_days(now) < MIN_AGE_DAYS
    score = prune_score(now)
    verdict = F.when(young, "keep").when(score >= PRUNE, "prune").when(score >= REVIEW, "review").when(score >= ARCHIVE, "archive").otherwise("keep")
    return rows.where(F.col("strength") >= min_strength).select("id", score.alias("prune_score"), verdict.alias("verdict"), young.alias("young"), F.col("inspection_verdict").alias("old_verdict"))


def summary(found: DataFrame) -> DataFrame:
    """(verdict, n): all four verdicts, zero where there is none."""
    every = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, VALID_VERDICTS))).alias("verdict"))
    return every.join(found.groupBy("verdict").count(), "verdict", "left").select("verdict", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@dataclass
class InspectionReport:
    """Verdicts as a table; the counts are read on demand."""

    rows: DataFrame
    errors: list[str] = field(default_factory=list)

    @property
    def inspected_count(self) -> int:
        return self.rows.where("NOT young").count()

    @property
    def summary(self) -> dict[str, int]:
        return {r["verdict"]: r["n"] for r in summary(self.rows).collect()} | {"inspected": self.inspected_count}

    def ids(self, verdict: str) -> DataFrame:
        return self.rows.where(F.col("verdict") == verdict).select("id")

    def print(self) -> None:
        for name, n in self.summary.items():
            print(f"{name:>10}: {n}")


def run_inspection(state: GraphState, now: int, dry_run: bool = True, min_strength: float = 0.0, limit: int | None = 1000) -> tuple[GraphState, InspectionReport]:
    """Verdicts of the strongest ``limit`` nodes (None: all, as is right for large graphs).

    A wet run writes those that changed. Nodes younger than a day are kept unseen.
    """
    found = verdicts(state.nodes, now, min_strength, limit)
    report = InspectionReport(found)
    if dry_run:
        return state, report
    changed = found.where("NOT young AND NOT (verdict <=> old_verdict)").select(F.col("id").alias("_k"), "verdict")
    nodes = state.nodes.join(changed, F.col("id") == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    nodes = nodes.withColumn("last_inspected", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("last_inspected"))).withColumn("inspection_verdict", F.when(hit, F.col("verdict")).otherwise(F.col("inspection_verdict")))
    return state.with_(nodes=nodes.select(*state.nodes.columns)), report


def apply_prune(state: GraphState, report: InspectionReport, confirm: bool = True, show: int = 20) -> tuple[GraphState, int]:
    """Deletes the nodes with verdict prune and their links; with ``confirm`` it only shows
    the first few and returns 0."""
    gone = report.ids("prune").join(state.nodes.select("id"), "id", "left_semi")
    if confirm:
        for r in state.nodes.join(gone, "id", "left_semi").orderBy("id").limit(show).collect():
            print(f"[{r['node_type']}] {r['content'][:60]}")
        return state, 0
    return delete_nodes(state, gone), gone.count()


