"""A profile of the strongest memories as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncated
from .crud import all_nodes

# fixed values: (type, title, most items, most characters of an item, whether blank items go)
SECTIONS = (("preference", "Preferences", 8, 150, True), ("fact", "Known facts", 8, 150, True), ("decision", "Past decisions", 8, 120, False), ("insight", "Insights", 4, 100, False))
HEADER, MIN_STRENGTH, MAX_CHARS, SUMMARY_STRENGTH = "## User Profile\n\n", 0.6, 2000, 0.7


def confident(nodes: DataFrame, min_strength: float = MIN_STRENGTH, limit: int | None = 500) -> DataFrame:
    """Strong nodes that are neither temporary nor up for pruning or review, with ``place``."""
    fine = ~F.coalesce("inspection_verdict", F.lit("")).isin("prune", "review") & (F.col("strength") >= min_strength) & (F.col("node_type") != "temp")
    rows = (nodes if limit is None else all_nodes(nodes, limit)).where(fine)
    order = [F.desc("strength"), F.desc(F.coalesce("access_count", F.lit(0))), "id"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("node_type").orderBy(*order)))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sections(nodes: DataFrame, min_strength: float = MIN_STRENGTH, limit: int | None = 500) -> DataFrame:
    """(n, node_type, section): the sections that have text, in order.

    Caps apply to items before blank ones go; per-type ranks keep the shipped rows few.
    """
    rows = confident(nodes, min_strength, limit)
    out = None
    for n, (kind, title, most, chars, drop_blank) in enumerate(SECTIONS):
        item = truncated(stripped(F.col("content")), chars)
        part = rows.where((F.col("node_type") == kind) & (F.col("place") <= most)).select("place", item.alias("item"))
        if drop_blank:
            part = part.where("item <> ''")
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: F.concat(F.lit("- "), x["item"])), "\n")
        made = part.agg(F.count("*").alias("c"), lines.alias("t")).where("c > 0").select(F.lit(n).alias("n"), F.lit(kind).alias("node_type"), F.concat(F.lit(f"**{title}**:\n"), "t", F.lit("\n")).alias("section"))
        out = made if out is None else out.unionByName(made)
    return out


def profile(nodes: DataFrame, min_strength: float = MIN_STRENGTH, max_chars: int = MAX_CHARS, limit: int | None = 500) -> DataFrame:
    """One row (profile): sections that fit one after the other, a section that would
    overflow is skipped whole; '' if none does."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "section"))), lambda x: x["section"])
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def add(acc, s):
        fits = acc["used"] + F.length(s) <= max_chars
        return F.struct(F.when(fits, acc["used"] + F.length(s)).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], s)).otherwise(acc["kept"]).alias("kept"))

    kept = sections(nodes, min_strength, limit).agg(F.aggregate(parts, start, add)["kept"].alias("kept"))
    return kept.select(F.when(F.size("kept") > 0, F.concat(F.lit(HEADER), F.array_join("kept", "\n"))).otherwise("").alias("profile"))


def summary_line(nodes: DataFrame, limit: int | None = 500) -> DataFrame:
    """One row (summary): counts of preferences and facts and the top memory; '' if none."""
    rows = confident(nodes, SUMMARY_STRENGTH, limit)
    order = F.struct((-F.col("strength")).alias("s"), (-F.coalesce("access_count", F.lit(0))).alias("a"), "id")
    a = rows.agg(F.count("*").alias("n"), F.count_if(F.col("node_type") == "preference").alias("p"), F.count_if(F.col("node_type") == "fact").alias("f"), F.min_by("content", order).alias("top"))
    known = F.concat_ws(", ", F.when(F.col("p") > 0, F.concat("p", F.lit(" preferences"))), F.when(F.col("f") > 0, F.concat("f", F.lit(" facts"))))
    stats = F.when(known != "", known).otherwise(F.concat("n", F.lit(" memories")))
    top = F.replace(F.substring("top", 1, 60), F.lit("\n"), F.lit(" "))
    return a.select(F.when(F.col("n") > 0, F.concat(F.lit("[Profile: "), stats, F.lit(" | Top: "), top, F.lit("]"))).otherwise("").alias("summary"))


def generate_profile(nodes: DataFrame, min_strength: float = MIN_STRENGTH, max_chars: int = MAX_CHARS) -> str:
    return profile(nodes, min_strength, max_chars).first()[0]


def generate_summary_line(nodes: DataFrame) -> str:
    return summary_line(nodes).first()[0]
