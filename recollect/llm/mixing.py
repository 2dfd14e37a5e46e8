"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 30-bit hash of its id and text. For each source, words are summed by
hash bucket; a budget is a threshold on the hash, and budgets are nested because the hash is
fixed. Only the bucket in which the budget ends is opened again (three levels of 1,024
buckets), so documents are filtered by one comparison and never sorted. Targets and the bucket
of each level are stored (a row a source): each level is read twice by the next one, so as one
plan the levels would be planned and compiled many times over. The few documents of
the one hash at which a budget ends are taken in order of id, and of rows that repeat both
id and text as many as the budget has room for: copies are numbered file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_stored, free_name, stored, table, text_or_empty

MAX_EPOCHS = 3
_BITS = 10


def _size() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _hash() -> Column:
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text_or_empty()).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % (1 << (3 * _BITS))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each text and the document's 30-bit hash."""
    return docs.select("doc_id", "source", _size().alias("size"), _hash().alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): all words shared by weight, none above its cap.

    Sources in code-point order (null last) take the weights in turn. Sharing the excess
    again by weight until none is above ends where every source has min(cap, rate x
    weight) for one rate; the sources at their cap are a prefix in order of cap / weight,
    so running sums over the per-source table find the rate. That table has one row a
    source and is made by a pre-aggregated sum.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    all_rows = Window.partitionBy().orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto, everything = all_rows.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, total_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    # the rate if this source and those after it in the order were the ones below their cap
    per = per.withColumn(
        "rate",
        (total - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (total_weight - F.coalesce(F.sum("weight").over(upto), F.lit(0))),
    ).withColumn("below", F.col("rate") * F.col("weight") <= F.col("cap"))
    rate = F.min(F.when(F.col("below"), F.struct(F.col("cap") / F.col("weight"), F.col("rate").alias("rate")))).over(everything)["rate"]
    target = F.when(rate.isNull() | (F.col("cap") <= rate * F.col("weight")), F.col("cap").cast("double")).otherwise(rate * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _boundary(part: DataFrame, goals: DataFrame, shift: int) -> DataFrame:
    """For each source the bucket where its rest is used up, and the rest left for it."""
    bucket = F.shiftright("h", shift)
    sums = part.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket")
    run = sums.withColumn("upto", F.sum("words").over(w)).join(goals.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    hit = run.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "rest")).alias("x"))
    return hit.select("source", F.col("x.bucket").alias("bucket"), (F.col("x.rest") - (F.col("x.upto") - F.col("x.words"))).alias("rest"), F.col("x.words").alias("words"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, below, edge): a document is taken ``epochs``
    times, once more if h < below. ``edge`` lists the documents at h = below (doc_id, size, n
    copies) with the number of copies that are taken once more, by whole words nearest to the
    budget; documents of one hash are few."""
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(0)
    goals = goals.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.when(F.col("epochs") < MAX_EPOCHS, F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))).otherwise(0.0)
    )
    goals = stored(goals, "mix-goals")
    part, at, held = sizes.where("size > 0"), goals, [goals]
    for shift in (2 * _BITS, _BITS, 0):
        at = stored(_boundary(part, at, shift), "mix-bucket")
        held.append(at)
        edge = at.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
        part = part.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("b"))).drop("s", "b")
    ends = at.select(F.col("source").alias("s"), F.col("bucket").alias("below"), F.col("rest").alias("left"))
    kinds = part.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")).join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    before = Window.partitionBy("source").orderBy(F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(room / F.col("size") - 0.5) + 1)).cast("long")
    kinds = kinds.withColumn("more", more).groupBy(F.col("source").alias("e")).agg(F.collect_list(F.struct("doc_id", "size", "n", "more")).alias("edge"))
    rows = goals.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").join(kinds, F.col("source").eqNullSafe(F.col("e")) & F.col("below").isNotNull(), "left")
    below = F.coalesce("below", F.when(F.col("rest") > 0, 1 << (3 * _BITS)).otherwise(0))
    plan = stored(rows.select("source", "source_size", "target", "epochs", below.alias("below"), "edge"), "mix-plan")
    for small in held:
        drop_stored(small)
    return plan


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, h and more) with source_size, target and ``_times``."""
    p = plan.withColumnRenamed("source", "_s")
    mine = F.try_element_at(F.filter("edge", lambda x: x["doc_id"].eqNullSafe(F.col("doc_id")) & (x["size"] == F.col("size"))), F.lit(1))
    at_edge = F.when(mine["more"] == mine["n"], 1).when(mine["more"] == 0, 0)  # null: some of the copies
    extra = F.when(F.col("h") < F.col("below"), 1).when(F.col("h") > F.col("below"), 0).otherwise(at_edge)
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_edge", mine).withColumn("_times", F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + extra).cast("long"))
    drop = ["_s", "_edge", "edge", "below", "epochs"]
    some = plan.where(F.exists("edge", lambda x: (x["more"] > 0) & (x["more"] < x["n"])))
    if some.isEmpty():
        return joined.drop(*drop)
    # rows that nothing tells apart: any of them may be taken, so their place in the files of a table decides
    copies = stored(joined.where("_times IS NULL"), "mix-copies").withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    files = copies.groupBy(F.col("source").alias("_fs"), F.col("_file").alias("_ff")).agg(F.count("*").alias("_n"))
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_fs").orderBy("_ff").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("source", "_file").orderBy("_row"))
    copies = copies.withColumn("_nth", nth).join(files, F.col("source").eqNullSafe(F.col("_fs")) & (F.col("_file") == F.col("_ff")))
    copies = copies.withColumn("_times", (F.col("epochs") + F.when(F.col("_before") + F.col("_nth") <= F.col("_edge.more"), 1).otherwise(0)).cast("long"))
    return joined.where("_times IS NOT NULL").drop(*drop).unionByName(copies.drop(*drop, "_file", "_row", "_fs", "_ff", "_n", "_before", "_nth"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """All documents with the words the mix takes of each.

    Returns doc_id, source, size, source_size, target, taken, times. Null text: size 0, never
    taken; null source: a source of its own, last in order; null ids are hashed by their text;
    rows that repeat id and text are copies, of which any may be taken; an empty table gives
    no rows; other columns are ignored.
    """
    sizes = stored(sized(docs), "mix-sizes")
    plan = thresholds(sizes, source_targets(sizes, weights))
    return _decided(sizes, plan).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"), F.col("_times").alias("times"))


def taken(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` with ``times`` (how often the mix takes a document) and ``taken`` (words).

    Cases are those of :func:`mix`. All columns of ``docs`` stay; where one has such a name
    already, the new one is called ``times_`` or ``taken_``.
    """
    sizes = stored(sized(docs), "mix-sizes")
    plan = thresholds(sizes, source_targets(sizes, weights))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", _size().alias("size"), _hash().alias("h"))
    times, words = (free_name(docs.columns, n) for n in ("times", "taken"))
    return _decided(rows, plan).select("row.*", F.col("_times").alias(times), (F.col("size") * F.col("_times")).alias(words))


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 8)) AS BIGINT) % 1073741824 AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, ((SELECT sum(source_size) FROM c) - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(w) FROM c) - coalesce(sum(w) OVER o, 0)) AS rate
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(rate, cap / w) AS rate FROM r WHERE rate * w <= cap),
t AS (
  SELECT source, source_size,
         CASE WHEN f.rate IS NULL OR cap <= f.rate * w THEN CAST(cap AS DOUBLE) ELSE f.rate * w END AS target
  FROM c, f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM t),
g AS (
  SELECT *, CASE WHEN epochs < 3 THEN greatest(target - epochs * source_size, 0) ELSE 0 END AS rest FROM e),
u AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.epochs, g.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END END AS times FROM u)
SELECT doc_id, source, size, source_size, target, CAST(size * times AS BIGINT) AS taken, CAST(times AS BIGINT) AS times FROM n
"""
