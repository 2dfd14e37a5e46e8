"""Graph tables derived from the test tables, with one fixed clock."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LINKS, NODES
from .segments import StoredIndex, build
from .store import GraphState, shared_folder

NOW = 1720000000
START = 1700000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _created(doc_id) -> F.Column:
    return F.lit(START) + ((doc_id * 7919) % 200) * 86400


def nodes(spark: SparkSession, sf_dir: str, outcome: bool = True) -> DataFrame:
    """A node for each document; without ``outcome`` (null) texts meet no labels, which large tables do by a shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    kinds, rates = ("preference", "fact", "decision", "insight", "process", "temp"), (0.01, 0.05, 0.03, 0.04, 0.07, 0.10)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % 6 + 1).cast("int"))
    columns = {
        "id": F.concat(F.lit("d"), i),
        "content": F.col("text"),
        "node_type": pick(kinds),
        "strength": ((i * 37) % 100).cast("double") / 100,
        "created_at": _created(i),
        "last_accessed": F.when(i % 3 != 0, _created(i) + (i % 50) * 86400),
        "access_count": i % 11,
        "decay_rate": pick(rates),
        "entities": F.array("lang", "source"),
        "outcome": F.when(F.col("quality") == 0, "FAILURE").when(F.col("quality") == 1, "SUCCESS"),
        "last_inspected": F.lit(None),
        "inspection_verdict": F.lit(None),
    }
    d = d.join(labels, "doc_id", "left") if outcome else d.withColumn("quality", F.lit(None))
    return d.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in NODES])


_INDEXES: dict[tuple, StoredIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The stored search index of :func:`nodes`, written when an application first asks for it
    and again when a file of the table has changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = table(spark, sf_dir, "documents").inputFiles()
    status = [at(f).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at(f)) for f in files]
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted((f, s.getLen(), s.getModificationTime()) for f, s in zip(files, status))))
    if key not in _INDEXES:
        _INDEXES[key] = build(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", nodes(spark, sf_dir, outcome=False))
    return _INDEXES[key]


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families of links: to one of the first 200 documents, and to the next document."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    relation = F.element_at(F.array(*map(F.lit, ("contradicts", "example_of", "inspired_by", "related_to"))), (i % 4 + 1).cast("int"))
    common = [_created(i).cast("long").alias("created_at"), F.lit(None).cast("long").alias("last_traversed"), F.lit(0).cast("long").alias("traverse_count")]
    source = F.concat(F.lit("d"), i).alias("source_id")
    weight = lambda k: ((F.lit(10) + (i * k) % 90).cast("double") / 100).alias("weight")
    one = d.select((2 * i + 1).alias("id"), source, F.concat(F.lit("d"), (i * 7 + 3) % 200).alias("target_id"), relation.alias("relation"), weight(13), *common)
    following = d.select((i - 1).alias("doc_id"))
    two = d.join(following, "doc_id", "left_semi").select((2 * i + 2).alias("id"), source, F.concat(F.lit("d"), i + 1).alias("target_id"), F.lit("extends").alias("relation"), weight(29), *common)
    return one.unionByName(two).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LINKS])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.count("*").alias("turn_count")).select("id", F.lit(START).cast("long").alias("started_at"), F.lit(None).cast("long").alias("ended_at"), "turn_count")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_id, signal, seq): what events say about links."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    signal = F.when(kind.isin("purchase", "signup"), 1.0).when(kind == "error", -1.0).otherwise(0.0)
    return e.select((2 * (F.col("user_id") % 200) + 1).alias("link_id"), signal.alias("signal"), F.struct("ts", "event_id").alias("seq"))


def state(spark: SparkSession, sf_dir: str) -> GraphState:
    return GraphState(nodes(spark, sf_dir), links(spark, sf_dir), sessions(spark, sf_dir), 1 << 40)


# The same tables as common table expressions for DuckDB.
SQL = f"""
nodes AS (
  SELECT 'd' || d.doc_id AS id, d.text AS content,
         ['preference', 'fact', 'decision', 'insight', 'process', 'temp'][CAST(d.doc_id % 6 + 1 AS INT)] AS node_type,
         CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS strength,
         {START} + ((d.doc_id * 7919) % 200) * 86400 AS created_at,
         CASE WHEN d.doc_id % 3 <> 0 THEN {START} + ((d.doc_id * 7919) % 200) * 86400 + (d.doc_id % 50) * 86400 END AS last_accessed,
         d.doc_id % 11 AS access_count,
         [0.01::DOUBLE, 0.05::DOUBLE, 0.03::DOUBLE, 0.04::DOUBLE, 0.07::DOUBLE, 0.10::DOUBLE][CAST(d.doc_id % 6 + 1 AS INT)] AS decay_rate,
         [d.lang, d.source] AS entities,
         CASE l.quality WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'SUCCESS' END AS outcome,
         CAST(NULL AS BIGINT) AS last_inspected, CAST(NULL AS VARCHAR) AS inspection_verdict
  FROM documents d LEFT JOIN labels l USING (doc_id)),
links AS (
  SELECT 2 * doc_id + 1 AS id, 'd' || doc_id AS source_id, 'd' || ((doc_id * 7 + 3) % 200) AS target_id,
         ['contradicts', 'example_of', 'inspired_by', 'related_to'][CAST(doc_id % 4 + 1 AS INT)] AS relation,
         CAST(10 + (doc_id * 13) % 90 AS DOUBLE) / 100 AS weight,
         {START} + ((doc_id * 7919) % 200) * 86400 AS created_at, CAST(NULL AS BIGINT) AS last_traversed, 0 AS traverse_count
  FROM documents
  UNION ALL
  SELECT 2 * doc_id + 2, 'd' || doc_id, 'd' || (doc_id + 1), 'extends', CAST(10 + (doc_id * 29) % 90 AS DOUBLE) / 100,
         {START} + ((doc_id * 7919) % 200) * 86400, NULL, 0
  FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents))
"""
