"""Types and vocabularies of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: daily decay rate of a node's links by node type
DECAY_RATES = {"preference": 0.01, "fact": 0.05, "decision": 0.03, "insight": 0.04, "process": 0.07, "temp": 0.10}
# fixed values: vocabularies
VALID_NODE_TYPES = frozenset(DECAY_RATES)
VALID_RELATIONS = frozenset({"extends", "contradicts", "example_of", "inspired_by", "related_to"})
VALID_OUTCOMES = frozenset({"SUCCESS", "FAILURE", "pending"})
VALID_VERDICTS = ("keep", "archive", "prune", "review")

NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("node_type", T.StringType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("last_accessed", T.LongType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("decay_rate", T.DoubleType()),
        T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("outcome", T.StringType()),
        T.StructField("last_inspected", T.LongType()),
        T.StructField("inspection_verdict", T.StringType()),
    ]
)
LINKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("relation", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("last_traversed", T.LongType()),
        T.StructField("traverse_count", T.LongType()),
    ]
)
SESSIONS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("started_at", T.LongType()),
        T.StructField("ended_at", T.LongType()),
        T.StructField("turn_count", T.LongType()),
    ]
)
TABLES = {"nodes": NODES, "links": LINKS, "sessions": SESSIONS}
SECONDS_PER_DAY = 86400.0


def default_decay(node_type: Column) -> Column:
    """The decay rate of a node type."""
    rates = F.create_map(*[F.lit(x) for kv in DECAY_RATES.items() for x in kv])
    return F.try_element_at(rates, node_type)
