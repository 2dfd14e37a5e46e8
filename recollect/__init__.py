"""recollect: a graph of text memories as DataFrames.

    from recollect import Memory
    memory = Memory.open(spark, "hdfs:///memories")

Nodes, links and sessions are tables; every operator is a function from tables to tables.
"""

from __future__ import annotations

from .functions.ner import extract_entities, extract_implicit_references, normalize_entity
from .operators.consolidation import ConsolidationReport, rebuild_fts, run_consolidation
from .operators.dynamics import daily_decay, on_traverse, sigmoid
from .operators.inspection import InspectionReport, apply_prune, run_inspection
from .operators.profile import generate_profile, generate_summary_line
from .operators.retrieval import RecallTier, memory_link, memory_recall, memory_write, retrieve, write_memory
from .operators.walk import score_path, walk_graph
from .schema import DECAY_RATES, VALID_NODE_TYPES, VALID_OUTCOMES, VALID_RELATIONS, VALID_VERDICTS
from .sources.store import GraphState, Memory

__all__ = [
    "DECAY_RATES",
    "VALID_NODE_TYPES",
    "VALID_OUTCOMES",
    "VALID_RELATIONS",
    "VALID_VERDICTS",
    "ConsolidationReport",
    "GraphState",
    "InspectionReport",
    "Memory",
    "RecallTier",
    "apply_prune",
    "daily_decay",
    "extract_entities",
    "extract_implicit_references",
    "generate_profile",
    "generate_summary_line",
    "memory_link",
    "memory_recall",
    "memory_write",
    "normalize_entity",
    "on_traverse",
    "rebuild_fts",
    "retrieve",
    "run_consolidation",
    "run_inspection",
    "score_path",
    "sigmoid",
    "walk_graph",
    "write_memory",
]
