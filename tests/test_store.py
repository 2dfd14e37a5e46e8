"""Versions as changes upon a base: what is written, what is read, who waits for whom."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recollect import GraphState, Memory
from recollect.operators import search
from recollect.sources import layout, store
from recollect.sources.layout import Stored, changed_rows, read, write

from test_graph import NOW, link, links, nodes


def rows_of(df):
    return sorted(map(str, df.collect()))


def size_of(folder) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_changes_and_compactions_follow_a_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "LEAST", 6)
    monkeypatch.setattr(layout, "MOST", 4)
    rng = random.Random(3)
    schema = links(spark, []).schema
    held = {i: round(rng.random(), 3) for i in range(1, 60)}
    frame = lambda: links(spark, [link(f"s{i % 7}", f"t{i}", w, id=i) for i, w in held.items()])
    known, bases = None, set()
    for version in range(1, 10):
        old = read(spark, str(tmp_path), known, schema) if known else None
        ids = rng.sample(range(1, 70), 4)
        if known:
            for i in ids:
                if i in held and rng.random() < 0.5:
                    del held[i]
                else:
                    held[i] = round(rng.random(), 3)
        touched = F.col("id").isin(ids) if version % 2 else None  # named, or found by comparing
        known = write(frame(), old, known, str(tmp_path), f"v{version}", f"v{version}", "links", version, touched)
        bases.add(known.base)
        found = read(spark, str(tmp_path), known, schema)
        assert {r["id"]: r["weight"] for r in found.collect()} == held and found.columns == schema.fieldNames()
    assert len(bases) > 2 and write(frame(), found, known, str(tmp_path), "x", "x", "links", 99, None) == known  # nothing changed
    assert write(frame(), found, known, str(tmp_path), "y", "y", "links", 99, False) is known


def test_changed_rows_are_the_differences(spark):
    a = nodes(spark, [{"id": "same"}, {"id": "text", "content": "old"}, {"id": "gone"}, {"id": "list", "entities": ["a"]}])
    b = nodes(spark, [{"id": "same"}, {"id": "text", "content": "new"}, {"id": "list", "entities": ["a", None]}, {"id": "born"}])
    got = {(r["id"], r["_deleted"]) for r in changed_rows(a, b, None).collect()}
    assert got == {("text", False), ("list", False), ("born", False), ("gone", True)}


def test_a_row_writes_a_row(spark, tmp_path):
    path = f"{tmp_path}/store"
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(str(k))), 512) for k in range(6)])
    many = spark.range(5000).select(F.format_string("n%05d", "id").alias("id"), F.lit("fact").alias("node_type"), F.lit(0.5).alias("strength"))
    made = nodes(spark, []).unionByName(many.withColumn("content", text), allowMissingColumns=True)
    web = spark.range(20_000).select(F.col("id"), F.format_string("n%05d", F.col("id") % 5000).alias("source_id"), F.format_string("n%05d", (F.col("id") * 7 + 1) % 5000).alias("target_id"), F.lit("related_to").alias("relation"), F.lit(0.5).alias("weight"))
    with Memory.open(spark, path, indexed=False) as m:
        m.commit(GraphState.of(made, links(spark, []).unionByName(web, allowMissingColumns=True)))
        whole = size_of(f"{path}/v=00000001")
        m.create_node("new", "one more", now=NOW)
        m.update_node("n00007", strength=0.9)
        m.create_link("new", "n00007", now=NOW)
        m.delete_node("n00003")
    for version in range(2, 6):
        assert size_of(f"{path}/v={version:08d}") < 20_000 < whole / 50, version
    state = GraphState.load(spark, path)
    assert state.nodes.count() == 5000 and state.links.count() == 20_000 + 1 - 8
    assert state.nodes.where("id = 'n00007'").first()["strength"] == 0.9 and state.nodes.where("id = 'n00003'").isEmpty()
    # lookups: one file of nodes can hold an id, and the filter reaches the scans
    files = list(Path(path, "v=00000001", "nodes").glob("*.parquet"))
    column = pq.ParquetFile(files[0]).schema_arrow.get_field_index("id")
    spans = [(g.column(column).statistics.min, g.column(column).statistics.max) for f in files for meta in [pq.ParquetFile(f).metadata] for g in map(meta.row_group, range(meta.num_row_groups))]
    assert len(files) > 1 and sum(low <= "n01234" <= high for low, high in spans) == 1
    plan = state.nodes.where("id = 'n01234'")._jdf.queryExecution().toString()
    assert plan.count("EqualTo(id,n01234)") >= 2  # base and changes


def test_writers_to_different_keys_both_stay(spark, tmp_path):
    path = f"{tmp_path}/store"
    Memory.open(spark, path).commit(GraphState.of(nodes(spark, [{"id": f"n{i:04}"} for i in range(3000)])))
    one, two = Memory.open(spark, path), Memory.open(spark, path)
    one.update_node("n0001", strength=0.9)
    two.update_node("n0002", strength=0.8)  # makes its change again, and only that
    assert size_of(f"{path}/v=00000003/nodes-changes") < 20_000 and not Path(path, "v=00000003", "nodes").exists()
    found = {r["id"]: r["strength"] for r in GraphState.load(spark, path).nodes.where("id < 'n0004'").collect()}
    assert found == {"n0000": 0.5, "n0001": 0.9, "n0002": 0.8, "n0003": 0.5}


def test_whole_tables_and_comparisons_through_the_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    m = Memory.open(spark, path, indexed=False)
    m.commit(GraphState.of(nodes(spark, [{"id": f"n{i}", "strength": 0.5} for i in range(2000)]), links(spark, [link("n1", "n2", 0.5)])))
    m.change(lambda s: s.with_(nodes=s.nodes.withColumn("strength", F.when(F.col("id") == "n5", 0.7).otherwise(F.col("strength")))))
    assert layout.from_json(m.state.layout)["nodes"].changes[0][1] == 1 and layout.from_json(m.state.layout)["links"].changes == []
    m.change(lambda s: s.with_(nodes=s.nodes.withColumn("strength", F.col("strength") + 0.1)))
    assert layout.from_json(m.state.layout)["nodes"].changes == []  # most rows changed: a base again
    assert rows_of(GraphState.load(spark, path).nodes.where("id in ('n5', 'n6')").select("id", F.round("strength", 3))) == rows_of(spark.createDataFrame([("n5", 0.8), ("n6", 0.6)], "id string, s double").select("id", F.col("s").alias("round(strength, 3)")))
    assert GraphState.load(spark, path, 2).nodes.where("strength = 0.7").count() == 1  # older versions read as they were
    bare = layout.Stored("./nodes", 5)
    assert bare == Stored(**vars(bare)) and pytest


def test_a_change_compares_texts_once_and_only_what_it_made_anew(spark, tmp_path, monkeypatch):
    compared = []
    real = layout.differences

    def noted(old, new):
        compared.append("nodes" if "content" in old.columns else "other")
        return real(old, new)

    for module in (layout, store):
        monkeypatch.setattr(module, "differences", noted)
    memory = Memory.open(spark, str(tmp_path))
    memory.commit(GraphState.of(nodes(spark, [{"id": f"n{i}", "content": f"word{i}"} for i in range(5)]), links(spark, [])))
    memory.change(lambda s: s.with_(nodes=s.nodes.withColumn("content", F.when(F.col("id") == "n1", "anew").otherwise(F.col("content")))))
    assert compared == ["nodes"]
    memory.change(lambda s: s.with_(links=s.links))
    assert compared == ["nodes"]
    assert [r["node_id"] for r in search.bm25(memory.index(), "anew OR word1").collect()] == ["n1"]
    assert search.bm25(memory.index(), "word1").isEmpty()
