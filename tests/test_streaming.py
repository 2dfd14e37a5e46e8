from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.operators.dynamics import on_traverse
from recollect.sources.store import GraphState
from recollect.streaming.feedback import EVENTS, apply_batch, as_feedback, feedback_stream, hourly_signals
from test_graph import link, links, nodes


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(i, i, 0, ("click", "purchase", "error")[i % 3], 1.0, "{}") for i in range(9)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", F.timestamp_seconds("t")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    state = GraphState.of(nodes(spark, [{"id": "a"}, {"id": "b"}]), links(spark, [link("a", "b", 0.5)]))
    path = f"file://{tmp_path}/store"
    state.save(path)
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    feedback_stream(as_feedback(stream), path, f"{tmp_path}/check").awaitTermination()
    want = on_traverse(state.links, as_feedback(df), 8).first()
    got = GraphState.load(spark, path).links.first()
    assert (got["weight"], got["traverse_count"], got["last_traversed"]) == (want["weight"], 9, 8)
    feedback_stream(as_feedback(stream), path, f"{tmp_path}/check").awaitTermination()  # nothing new
    assert GraphState.load(spark, path).links.first()["traverse_count"] == 9
    assert hourly_signals(df).first()["n"] == 9


def test_a_replayed_batch_changes_nothing_wherever_the_crash_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    GraphState.of(nodes(spark, [{"id": "a"}, {"id": "b"}]), links(spark, [link("a", "b", 0.5)])).save(path)
    batch = spark.createDataFrame([(1, 1.0, 1, 10)], "link_id long, signal double, seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    save, counts = GraphState.save, lambda: GraphState.load(spark, path).links.first()["traverse_count"]

    def dies(before):
        def crash(self, *args, **more):
            if not before:
                save(self, *args, **more)
            raise OSError("lost")

        monkeypatch.setattr(GraphState, "save", crash)
        with pytest.raises(OSError):
            apply_batch(batch, 7, path)
        monkeypatch.setattr(GraphState, "save", save)

    dies(before=True)
    assert counts() == 0
    dies(before=False)
    apply_batch(batch, 7, path)
    assert counts() == 1 and GraphState.load(spark, path).marks == {"feedback": 7}
    apply_batch(batch, 7, path, "another stream")
    GraphState.load(spark, path).save(path)  # versions of others keep the marks
    apply_batch(batch, 7, path)
    assert counts() == 2
