"""A stream of link feedback into a stored graph. An extension: the batch operators are
the same as without a stream.

Each micro-batch is one version of the store. A version carries, in the same atomic step,
the last batch of each stream that it holds, so a batch that is replayed after a failure
changes nothing, wherever the failure was.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dynamics import on_traverse
from ..sources.store import Conflict, GraphState

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def as_feedback(events: DataFrame) -> DataFrame:
    """(link_id, signal, seq, ts) of event rows."""
    kind = F.col("event_type")
    signal = F.when(kind.isin("purchase", "signup"), 1.0).when(kind == "error", -1.0).otherwise(0.0)
    return events.select((2 * (F.col("user_id") % 200) + 1).alias("link_id"), signal.alias("signal"), F.struct("ts", "event_id").alias("seq"), "ts")


def feedback_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, name: str = "feedback") -> StreamingQuery:
    """Applies a streaming DataFrame of (link_id, signal, seq, ts) to the graph at ``path``.

    Uses of a link apply in order within a batch; batches apply in order of arrival. Streams
    with checkpoints of their own need names of their own. A version that someone else
    publishes meanwhile is taken as the base.
    """
    writer = events.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, path, name)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def apply_batch(batch: DataFrame, number: int, path: str, name: str = "feedback") -> None:
    """One batch, once: nothing happens if the store holds it already."""
    now = batch.agg(F.max("ts").cast("long")).first()[0]
    while now is not None:
        state = GraphState.load(batch.sparkSession, path)
        if state.marks.get(name, -1) >= number:
            return
        links = on_traverse(state.links, batch.select("link_id", "signal", "seq"), now)
        try:
            state.with_(links=links, marks={**state.marks, name: number}).save(path, after=state.version)
            return
        except Conflict:
            time.sleep(0.5)  # the other version may still be on its way


def hourly_signals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts of signals by hour and link, late rows up to the watermark."""
    return as_feedback(events).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "link_id").agg(F.count("*").alias("n"), F.sum("signal").alias("total"))
