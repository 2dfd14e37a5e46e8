"""The search index of a store, as a log of segments.

Every change writes one segment: the postings of the nodes that it wrote, and as *dead* rows
the nodes that it replaced or deleted. Nothing written is written again, but for merges: the
newest segments are merged while they are not much smaller than the one before them, so there
are about log n of them. Sums of nodes and words are kept with each segment, so a search reads
no lengths, and a term's count of nodes comes from the segments' blocks.

A segment is made without a shuffle: each task puts its nodes in order of length and cuts them
into blocks of ``BLOCK``; its postings are worked out in runs of about ``RUN`` characters, each
sorted by term, so pages of the files tell which terms they hold. The first posting of a term in
a block carries the block's number of nodes, largest count and least length, which bound what a
node of the block can score: :func:`recollect.operators.search.top_hits` opens only blocks that
can still matter. Where a run ends within a block, that has two such rows for a term.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ner import segmented
from ..functions.text import search_tokens

#: Nodes a block (a power of two); a segment is merged with the one before it unless that is this many times larger.
BLOCK, TIER = 128, 4
#: Characters of tokens that a task holds as postings at once.
RUN = 16 << 20
_POSTINGS = "seg long, term string, block long, node_id string, col string, positions array<int>, dl long, n long, max_tf long, min_dl long"
_NODES = "node_id string, content string, content_zh string, dl long, block long"
_DEAD = "seg long, node_id string, dl long, terms array<string>"


def tokenized(nodes: DataFrame, zh: Column | None = None, segment=None) -> DataFrame:
    """(node_id, content, content_zh, dl): the tokens of both columns and their number."""
    if zh is None and segment is not None:
        zh = segmented(F.col("content"), segment)
    none = F.array().cast("array<string>")
    rows = nodes.select(F.col("id").alias("node_id"), search_tokens(F.col("content")).alias("content"), (none if zh is None else search_tokens(zh)).alias("content_zh"))
    return rows.withColumn("dl", (F.size("content") + F.size("content_zh")).cast("long"))


def postings_of(rows: DataFrame, *keep: str) -> DataFrame:
    """(term, node_id, col, positions, dl) of tokenized nodes, with the columns ``keep``."""
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("tokens")) for c in ("content", "content_zh")])).alias("x")
    words = rows.select("node_id", "dl", *keep, both).select("node_id", "dl", *keep, F.col("x.col").alias("col"), F.posexplode("x.tokens").alias("pos", "term"))
    return words.groupBy("term", "node_id", "col", "dl", *keep).agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("term", "node_id", "col", "positions", "dl", *keep)


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, the words) of tokens joined by blanks."""
    parts = pa.compute.split_pattern(texts, " ")
    words = parts.flatten()
    some = pa.compute.greater(pa.compute.binary_length(words), 0)  # a text without tokens is one empty part
    rows = pa.compute.list_parent_indices(parts).filter(some)
    return np.bincount(rows.to_numpy(), minlength=len(texts)), words.filter(some)


def _run_postings(seg: int, held: pa.Table) -> pa.RecordBatch:
    """The postings of some whole nodes, by term, block, node and column."""
    rows, both = held.num_rows, [words_in(held.column(c).combine_chunks()) for c in ("content", "content_zh")]
    words = pa.concat_arrays([w for _, w in both]).dictionary_encode()
    kinds = words.dictionary
    order = pa.compute.array_sort_indices(kinds).to_numpy()
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    term = rank[words.indices.to_numpy()]
    row = np.concatenate([np.repeat(np.arange(rows), n) for n, _ in both])
    col = np.repeat([0, 1], [int(n.sum()) for n, _ in both])
    pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n, _ in both])
    block, dl = held.column("block").to_numpy(), held.column("dl").to_numpy()
    node = held.column("node_id").combine_chunks()
    place = np.empty(rows, np.int64)  # of a row by block and id
    place[np.lexsort((pa.compute.rank(node, tiebreaker="first").to_numpy(), block))] = np.arange(rows)
    key = (term * rows + place[row]) * 2 + col
    by = np.argsort(key, kind="stable")  # positions of a key are in order already
    key, at = key[by], row[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(first, len(key)).astype(np.int32)
    tf = np.diff(ends).astype(np.int64)
    term, at, col = key[first] // (2 * rows), at[first], key[first] % 2
    n = most = least = np.zeros(0, np.int64)
    opens = np.zeros(len(first), bool)
    if len(first):
        new = np.diff(key[first] // 2, prepend=-1) != 0  # a node counts once, with both columns
        heads = np.flatnonzero(new)
        both_tf = np.add.reduceat(tf, heads)
        opens = (np.diff(term, prepend=-1) != 0) | (np.diff(block[at], prepend=-1) != 0)
        groups = np.searchsorted(heads, np.flatnonzero(opens))
        n, most, least = np.diff(np.append(groups, len(heads))), np.maximum.reduceat(both_tf, groups), np.minimum.reduceat(dl[at[heads]], groups)

    def told(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(first), np.int64)
        out[opens] = values
        return pa.array(out, mask=~opens)

    columns = {
        "seg": pa.array(np.full(len(first), seg, np.int64)),
        "term": kinds.take(pa.array(order[term])),
        "block": pa.array(block[at]),
        "node_id": node.take(pa.array(at)),
        "col": pa.array(np.array(["content", "content_zh"])[col], pa.string()),
        "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[by].astype(np.int32))),
        "dl": pa.array(dl[at]),
        "n": told(n),
        "max_tf": told(most),
        "min_dl": told(least),
    }
    return pa.RecordBatch.from_pydict(columns)


def _postings_by_run(seg: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            # a batch may be large: it is cut where its texts reach a run
            ends = np.cumsum(sum(pa.compute.binary_length(batch.column(c)).to_numpy() for c in ("content", "content_zh")))
            low = 0
            while low < batch.num_rows:
                base = ends[low - 1] if low else 0
                high = min(batch.num_rows, int(np.searchsorted(ends, base + RUN - size)) + 1)
                held.append(batch.slice(low, high - low))
                size += int(ends[high - 1] - base)
                low = high
                if size >= RUN:
                    yield _run_postings(seg, pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield _run_postings(seg, pa.Table.from_batches(held))

    return run


@dataclass(frozen=True)
class Segment:
    """``n`` and ``words`` are what the segment adds to the sums, less its dead nodes; ``size``
    its rows of nodes, living and dead."""

    name: str
    seg: int
    n: int
    words: int
    size: int
    dead: int


@dataclass(frozen=True)
class StoredIndex:
    """Segments below ``path``, oldest first."""

    spark: SparkSession
    path: str
    segments: tuple[Segment, ...] = ()

    # ---- reading

    def _read(self, kind: str, schema: str, segments=None) -> DataFrame:
        names = [s.name for s in (self.segments if segments is None else segments)]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}/{kind}" for n in names])

    @property
    def dead(self) -> DataFrame:
        return self._read("dead", _DEAD, [s for s in self.segments if s.dead])

    @property
    def postings(self) -> DataFrame:
        """Postings of living nodes; filters on terms and blocks reach the scan."""
        rows = self._read("postings", _POSTINGS).select("seg", "term", "block", "node_id", "col", "positions", "dl")
        if not any(s.dead for s in self.segments):
            return rows
        gone = self.dead.select(F.col("node_id").alias("_id"), F.col("seg").alias("_seg"))
        return rows.join(gone, (F.col("node_id") == F.col("_id")) & (F.col("_seg") > F.col("seg")), "left_anti")

    @property
    def blocks(self) -> DataFrame:
        """(seg, term, block, n, max_tf, min_dl); a block may have more than one row for a term."""
        return self._read("postings", _POSTINGS).where("n IS NOT NULL").select("seg", "term", "block", "n", "max_tf", "min_dl")

    @property
    def words(self) -> DataFrame:
        """(node_id, content, content_zh, dl) of all nodes that were written; words are joined by blanks."""
        return self._read("nodes", _NODES)

    @property
    def terms(self) -> DataFrame:
        """The dictionary; a term may stay that only dead nodes have."""
        return self.blocks.select("term").distinct()

    @property
    def totals(self) -> DataFrame:
        """One row (n, words), from the sums."""
        return self.spark.createDataFrame([(float(sum(s.n for s in self.segments)), sum(s.words for s in self.segments))], "n double, words long")

    def counts(self, terms: list[str]) -> dict[str, int]:
        """Number of living nodes that have each term."""
        rows = self.blocks.where(F.col("term").isin(*terms)).select("term", "n")
        if any(s.dead for s in self.segments):
            wanted = F.array(*map(F.lit, terms))
            rows = rows.unionByName(self.dead.select(F.explode(F.array_intersect("terms", wanted)).alias("term"), F.lit(-1).cast("long").alias("n")))
        found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return {t: found.get(t, 0) for t in terms}

    # ---- writing

    def to_json(self) -> str:
        return json.dumps([vars(s) for s in self.segments])

    @staticmethod
    def from_json(spark: SparkSession, path: str, text: str | None) -> StoredIndex:
        return StoredIndex(spark, path, tuple(Segment(**s) for s in json.loads(text or "[]")))

    def _write(self, rows: DataFrame, seg: int, dead: DataFrame | None, few: bool = False) -> Segment:
        """A segment of tokenized nodes (as lists or as they are stored) and of tokenized dead ones;
        ``few`` rows are one file each."""
        name = f"seg-{seg:08d}-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        joined = [c if rows.schema[c].dataType.simpleString() == "string" else F.array_join(c, " ").alias(c) for c in ("content", "content_zh")]
        placed = (rows.coalesce(1) if few else rows).select("node_id", *joined, "dl").sortWithinPartitions("dl", "node_id")
        placed.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)).write.parquet(f"{at}/nodes")
        nodes = self.spark.read.schema(_NODES).parquet(f"{at}/nodes")
        sizes = nodes.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
        nodes.mapInArrow(_postings_by_run(seg), _POSTINGS).write.parquet(f"{at}/postings")
        gone = [0, 0]
        if dead is not None:
            dead.select(F.lit(seg).cast("long").alias("seg"), "node_id", "dl", F.array_union("content", "content_zh").alias("terms")).write.parquet(f"{at}/dead")
            gone = self.spark.read.schema(_DEAD).parquet(f"{at}/dead").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return Segment(name, seg, sizes["n"] - gone[0], (sizes["words"] or 0) - gone[1], sizes["n"] + gone[0], gone[0])

    def changed(self, before: DataFrame, after: DataFrame, ids: DataFrame | list[str], segment=None) -> StoredIndex:
        """The index after nodes with an id in ``ids`` (a table, or a list of few) were written,
        replaced or deleted; of both tables only the rows with these ids are read as texts."""
        few = isinstance(ids, list)
        of = lambda nodes: nodes.where(F.col("id").isin(ids)) if few else nodes.join(ids.select("id").distinct(), "id", "left_semi")
        new, old = tokenized(of(after), segment=segment), tokenized(of(before), segment=segment)
        seg = max((s.seg for s in self.segments), default=0) + 1
        made = self._write(new, seg, old if self.segments else None, few)
        return replace(self, segments=(*self.segments, made)).merged() if made.size else self

    def merged(self, whole: bool = False) -> StoredIndex:
        """Merges the newest segments while they are not much smaller than those before them
        (``whole``: all). Texts are not read: nodes are put together from their postings."""
        many = len(self.segments) if whole else 1
        while many < len(self.segments) and TIER * sum(s.size for s in self.segments[-many:]) >= self.segments[-many - 1].size:
            many += 1
        if many < 2 and not (whole and self.segments):
            return self
        old, young = self.segments[: len(self.segments) - many], self.segments[len(self.segments) - many :]
        seg = young[-1].seg
        rows = replace(self, segments=young)
        living = self._nodes(young).join(rows.dead.select(F.col("node_id").alias("_id"), F.col("seg").alias("_seg")), (F.col("node_id") == F.col("_id")) & (F.col("_seg") > F.col("seg")), "left_anti").drop("seg")
        dead = None
        if old:
            # of the dead those that an older segment has: what died within the merged ones is gone for good
            born = self._nodes(young).select(F.col("node_id").alias("_id"), F.col("seg").alias("_seg"))
            dead = rows.dead.join(born, (F.col("node_id") == F.col("_id")) & (F.col("_seg") < F.col("seg")), "left_anti")
            dead = dead.select("node_id", "dl", F.col("terms").alias("content"), F.array().cast("array<string>").alias("content_zh"))
        made = self._write(living, seg, dead)
        return replace(self, segments=(*old, made))

    def _nodes(self, segments) -> DataFrame:
        """(seg, node_id, content, content_zh, dl) of the segments' nodes, dead ones included; words
        stay joined as they are stored."""
        out = None
        for s in segments:
            part = self.spark.read.schema(_NODES).parquet(f"{self.path}/{s.name}/nodes").select(F.lit(s.seg).cast("long").alias("seg"), "node_id", "content", "content_zh", "dl")
            out = part if out is None else out.unionByName(part)
        return out


def build(spark: SparkSession, path: str, nodes: DataFrame, segment=None) -> StoredIndex:
    """An index of all ``nodes`` below ``path``, as one segment."""
    empty = StoredIndex(spark, path)
    made = empty._write(tokenized(nodes, segment=segment), 1, None)
    return replace(empty, segments=(made,) if made.size else ())
