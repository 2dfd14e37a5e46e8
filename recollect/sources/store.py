"""Graph state as versioned Parquet.

A state is a value: three DataFrames, the next link id and what streams have applied.
``save`` writes a version beside the old ones, claims a number by creating a file that must
not exist, and publishes the version by renaming one folder; readers take the highest
version. So no two writers ever get one number. A writer that names the version it started
``after`` gets the next one or, if someone else has it, a :class:`Conflict`. A version that
comes from another one holds what changed (:mod:`recollect.sources.layout`), so a conflict
costs a writer its change again, not the table.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LINKS, NODES, SESSIONS, TABLES
from .layout import Stored, differences, from_json, read, to_json, write
from .segments import StoredIndex, build


_META = "next_link_id long, marks map<string,long>, index string, layout string"


class Conflict(RuntimeError):
    """Someone else published the version after the one that a change started from."""


@dataclass(frozen=True)
class GraphState:
    """Nodes, links, sessions; ``next_link_id`` is a high-water mark, so ids are never reused.
    ``marks`` has the last batch that each stream has applied, ``version`` the number this was
    loaded from (0: none), ``index`` names the segments of the search index of that version,
    ``layout`` its files."""

    nodes: DataFrame
    links: DataFrame
    sessions: DataFrame
    next_link_id: int = 1
    marks: dict[str, int] = field(default_factory=dict)
    version: int = 0
    index: str = ""
    layout: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **changes) -> GraphState:
        return replace(self, **changes)

    @staticmethod
    def empty(spark: SparkSession) -> GraphState:
        return GraphState(*(spark.createDataFrame([], s) for s in (NODES, LINKS, SESSIONS)))

    @staticmethod
    def of(nodes: DataFrame, links: DataFrame | None = None, sessions: DataFrame | None = None) -> GraphState:
        """A state from existing tables; the link mark is put past the largest id."""
        spark = nodes.sparkSession
        links = spark.createDataFrame([], LINKS) if links is None else links
        sessions = spark.createDataFrame([], SESSIONS) if sessions is None else sessions
        top = links.agg(F.max("id")).first()[0]
        return GraphState(nodes, links, sessions, (top or 0) + 1)

    def save(self, path: str, after: int | None = None, abandoned: int = 3600, touched: dict | None = None) -> int:
        """Writes a version below ``path``; returns its number: the next free one with whole
        tables, or that after ``after`` with what changed since. A claim without a version that is
        older than ``abandoned`` seconds was left by a writer that died, and is taken over.

        ``touched`` has, by table, a condition that covers all rows that may have changed, the
        table's :func:`differences`, or False where there are none; other tables are compared.
        """
        files, folder = _files(self.spark, path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        number = None if after is None else after + 1
        name = f"_draft-{uuid.uuid4().hex}"
        draft = f"{path}/{name}"
        known = from_json(self.layout) if self.layout and after is not None and after == self.version else {}
        # whole versions have no number yet: their files are found from the version's own folder
        place = "." if number is None else f"v={number:08d}"
        made = {}
        for t, schema in TABLES.items():
            old = read(self.spark, path, known[t], schema) if t in known else None
            made[t] = write(getattr(self, t), old, known.get(t), path, name, place, t, number or 0, (touched or {}).get(t))
        meta = self.spark.createDataFrame([(self.next_link_id, self.marks, self.index, to_json(made))], _META)
        meta.coalesce(1).write.parquet(f"{draft}/meta")
        while True:
            version = (max(_versions(files, folder, claims=True), default=0) if after is None else after) + 1
            claim, place = at(f"{path}/v={version:08d}.claim"), at(f"{path}/v={version:08d}")
            if after is not None and not files.exists(place) and files.exists(claim) and time.time() - files.getFileStatus(claim).getModificationTime() / 1000 > abandoned:
                files.delete(claim, False)
            try:
                files.create(claim, False).close()
            except Py4JJavaError:
                if not files.exists(claim):
                    raise
                if after is None:
                    continue
                files.delete(at(draft), True)
                raise Conflict(f"version {version} of {path} is someone else's") from None
            if files.exists(place) or not files.rename(at(draft), place):
                raise OSError(f"version {version} of {path} cannot be published")
            return version

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> GraphState:
        """The latest (or a given) version; an empty state where there is none."""
        files, folder = _files(spark, path)
        found = _versions(files, folder)
        if not found and version is None:
            return GraphState.empty(spark)
        version = version or max(found)
        at = f"{path}/v={version:08d}"
        meta = spark.read.schema(_META).parquet(f"{at}/meta").first()
        own = lambda where: f"v={version:08d}/{where[2:]}" if where.startswith("./") else where
        stored = from_json(meta["layout"]) if meta["layout"] else {t: Stored(f"./{t}", 0) for t in TABLES}
        stored = {t: replace(s, base=own(s.base)) for t, s in stored.items()}
        tables = {t: read(spark, path, stored[t], schema) for t, schema in TABLES.items()}
        return GraphState(**tables, next_link_id=meta["next_link_id"], marks=dict(meta["marks"] or {}), version=version, index=meta["index"] or "", layout=to_json(stored))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where a session has none, a temporary
    folder serves local sessions (tests); elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or _LOCAL.get(spark.sparkContext.applicationId, "")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="recollect-")
    return named.rstrip("/")


_LOCAL: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out, for loops: a checkpoint in :func:`shared_folder`, which cuts lineage
    and survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """As :func:`settled`, as a Parquet table in :func:`shared_folder`: encoded, so tables of many
    words take a fraction of a checkpoint's room. Partitions and order are not kept."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the file system that Spark takes it to be on, for tasks that open files themselves."""
    files, folder = _files(spark, path)
    uri = files.makeQualified(folder).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _versions(files, folder, claims: bool = False) -> list[int]:
    """Numbers of published versions, or of all that are claimed."""
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return [int(m[1]) for n in names if (m := re.fullmatch(r"v=(\d+)" + r"(?:\.claim)?" * claims, n))]


class Memory:
    """A handle on a stored graph, for callers that want one: each change is a version.

        with Memory.open(spark, path) as memory:
            memory.create_node("n1", "I like Python", "preference")

    It holds the latest state as a value; nothing is shared between handles but the folder. A
    change that meets someone else's version is made again on that. ``segment`` (a function
    from a text to its words) turns the Chinese branch of writing and searching on.

    A store in files keeps a search index: every change adds a segment of the nodes that it
    wrote or deleted, and searches read the index, never the texts. ``indexed=False`` leaves
    the index out; it is then made by the next change through a handle that keeps one.
    """

    def __init__(self, state: GraphState, path: str | None = None, segment=None, indexed: bool = True):
        self.state, self.path, self.segment, self.indexed = state, path, segment, indexed

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, segment=None, indexed: bool = True) -> Memory:
        """The store at ``path``, made on first commit; without a path, one in memory."""
        return cls(GraphState.load(spark, path) if path else GraphState.empty(spark), path, segment, indexed)

    def index(self) -> StoredIndex | None:
        """The search index of the current version; None where the store has none."""
        return StoredIndex.from_json(self.state.spark, f"{self.path}/index", self.state.index) if self.path and self.state.index else None

    def _indexed(self, state: GraphState, ids: list[str] | DataFrame | None) -> str:
        """The segments of ``state``'s index: those of the version that it comes from, and one of what changed."""
        if not self.indexed:
            return ""
        spark, at = state.spark, f"{self.path}/index"
        if not state.index:
            return build(spark, at, state.nodes, self.segment).to_json()
        if isinstance(ids, list) and not ids:
            return state.index
        before = self._base(state).nodes
        if ids is None:
            ids = kept(differences(before, state.nodes)).where("text").select("id")
        return StoredIndex.from_json(spark, at, state.index).changed(before, state.nodes, ids, self.segment).to_json()

    def _base(self, state: GraphState) -> GraphState:
        """The version that ``state`` comes from."""
        return self.state if self.state.version == state.version else GraphState.load(state.spark, self.path, state.version)

    def refresh(self) -> GraphState:
        """The latest version on disk."""
        if self.path:
            self.state = GraphState.load(self.state.spark, self.path)
        return self.state

    def commit(self, state: GraphState, ids: list[str] | None = None, touched: dict | None = None) -> GraphState:
        """Makes ``state`` the current one, on disk too; either way lineage is cut.
        :class:`Conflict` if there is a version that ``state`` does not come from. ``ids`` names
        the nodes whose texts may have changed, ``touched`` rows as in :meth:`GraphState.save`;
        without them both are found by comparing, once for files and index. A table that is the
        version's own has not changed."""
        if self.path:
            if state.version:
                base = self._base(state)
                touched = {t: False for t in TABLES if getattr(state, t) is getattr(base, t)} | (touched or {})
                if touched.get("nodes") is False:
                    ids = [] if ids is None else ids
                elif "nodes" not in touched:
                    touched["nodes"] = kept(differences(base.nodes, state.nodes))
                    ids = touched["nodes"].where("text").select("id") if ids is None else ids
            version = state.with_(index=self._indexed(state, ids)).save(self.path, after=state.version, touched=touched)
            state = GraphState.load(state.spark, self.path, version)
        else:
            state = state.with_(**{name: settled(getattr(state, name)) for name in TABLES})
        self.state = state
        return state

    def change(self, make, tries: int = 10, ids: list[str] | None = None, touched: dict | None = None) -> GraphState:
        """Commits ``make(state)``, again from the latest version after a conflict."""
        for k in range(tries):
            try:
                return self.commit(make(self.state), ids, touched)
            except Conflict:
                time.sleep(min(5, 0.05 * 2**k))  # the other version may still be on its way
                self.refresh()
        raise Conflict(f"{tries} other versions came in between")

    def close(self) -> None:
        """Nothing is held open: state lies in files, or in checkpoints of the session."""

    def __enter__(self) -> Memory:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # reading

    def get_all_nodes(self, limit: int | None = 1000) -> list[dict]:
        from ..operators import crud

        return as_dicts(crud.all_nodes(self.state.nodes, limit))

    def get_all_links(self, limit: int | None = 5000) -> list[dict]:
        from ..operators import crud

        return as_dicts(crud.all_links(self.state.links, limit))

    def search_nodes(self, node_type: str | None = None, min_strength: float = 0.0, limit: int = 50) -> list[dict]:
        from ..operators import crud

        return as_dicts(crud.search_nodes(self.state.nodes, node_type, min_strength, limit))

    def find_nodes_by_entities(self, entities: list[str], min_strength: float = 0.0, limit: int = 50) -> list[tuple[dict, list[str]]]:
        """(node, matched entities), most matches first."""
        from ..operators import crud

        rows = as_dicts(crud.find_by_entities(self.state.nodes, entities, min_strength, limit)) if entities else []
        return [({k: v for k, v in r.items() if k != "matched"}, r["matched"]) for r in rows]

    def get_links(self, node_id: str | None = None, relation: str | None = None, min_weight: float = 0.0, direction: str = "both", limit: int = 100) -> list[dict]:
        from ..operators import crud

        return as_dicts(crud.get_links(self.state.links, node_id, relation, min_weight, direction, limit))

    def fts5_search(self, query: str, limit: int = 20) -> list[dict]:
        """Nodes by full-text search, best first."""
        from ..operators import search

        found = search.search(self.state.nodes, query, limit, self.index(), self.segment)
        return as_dicts(found.orderBy("place").drop("place", "score"))

    # single-row conveniences over the batch operators

    def create_node(self, node_id: str, content: str, node_type: str = "fact", strength: float = 0.5, entities=None, decay_rate=None, now: int | None = None) -> dict:
        from ..operators import crud

        new = self.state.spark.createDataFrame([(node_id, content, node_type, strength, list(entities or []), decay_rate)], "id string, content string, node_type string, strength double, entities array<string>, decay_rate double")
        self.change(lambda s: crud.create_nodes(s, new, _now(now), strict=True), ids=[node_id], touched=_only(nodes=F.col("id") == node_id))
        return self.get_node(node_id)

    def get_node(self, node_id: str) -> dict | None:
        return next(iter(as_dicts(self.state.nodes.where(F.col("id") == node_id).limit(1))), None)

    def update_node(self, node_id: str, **changes) -> dict | None:
        from ..operators import crud

        self.change(lambda s: crud.update_nodes(s, [node_id], changes), ids=[node_id] if "content" in changes else [], touched=_only(nodes=F.col("id") == node_id))
        return self.get_node(node_id)

    def delete_node(self, node_id: str) -> bool:
        from ..operators import crud

        found = self.get_node(node_id) is not None
        if found:
            self.change(lambda s: crud.delete_nodes(s, s.spark.createDataFrame([(node_id,)], "id string")), ids=[node_id], touched=_only(nodes=F.col("id") == node_id, links=(F.col("source_id") == node_id) | (F.col("target_id") == node_id)))
        return found

    def create_link(self, source_id: str, target_id: str, relation: str = "related_to", weight: float = 0.3, now: int | None = None) -> dict:
        from ..operators import crud

        new = self.state.spark.createDataFrame([(source_id, target_id, relation, weight)], "source_id string, target_id string, relation string, weight double")
        after = self.change(lambda s: crud.create_links(s, new, _now(now), strict=True), ids=[], touched=_only(links=(F.col("source_id") == source_id) & (F.col("target_id") == target_id)))
        return self.get_link(after.next_link_id - 1)

    def get_link(self, link_id: int) -> dict | None:
        return next(iter(as_dicts(self.state.links.where(F.col("id") == link_id).limit(1))), None)

    def update_link(self, link_id: int, **changes) -> dict | None:
        from ..operators import crud

        self.change(lambda s: crud.update_links(s, [link_id], changes), ids=[], touched=_only(links=F.col("id") == link_id))
        return self.get_link(link_id)

    def delete_link(self, link_id: int) -> bool:
        from ..operators import crud

        found = self.get_link(link_id) is not None
        if found:
            self.change(lambda s: crud.delete_links(s, s.spark.createDataFrame([(link_id,)], "id long")), ids=[], touched=_only(links=F.col("id") == link_id))
        return found

    def create_session(self, session_id: str, now: int | None = None) -> None:
        from ..operators import crud

        self.change(lambda s: crud.create_sessions(s, s.spark.createDataFrame([(session_id,)], "id string"), _now(now)), ids=[], touched=_only(sessions=F.col("id") == session_id))

    def end_session(self, session_id: str, now: int | None = None) -> None:
        from ..operators import crud

        self.change(lambda s: crud.end_sessions(s, s.spark.createDataFrame([(session_id,)], "id string"), _now(now)), ids=[], touched=_only(sessions=F.col("id") == session_id))

    def increment_turns(self, session_id: str) -> None:
        from ..operators import crud

        self.change(lambda s: crud.increment_turns(s, s.spark.createDataFrame([(session_id,)], "id string")), ids=[], touched=_only(sessions=F.col("id") == session_id))

    def count_nodes(self) -> int:
        return self.state.nodes.count()

    def count_links(self) -> int:
        return self.state.links.count()


def _only(**touched) -> dict:
    """The tables named may change where their conditions hold, no other one does."""
    return {t: touched.get(t, False) for t in TABLES}


def as_dicts(rows: DataFrame) -> list[dict]:
    """Nodes or links as plain values, in order of the columns; a missing entity list is empty."""
    out = [r.asDict(recursive=True) for r in rows.collect()]
    return [{**r, "entities": r["entities"] or []} if "entities" in r else r for r in out]


def _now(now: int | None) -> int:
    return int(time.time()) if now is None else now
