r"""Substring dedup with compressed FM-indexes over shards of text.

A window is WINDOW words. Its anchor is its smallest GRAM-word hash (leftmost), which
depends on the window's words alone, so equal windows have equal anchors. Consecutive
windows with one anchor make a segment of at most WINDOW - GRAM + 1 windows. Text is
sharded by anchor: whatever can equal a window lies in the window's own shard, and no
document is streamed past the shards of other texts.

1. Anchors are counted: places, and unlike segments by task. An anchor at one place only
   cannot hold a repeated window. One of over ``CROWD`` unlike segments (both ends of a
   passage that stands in many texts) is crowded. Both reach the next pass as bitmaps of a
   fixed size; a collision sends more text to the index or splits more of it, no more.
2. Segments of anchors at several places are read again. Equal ones are combined in their
   task: the earliest is the representative and goes on with its words, the others are its
   members, narrow rows that never meet in one task. A crowded anchor's segments go window
   by window, each dealt by its own words.
3. A shard indexes each content once, at its first place (suffix array, wavelet matrix of the
   words themselves), and streams all representatives through backward search: matching
   statistics of whole segments first, of single windows where that is the first place. A
   window that occurs at an earlier place than its own is reported.
4. A member is a repeat where the index found its representative whole.
5. The intervals found are removed from the documents.

Work and rows grow with the text: no pairs are made, and text that is not shared stays where
it is. Segments are combined by anchor and content, 128 bits; only the index reports.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, bitmap, drop_stored, has_bit, mix64, runs, stored, table, windows_hash, word_ids
from .fm_index import FMIndex

WINDOW, GRAM = 20, 5
SPAN = WINDOW - GRAM + 1
SHARD_WORDS = 400_000
#: Unlike segments of an anchor (counted task by task) from which it goes window by window.
CROWD = 1024
#: Bits of either bitmap of anchors (32 MB), whatever the table's size.
BITS = 1 << 28


def _segments(w) -> tuple[np.ndarray, ...]:
    """(text number, first window's word, windows, anchor, content) of a run's segments, and
    the hash of the window at each word."""
    none = np.zeros(0, np.int64)
    if len(w.hash) < WINDOW:
        return none, none, none, *[none.view(np.uint64)] * 3
    grams, whole = windows_hash(w.hash, GRAM), windows_hash(w.hash, WINDOW)
    n = len(whole)
    # the leftmost least gram of every SPAN (a power of two), by doubling
    best, anchor, reach = grams, np.arange(len(grams)), 1
    while reach < SPAN:
        m = len(best) - reach
        less = best[reach:] < best[:m]
        best, anchor = np.where(less, best[reach:], best[:m]), np.where(less, anchor[reach:], anchor[:m])
        reach *= 2
    best, anchor = best[:n], anchor[:n]
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    if not len(at):
        return none, none, none, *[none.view(np.uint64)] * 3
    anchor = anchor[at]
    # a window of the next text never has this text's anchor: anchors lie within windows
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.concatenate([cut, [len(at)]]))
    first, last = at[cut], at[cut + count - 1]
    with np.errstate(over="ignore"):
        content = mix64(whole[first] * np.uint64(0x9FB21C651E98DF25) + mix64(whole[last] + count.astype(np.uint64)))
    text = owner[first]
    return text, first - w.first[text], count, best[first], content, whole


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, none, h, text): a row is told by its id and 64 bits of its text.

    ``id`` has the type of doc_id where that is a number or text, else its text; for a null
    it is 0 or "", and ``none``, which the hash covers too, is 1.
    """
    kind = docs.schema["doc_id"].dataType
    own = F.col("doc_id") if isinstance(kind, (T.NumericType, T.StringType)) else F.col("doc_id").cast("string")
    none, text = F.col("doc_id").isNull().cast("long"), F.col("text").cast("string")
    key = F.coalesce(own, F.lit(0 if isinstance(kind, T.NumericType) else "").cast(kind if isinstance(kind, T.NumericType) else "string"))
    return docs.select("doc_id", key.alias("id"), none.alias("none"), F.xxhash64(none, F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))


_PLACE = ["id", "h"]
#: Bits of a segment's pack: 62 is set for a null id, from 5 on the first word, below the windows less one.
_NULL = 1 << 62


def _values(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _before(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether places (none, id, h, start) come before others, one by one."""
    out, same = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
    for x, y in zip(a, b):
        out |= same & (x < y).astype(bool)
        same &= (x == y).astype(bool)
    return out


def _ranks(place: list[np.ndarray]) -> np.ndarray:
    """Ranks of places by all their parts, the first one first; equal places share one."""
    keys = [np.unique(k, return_inverse=True)[1] if k.dtype == object else k for k in place]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _by_window(w, text, start, count, anchor, whole) -> tuple[np.ndarray, ...]:
    """Segments as one segment a window, dealt by the window's own words."""
    seg = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    start = start[seg] + j
    own = whole[w.first[text[seg]] + start]
    return text[seg], start, np.ones(len(seg), np.int64), mix64(own), mix64(own ^ anchor[seg])


def _bits(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(BITS - 1)).astype(np.int64)


def _counted(keyed: DataFrame) -> DataFrame:
    """(bit, anchor, places, unlike): places of anchors in each run of texts, not summed yet."""

    def run(batches):
        for b in batches:
            for _, _, w in runs(b.column("text").to_pylist()):
                *_, anchor, content, _ = _segments(w)
                key, where, places = np.unique(anchor, return_inverse=True, return_counts=True)
                one = np.unique(content, return_index=True)[1]
                unlike = np.bincount(where[one], minlength=len(key)) if len(key) else places
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(places), pa.array(unlike)], ["anchor", "places", "unlike"])

    return keyed.select("text").mapInArrow(run, "anchor long, places long, unlike long")


def _anchors(keyed: DataFrame):
    """Bitmaps (broadcast) of anchors at several places and of crowded ones."""
    sums = _counted(keyed).groupBy("anchor").agg(F.sum("places").alias("places"), F.sum("unlike").alias("unlike")).where("places > 1")
    sums = stored(sums.select(F.col("anchor").bitwiseAND(F.lit(BITS - 1)).alias("bit"), (F.col("unlike") > CROWD).alias("crowded")), "repeat-anchors")
    send = keyed.sparkSession.sparkContext.broadcast
    found = send(bitmap(sums.select("bit"), BITS)), send(bitmap(sums.where("crowded").select("bit"), BITS))
    drop_stored(sums)
    return found


class _Seen:
    """Representatives that a task has sent: contents in order, with their places."""

    def __init__(self):
        self.content, self.place = np.zeros(0, np.uint64), None

    def sort(self, content: np.ndarray, place: list[np.ndarray]):
        """(representative or not, what each segment is a member of): of each content the earliest
        place is the representative, unless an earlier one went before."""
        if not len(content):
            return np.zeros(0, bool), place
        order = np.lexsort((_ranks(place), content))
        c = content[order]
        head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        first, size = order[head], np.diff(np.concatenate([head, [len(c)]]))
        best = [k[first] for k in place]
        sent = np.ones(len(first), bool)
        if self.place is not None:
            at = np.minimum(np.searchsorted(self.content, c[head]), len(self.content) - 1)
            known = self.content[at] == c[head]
            old = [k[at] for k in self.place]
            sent = ~known | _before(best, old)
            best = [np.where(sent, new, was) for new, was in zip(best, old)]
            keep = np.ones(len(self.content), bool)
            keep[at[known]] = False
            merged = np.concatenate([self.content[keep], c[head]])
            place_ = [np.concatenate([k[keep], b]) for k, b in zip(self.place, best)]
        else:
            merged, place_ = c[head], best
        into = np.argsort(merged, kind="stable")
        self.content, self.place = merged[into], [k[into] for k in place_]
        lead = np.zeros(len(content), bool)
        lead[first[sent]] = True
        owner = []
        for b in best:
            spread = np.empty(len(content), b.dtype)
            spread[order] = np.repeat(b, size)
            owner.append(spread)
        return lead, owner


def _places(keyed: DataFrame, shared, crowded) -> DataFrame:
    """Segments of anchors at several places: (anchor, content, id, h, pack, words) of representatives,
    (id, h, pack, of_id, of_h, of_pack) of their members."""
    kind = keyed.schema["id"].dataType
    names = ["anchor", "content", *_PLACE, "pack", "words", "of_id", "of_h", "of_pack"]

    def rows(ids, place, pack, anchor=None, content=None, words=None, owner=None):
        none = lambda t: pa.nulls(len(pack), t)
        own = [ids.type, pa.int64()]
        columns = [none(pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)), none(pa.int64()) if content is None else pa.array(content.view(np.int64)), ids, pa.array(place[2]), pa.array(pack)]
        columns.append(none(pa.binary()) if words is None else pa.array(words, pa.binary()))
        columns += [none(own[0]), none(own[1]), none(pa.int64())] if owner is None else [pa.array(owner[1], own[0]), pa.array(owner[2]), pa.array(owner[3])]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        seen = _Seen()
        for b in batches:
            none, ids, h = (_values(b.column(k)) for k in ("none", "id", "h"))
            for low, _, w in runs(b.column("text").to_pylist()):
                *cut, whole = _segments(w)
                cut = [c[has_bit(shared.value, _bits(cut[3]))] for c in cut]
                many = has_bit(crowded.value, _bits(cut[3]))
                if many.any():
                    one = _by_window(w, *(c[many] for c in cut[:4]), whole)
                    cut = [np.concatenate([c[~many], o]) for c, o in zip(cut, one, strict=True)]
                text, start, count, anchor, content = cut
                if not len(text):
                    continue
                row = low + text
                pack = none[row] << 62 | start << 5 | (count - 1)
                place = [none[row], ids[row], h[row], pack]
                lead, owner = seen.sort(content, place)
                begin = w.first[text] + start
                at = np.flatnonzero(lead)
                raw = [w.raw[i:j] for i, j in zip(w.start[begin[at]].tolist(), w.end[begin[at] + count[at] + WINDOW - 2].tolist(), strict=True)]
                take = lambda which: b.column("id").take(pa.array(row[which]))
                yield rows(take(at), [k[at] for k in place], pack[at], anchor[at], content[at], raw)
                other = ~lead & ~np.logical_and.reduce([(x == y).astype(bool) for x, y in zip(place, owner)])  # a repeated row is no member of itself
                at = np.flatnonzero(other)
                yield rows(take(at), [k[at] for k in place], pack[at], owner=[k[at] for k in owner])

    own = kind.simpleString()
    return keyed.select(*_PLACE, "none", "text").mapInArrow(run, f"anchor long, content long, id {own}, h long, pack long, words binary, of_id {own}, of_h long, of_pack long")


def _searched(leads: DataFrame) -> DataFrame:
    """(id, h, pack, mask, whole): which windows of each representative stand earlier too, and
    whether the index has all its words together."""
    kind = leads.schema["id"].dataType.simpleString()
    names = [*_PLACE, "pack", "mask", "whole"]

    def shard(rows: pa.Table) -> pa.RecordBatch:
        """Of whole anchors, rows in order of anchor and content."""
        rows = rows.combine_chunks().to_batches()[0]
        pack = _values(rows.column("pack"))
        none, start, count = pack >> 62 & 1, (pack & _NULL - 1) >> 5, (pack & 31) + 1
        rank = _ranks([none, _values(rows.column("id")), _values(rows.column("h")), start])
        anchor, content = _values(rows.column("anchor")), _values(rows.column("content"))
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
        group = np.cumsum(np.bincount(head, minlength=len(rank)))[: len(rank)] - 1
        least = np.minimum.reduceat(rank, head)
        first = head + np.array([int(np.argmin(rank[a:z])) for a, z in zip(head, [*head[1:], len(rank)])]) if len(head) < len(rank) else head
        # each content once, at its first place
        data = np.frombuffer(b"\n".join(rows.column("words").take(pa.array(first)).to_pylist()), np.uint8)
        flat = word_ids(data, SPACE[data])[2].astype(np.uint64)
        size = count[first] + WINDOW - 1
        base = np.cumsum(size) - size
        step = np.arange(len(flat)) - np.repeat(base, size)
        number = np.repeat(rank[first] << 32 | start[first], size) + step  # of each word, in order of places
        index = FMIndex(flat, size, number)
        symbol = index.symbols(flat)
        # matching statistics of whole contents, for all their representatives
        steps, low, high = index.matching(symbol, base + size, size)
        found = steps == size
        earliest = np.full(len(size), np.iinfo(np.int64).max)
        earliest[found] = index.least(low[found], high[found])
        own = rank << 32 | start
        mask = np.where(earliest[group] < own, (1 << count) - 1, 0)
        # window by window: first places
        seg = np.repeat(np.arange(len(first)), count[first])
        j = np.arange(len(seg)) - np.repeat(np.cumsum(count[first]) - count[first], count[first])
        steps, low, high = index.matching(symbol, base[seg] + j + WINDOW, np.full(len(seg), WINDOW))
        hit = np.flatnonzero(steps == WINDOW)
        hit = hit[index.least(low[hit], high[hit]) < number[base[seg[hit]] + j[hit]]]
        part = np.zeros(len(first), np.int64)
        np.bitwise_or.at(part, seg[hit], 1 << j[hit])
        at_first = rank == least[group]
        mask[at_first] = part[group[at_first]]
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in (*_PLACE, "pack")), pa.array(mask), pa.array(found[group])], names)

    def run(batches):
        held, words, last = [], 0, None
        for b in batches:
            anchor, content = _values(b.column("anchor")), _values(b.column("content"))
            new = np.concatenate([[(anchor[0], content[0]) != last], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
            last = anchor[-1], content[-1]
            size = np.cumsum(np.where(new, (_values(b.column("pack")) & 31) + WINDOW, 1))
            edges = np.flatnonzero(np.concatenate([[bool(held) and held[-1].column("anchor")[-1].as_py() != anchor[0]], anchor[1:] != anchor[:-1]]))
            low, used = 0, 0
            for cut in edges.tolist():
                upto = int(size[cut - 1]) if cut else 0
                if words + upto - used >= SHARD_WORDS:
                    if cut > low:
                        held.append(b.slice(low, cut - low))
                    yield shard(pa.Table.from_batches(held))
                    held, words, low, used = [], 0, cut, upto
            if low < len(anchor):
                held.append(b.slice(low))
                words += int(size[-1]) - used
        if held:
            yield shard(pa.Table.from_batches(held))

    dealt = leads.repartition("anchor").sortWithinPartitions("anchor", "content")
    return dealt.mapInArrow(run, f"id {kind}, h long, pack long, mask long, whole boolean")


def repeats(docs: DataFrame) -> DataFrame:
    """(id, h, start, mask), stored: bit j tells that the window at word start + j repeats."""
    keyed = _keyed(docs)
    filters = _anchors(keyed)
    places = stored(_places(keyed, *filters), "repeat-places")
    for f in filters:
        f.destroy()
    told = stored(_searched(places.where("words IS NOT NULL").drop("of_id", "of_h", "of_pack")), "repeat-answers")
    whole = told.where("whole").select(F.col("id").alias("of_id"), F.col("h").alias("of_h"), F.col("pack").alias("of_pack")).distinct()
    windows = F.col("pack").bitwiseAND(F.lit(31)).cast("int") + 1
    members = places.where("of_pack IS NOT NULL").join(whole, ["of_id", "of_h", "of_pack"])
    cuts = members.select(*_PLACE, "pack", (F.pow(F.lit(2.0), windows).cast("long") - 1).alias("mask")).unionByName(told.where("mask <> 0").drop("whole"))
    found = stored(cuts.select(*_PLACE, F.shiftright(F.col("pack").bitwiseAND(F.lit(_NULL - 1)), 5).alias("start"), "mask"), "repeats")
    drop_stored(places)
    drop_stored(told)
    return found


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and the kept text).

    Every word that a window covers whose words also start earlier (smaller doc_id, or same
    document, earlier start) is removed; windows are judged on the input. Ids are compared
    as what they are (numbers, or text by code point); a null doc_id comes last. Null and
    empty texts have no words and the digest of "". Rows with one doc_id and one text are one
    document (same result); with other texts, documents in an order of their own. An empty
    table gives no rows; other columns are ignored.
    """
    keyed, found = _keyed(docs), repeats(docs)
    lists = found.groupBy(*_PLACE).agg(F.collect_list(F.struct("start", "mask")).alias("cuts"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
        for b in batches:
            total, gone, sha, kept = [], [], [], []
            for t, cuts in zip(b.column("text"), b.column("cuts"), strict=True):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if cuts.is_valid and len(cuts.values):
                    start, mask = (np.asarray(cuts.values.field(k), np.int64) for k in ("start", "mask"))
                    edge = np.zeros(len(words) + 1, np.int64)
                    for j in range(SPAN):
                        s = start[(mask >> j) & 1 == 1] + j
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + WINDOW, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[i] for i in stay.tolist()]
                line = b" ".join(words)
                gone.append(total[-1] - len(words))
                sha.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    kept.append(line.decode("utf-8", "surrogatepass"))
            more = [pa.array(kept, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *more], names)

    rows = keyed.join(lists, _PLACE, "left").select("doc_id", "text", "cuts")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def query(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE n > 1),
m AS (
  SELECT w.doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN w.word END, ' ' ORDER BY w.i) AS kept
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(m.n_removed, 0) AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)
"""
