"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint is given a non-zero vector m(i) of r + 1 bits. Table v (every
non-zero v of r + 1 bits) keeps the bits with <m(i), v> = 1 (mod 2). Any r differing
bits leave some v that is orthogonal to all their vectors, so each pair within radius r
meets in at least one of the 2^(r+1) - 1 tables: none is missed.

A bucket of more than MOST fingerprints is not searched where it lies: the worker hands it
on, and a second level of masks over the bits that the bucket does not share deals it out
again. What meets there agrees in some 48 bits, so a bucket has at most about 2^16 members.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import drop_stored, pieces, stored, table
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: The largest bucket that a worker searches at the first level.
MOST = 4096
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints; 0 for texts without a word (null and empty ones too)."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            out[i] = xxh64_intdigest(line, SEED)
            continue
        start = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1
        begin = np.concatenate([[0], start[: len(words) - shingle]])
        end = np.concatenate([start[shingle - 1 :] - 1, [len(line)]])
        n = len(begin)
        h = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, map(slice, begin.tolist(), end.tolist())), repeat(SEED)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 65_000):  # bounded memory, and sums that fit
            bits = np.unpackbits(h[at : at + 65_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        out[i] = np.bitwise_or.reduce(weights[2 * ones > n], initial=np.uint64(0))
    return out


def _prints(batches):
    for b in pieces(batches):
        fp = fingerprints(b.column("text").to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"), pa.array(fp)], ["doc_id", "content", "fp"])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, content, fp): a 64-bit hash of the text, and the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("content"))
    return rows.mapInArrow(_prints, f"doc_id {kind}, content long, fp long")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def masks(radius: int = RADIUS, kept: int = 0) -> list[int]:
    """The bits that each table keeps, as signed longs: a covering of the bits outside ``kept``,
    which all tables keep too."""
    n = (1 << (radius + 1)) - 1
    free = [i for i in range(64) if not kept >> i & 1]
    vector = {i: 1 + k % n for k, i in enumerate(free)}
    return [_signed(kept | sum(1 << i for i in free if bin(vector[i] & v).count("1") % 2)) for v in range(1, n + 1)]


def _forest(fp: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges that connect whatever pairs within ``radius`` connect, fewer than len(fp).

    Breadth-first: a fingerprint is compared with all those not reached yet, so a tight
    group of n costs about n comparisons and no pair list is ever made.
    """
    a, b, todo = [], [], fp
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            near = np.bitwise_count(todo ^ x) <= radius
            if near.any():
                hit = todo[near]
                a += [x] * len(hit)
                b += hit.tolist()
                queue += list(hit)
                todo = todo[~near]
    return a, b


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp`` that have the same components as
    all pairs within ``radius``.

    Rows are dealt by table and kept bits and sorted there; a worker streams through them
    and holds one bucket of at most ``most`` at a time; larger ones go to the second level.
    Equal fingerprints must be collapsed before.
    """
    first = masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for v, m in enumerate(first)])).alias("x")
    found = stored(_met(fps.select("fp", tables).select("x.t", "x.k", "fp"), radius, most), "simhash-met")
    over = found.where("b IS NULL").select(F.col("a").alias("fp"), "t")
    edges = found.where("b IS NOT NULL").select("a", "b")
    if over.isEmpty():
        return edges.distinct()
    second = F.array(*[F.array(*map(F.lit, masks(radius, m % (1 << 64)))) for m in first])
    rows = over.select("fp", "t", F.posexplode(F.element_at(second, F.col("t") + 1)).alias("u", "m"))
    rows = rows.select((F.col("t") * 64 + F.col("u")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
    return edges.unionByName(_met(rows, radius, None).select("a", "b")).distinct()


def _met(rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """(a, b, t): edges within the buckets (t, k) of ``rows`` (t, k, fp); a row without b is a
    fingerprint of a bucket of table t that has more than ``most``."""

    def batch(a: np.ndarray, b: np.ndarray | None, t: int | None):
        none = lambda kind: pa.nulls(len(a), kind)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none(pa.int64()) if b is None else pa.array(b.view(np.int64)), none(pa.int32()) if t is None else pa.array(np.full(len(a), t, np.int32))], ["a", "b", "t"])

    def searched(t, fp, start, n):
        """The buckets that begin at ``start`` in the first ``n`` rows."""
        if not n:
            return
        size = np.diff(np.concatenate([start, [n]]))
        two = start[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius if len(two) else np.zeros(0, bool)
        a, b = fp[two][near].tolist(), fp[two + 1][near].tolist() if len(two) else []
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if most and m > most:
                yield batch(fp[s : s + m], None, int(t[s]))
                continue
            x, y = _forest(fp[s : s + m], radius)
            a += x
            b += y
        if a:
            yield batch(np.array(a, np.uint64), np.array(b, np.uint64), None)

    def run(batches):
        held = over = None
        for b in batches:
            t, k, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in ("t", "k", "fp"))
            fp = fp.view(np.uint64)  # bitwise_count takes a signed value's magnitude
            if over is not None:  # more of a bucket that is being handed on
                other = (t != over[0]) | (k != over[1])
                n = int(other.argmax()) if other.any() else len(t)
                if n:
                    yield batch(fp[:n], None, int(over[0]))
                t, k, fp = t[n:], k[n:], fp[n:]
                if not len(t):
                    continue
                over = None
            if held is not None:
                t, k, fp = (np.concatenate(x) for x in zip(held, (t, k, fp), strict=True))
            edge = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            last = int(edge[-1]) if len(edge) else 0
            held = (t[last:], k[last:], fp[last:])
            yield from searched(t, fp[:last], np.concatenate([[0], edge[:-1]]) if last else edge, last)
            if most and len(held[0]) > most:
                over = (held[0][0], held[1][0])
                yield batch(held[2], None, int(over[0]))
                held = None
        if held is not None:
            yield from searched(held[0], held[2], np.zeros(1, np.int64), len(held[2]))

    return rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(run, "a long, b long, t int")


def _labelled(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least, label), stored: for each fingerprint its smallest doc_id and its component."""
    kinds = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-kinds")
    edges = stored(links(kinds.select("fp"), radius), "simhash-links")
    label = components(edges)
    drop_stored(edges)
    joined = kinds.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    joined = stored(joined, "simhash-labels")
    drop_stored(kinds)
    drop_stored(label)
    return joined


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits
    reach. Null and empty texts have fingerprint zero and link like any other; a null
    doc_id never names a component (null only if all of its members are null); repeated
    rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    prints = stored(with_fingerprint(docs).select("doc_id", "fp"), "simhash-fp")
    joined = _labelled(prints, radius)
    ids = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "label").select("fp", "component_id")
    out = prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest doc_id.

    A row is told by doc_id and text, so an id that stands for several unlike texts, or is
    null, loses none of them: null ids come last, and of one id's rows in a group the
    smallest text hash stays. Of rows that repeat both, one stays.
    """
    prints = stored(with_fingerprint(docs), "simhash-fp")
    return keep_first(docs, prints, _labelled(prints, radius).withColumnRenamed("fp", "node"), "fp")


def keep_first(docs: DataFrame, prints: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The first row of each label; a ``name`` of ``prints`` without a (node, label) is one of its own."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    named = prints.groupBy(F.col(name).alias("node")).agg(F.min(place).alias("place")).join(labels.select("node", "label"), "node", "left")
    first = named.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("place").alias("place"))
    stay = first.select(F.col("place.doc_id").alias("_stay"), F.col("place.content").alias("_content"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("content"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")) & (F.col("content") == F.col("_content")), "left_semi")
    # the limit of one row a window is applied before the shuffle too
    one = Window.partitionBy("doc_id", "content").orderBy("text")
    return kept.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
