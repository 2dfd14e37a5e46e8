"""Pieces that several operators share: whole-table reads, shared-folder tables and
a vectorised tokenizer for batches of texts.

Words are always maximal runs of ``[^\\x20\\x09-\\x0D]`` (ASCII white space only).
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_STATE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset (local tests), a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or _STATE.get("dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _STATE["dir"] = tempfile.mkdtemp(prefix="recollect-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark, path: str) -> str:
    """``path`` as a URI of the file system that Spark takes it to be on, for driver and executors alike."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`stored`; it must not be read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    home = shared_dir(spark).removeprefix("file:").replace("//", "/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if home in folder.replace("//", "/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --------------------------------------------------------------------------------------
# filters of a fixed size

_BLOCK_BITS = 1 << 16


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The bits named in the one column of ``rows`` (0 to ``bits`` - 1) as packed bytes.

    Blocks of 8 KB are made by their tasks; the driver gets ``bits`` / 8 bytes at most.
    """

    def pack(batches):
        for batch in batches:
            data = []
            for at in batch["at"]:
                block = np.zeros(_BLOCK_BITS, bool)
                block[np.asarray(at, np.int64)] = True
                data.append(np.packbits(block, bitorder="little").tobytes())
            yield pd.DataFrame({"block": batch["block"], "data": data})

    bit = F.col(rows.columns[0])
    blocks = rows.select(F.shiftright(bit, 16).alias("block"), bit.bitwiseAND(F.lit(_BLOCK_BITS - 1)).cast("int").alias("at"))
    out = np.zeros(max(bits, _BLOCK_BITS) // 8, np.uint8)
    for r in blocks.groupBy("block").agg(F.collect_set("at").alias("at")).mapInPandas(pack, "block long, data binary").toLocalIterator():
        low = r["block"] * _BLOCK_BITS // 8
        out[low : low + _BLOCK_BITS // 8] = np.frombuffer(r["data"], np.uint8)
    return out


def has_bit(packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (packed[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 > 0


# --------------------------------------------------------------------------------------
# column helpers

_BLOCK = 256


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, merge=lambda a, b: a + b, start: int = 0) -> Column:
    """For each entry of an array of longs what ``merge`` makes of all entries before it.

    In blocks: an array that grows by appending is copied at every step, which in one long
    array costs the square of its length.
    """
    zero = F.lit(start).cast("long")

    def fold(xs: Column, begin: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).cast("long").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(xs, F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]

    def blocked(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
        return let(cut, lambda bs: F.flatten(F.zip_with(bs, fold(F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: merge(a, x).cast("long"))), zero), fold)))

    return let(values, blocked)


# --------------------------------------------------------------------------------------
# vectorised tokenizer

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Case and punctuation folded away: A-Z lowered, other ASCII than letters and digits as white space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
#: Texts are handled in runs of about this many bytes, which bounds the arrays' memory.
RUN_BYTES = 1 << 20


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 256)
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _POW


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (splitmix)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_ids(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(start, end, id, words): the words between ``gap`` bytes and their numbers in a dictionary,
    which are decided by the words themselves."""
    if not len(data):
        return *[np.zeros(0, np.int64)] * 3, pa.array([], pa.binary())
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    if not gap[-1]:
        edge = np.concatenate([edge, [len(data)]])
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap].tobytes())]).dictionary_encode()
    return start, end, held.indices.to_numpy().astype(np.int64), held.dictionary


class Words:
    """Words of a run of texts.

    ``start``/``end`` are byte offsets into ``data``, ``hash`` 64-bit word hashes, and
    words of text i are ``first[i]:first[i + 1]``; ``at`` has the texts' byte offsets.
    """

    __slots__ = ("at", "data", "end", "first", "hash", "raw", "start")

    def __init__(self, texts: list[bytes], lower: bool = False, fold: bool = False):
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        self.data = data = _FOLD[data] if fold else _LOWER[data] if lower else data
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        space = SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.hash = self._hash(space)

    def _hash(self, space: np.ndarray) -> np.ndarray:
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        keep = self.data[~space].astype(np.uint64)
        keep += np.uint64(1)
        offset = np.cumsum(length) - length
        place = np.arange(len(keep), dtype=np.int64)
        place -= np.repeat(offset, length)
        with np.errstate(over="ignore"):
            keep *= _powers(int(length.max()) + 1)[place]
            return mix64(np.add.reduceat(keep, offset) + length.astype(np.uint64))


def runs(texts: list, lower: bool = False, fold: bool = False, limit: int = RUN_BYTES):
    """Yields (from, to, Words) for runs of ``texts`` (str or None) of about ``limit`` bytes."""
    held, size, low = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield low, i, Words(held, lower, fold)
            held, size, low = [], 0, i
        held.append(b)
        size += len(b) + 1
    if held:
        yield low, low + len(held), Words(held, lower, fold)


def pieces(batches, text: str = "text", limit: int = RUN_BYTES):
    """The rows of Arrow ``batches`` in slices of at most about ``limit`` bytes of text.

    What a worker makes of a slice takes several times its text, so it is held for a slice
    and not for the 10,000 rows of a batch. A longer text is a slice of its own or ends one.
    """
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(b)]
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            yield b.slice(low, high - low)


def windows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive entries of ``h``, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        part, done, out, out_len = h, 1, None, 0
        left = n
        while left:
            if left & 1:
                if out is None:
                    out, out_len = part, done
                else:  # out covers [0, out_len), part the next ``done`` entries
                    m = len(h) - out_len - done + 1
                    out = mix64(out[:m] * np.uint64(0x9FB21C651E98DF25) + part[out_len : out_len + m])
                    out_len += done
            left >>= 1
            if left:
                m = len(part) - done
                part = mix64(part[:m] * np.uint64(0xD6E8FEB86659FD93) + part[done : done + m]) if m > 0 else part[:0]
                done *= 2
        return out
