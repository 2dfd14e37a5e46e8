r"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages; terms are words with case and punctuation folded
   away. Document frequencies of the benchmark's terms are counted over all tiles of 32
   words of all documents, in one scan, which gives idf weights.
2. Passages are dealt in blocks of at most BLOCK_PASSAGES over the cluster. For each block a
   task takes a randomised SVD (range finder with power iterations) of its TF-IDF passages,
   which gives a latent space, and writes it with its passages to a file in the shared
   folder. A block has no more passages than the space has dimensions, so the space keeps all
   of each passage however many there are. Documents are folded in.
3. Every document is read in windows of 96 words, 32 apart, so that any 64 consecutive
   words lie in one. Windows are projected and compared with all passages by cosine, over
   the norm of the shorter side, so that other words of a window never hide a passage in it.
   One scan serves all blocks: a task holds some texts and takes one block after the other.
4. Candidates are confirmed by the longest common subsequence of words (within one and a
   half times the passage's length), which has to cover VERBATIM of the passage, or
   PARAPHRASE of it where an answer check holds too: ANSWER of the item's answer (or, without
   an ``answer`` column, of its rarest terms) must be there. A copy in which 30 % of the words
   are others is near that limit: some pass it, some do not.

Items of fewer than SHORT words are too short for shares: they count where they stand word
for word, those of fewer than TINY words only where they are the whole document.

The benchmark is the stated query set; the driver holds its distinct terms with their counts
and one path a block. Documents are never dropped or sampled.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RUN_BYTES, Words, drop_stored, new_path, pieces, qualified, runs, stored, table

PASSAGE, HALF, TILE = 64, 32, 32
SHORT, TINY = 8, 4
RANK, POWER, SEED = 256, 2, 7
BLOCK_PASSAGES = 240  # at most RANK
#: Terms in at most this share of tiles inform the index, as do the KEY_TERMS rarest of each passage (of a short one SHORT_TERMS).
MAX_SHARE, KEY_TERMS, SHORT_TERMS, ANSWER_TERMS = 0.001, 12, 3, 5
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.4, 0.8, 0.6, 0.6
#: Blocks that a worker keeps loaded; with more of them it holds HELD_RUNS runs of texts for each round of blocks.
LOADED, HELD_RUNS = 4, 16


class _Lookup:
    """Positions of known 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.words & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h``, index of the word there)."""
        at = np.flatnonzero(self.near[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(at) or not len(self.words):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        same = self.words[term] == h[at]
        return at[same], term[same]


def passages(items: list[tuple]) -> list[tuple]:
    """(item_id, answer hashes or None, passage's word hashes) of (item_id, text, answer) items.
    Items without a word have none."""
    out = []
    for item_id, text, answer in items:
        h = Words([(text or "").encode("utf-8", "surrogatepass")], fold=True).hash
        if not len(h):
            continue
        key = Words([answer.encode("utf-8", "surrogatepass")], fold=True).hash if answer else None
        starts = [0] if len(h) <= PASSAGE else [*range(0, len(h) - PASSAGE, HALF), len(h) - PASSAGE]
        out += [(item_id, key, h[s : s + PASSAGE]) for s in starts]
    return out


def _cut(benchmark: DataFrame) -> DataFrame:
    """(item_id, answer, words), stored: the passages of all distinct items, hashes as bytes."""
    columns = ["item_id", F.col("text").cast("string"), (F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer")]
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = passages(list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)))
            kinds = (b.schema.field(0).type, pa.binary(), pa.binary())
            parts = [[r[0] for r in rows], [None if r[1] is None else r[1].tobytes() for r in rows], [r[2].tobytes() for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, kinds, strict=True)], ["item_id", "answer", "words"])

    return stored(benchmark.select(*columns).distinct().mapInArrow(run, f"item_id {kind}, answer binary, words binary"), "passages")


def _terms(cut: DataFrame) -> np.ndarray:
    """The distinct words of all passages, sorted: the benchmark's vocabulary, on the driver."""

    def run(batches):
        for b in batches:
            words = [np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(words)) if words else np.zeros(0, np.int64))], ["term"])

    rows = cut.select("words").mapInArrow(run, "term long").distinct().toArrow()
    return np.sort(rows.column("term").to_numpy().view(np.uint64))


def tile_counts(docs: DataFrame, lookup: _Lookup) -> tuple[np.ndarray, int]:
    """How many tiles of all documents hold each known word, and the number of tiles."""
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        known = shared.value
        total, tiles = np.zeros(len(known.words), np.int64), 0
        for b in pieces(batches):
            for _, _, w in runs(b.column("text").to_pylist(), fold=True):
                count = np.diff(w.first)
                per = -(-count // TILE)
                at, term = known.find(w.hash)
                doc = np.searchsorted(w.first, at, "right") - 1
                tile = (np.cumsum(per) - per)[doc] + (at - w.first[doc]) // TILE
                pair = np.unique(tile * len(known.words) + term)
                total += np.bincount(pair % len(known.words), minlength=len(total)) if len(pair) else 0
                tiles += int(per.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[tiles], total[some]]))], ["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    out, n = np.zeros(len(lookup.words), np.int64), 0
    for term, c in rows:  # one row a benchmark term
        if term < 0:
            n = c
        else:
            out[term] = c
    return out, n


def randomised_svd(rows: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (width, k) of sparse ``rows`` of (columns, values)."""
    k = min(rank + 16, width, max(len(rows), 1))
    a = np.zeros((len(rows), width))
    for i, (c, v) in enumerate(rows):
        a[i, c] = v
    basis = np.random.default_rng(SEED).standard_normal((width, k))
    for _ in range(POWER):
        basis, _ = np.linalg.qr(a.T @ (a @ basis))
    # A'A in the basis gives the singular values to cut at
    inner = a @ basis
    value, turn = np.linalg.eigh(inner.T @ inner)
    order = np.argsort(-value)[:rank]
    order = order[value[order] > 1e-9 * max(value.max(), 1e-30)]
    return basis @ turn[:, order]


class Index:
    """What tasks need to search one block of (item_id, answer hashes or None, word hashes)."""

    def __init__(self, block: list[tuple], every: _Lookup, counts: np.ndarray, tiles: int):
        idf = np.log((tiles + 1) / (counts + 1)) + 1e-3
        self.whole: dict[tuple, list] = {}
        for item_id, _, h in block:
            if len(h) < TINY:
                self.whole.setdefault(tuple(h.tolist()), []).append(item_id)
        block = [x for x in block if len(x[2]) >= TINY]
        chosen, self.items, self.words, self.answers = set(), [], [], []
        for item_id, key, h in block:
            _, term = every.find(h)
            rare = np.unique(term)
            rare = rare[np.lexsort((rare, counts[rare]))]
            chosen.update(rare[: KEY_TERMS if len(h) >= SHORT else SHORT_TERMS].tolist())
            chosen.update(rare[counts[rare] <= MAX_SHARE * tiles].tolist())
            self.items.append(item_id)
            self.words.append(h)
            self.answers.append(set((key if key is not None else every.words[rare[:ANSWER_TERMS]]).tolist()))
        picked = np.array(sorted(chosen), np.int64)
        self.known = _Lookup(every.words[picked])
        self.idf = idf[picked].astype(np.float32)
        rows, norms = [], []
        for h in self.words:
            _, term = self.known.find(h)
            term, tf = np.unique(term, return_counts=True)
            v = tf * self.idf[term]
            norms.append(max(np.linalg.norm(v), 1e-12))
            rows.append((term, v / norms[-1]))
        space = randomised_svd(rows, len(picked)) if rows else np.zeros((0, 0))
        latent = np.array([v @ space[t] for t, v in rows]).reshape(len(rows), space.shape[1])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)
        self.norm = np.array(norms, np.float32)
        self.weighted = (space * self.idf[:, None]).astype(np.float32)
        self.bits = []
        for h in self.words:
            bits: dict[int, int] = {}
            for i, w in enumerate(h.tolist()):
                bits[w] = bits.get(w, 0) | 1 << i
            self.bits.append(bits)
        self.terms = [np.unique(t) for t, _ in rows]

    def search(self, w: Words) -> list[tuple]:
        """(text number, item_id, first word, last word, cosine, lcs share, answer share),
        the best of each text and item, for a run of folded words."""
        count = np.diff(w.first)
        tiny = self._tiny(w, count)
        at, term = self.known.find(w.hash)
        if not len(at):
            return tiny
        per = -(-count // HALF)
        doc = np.searchsorted(w.first, at, "right") - 1
        # two empty blocks between texts, so that windows never reach into the next
        base = np.cumsum(per + 2) - per - 2
        block = base[doc] + (at - w.first[doc]) // HALF
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        own, owner = block[edge], doc[edge]
        best: dict[tuple, tuple] = {}
        step = 8192
        for low in range(0, len(edge), step):
            # windows start at these blocks and the two before; sums for blocks low - 2 .. high + 2
            high = min(low + step, len(edge))
            reach = min(high + 2, len(edge))
            a, b = edge[low], edge[reach] if reach < len(edge) else len(at)
            sums = np.add.reduceat(self.weighted[term[a:b]], edge[low:reach] - a, axis=0)
            square = np.add.reduceat(self.idf[term[a:b]] ** 2, edge[low:reach] - a)
            n = high - low
            lat, sq = sums[:n].copy(), square[:n].copy()
            for k in (1, 2):
                for d in (1, 2):
                    other = np.arange(low, high) + k
                    fine = other < reach
                    fine[fine] &= own[other[fine]] == own[low:high][fine] + d
                    lat[fine] += sums[other[fine] - low]
                    sq[fine] += square[other[fine] - low]
            cos = (lat @ self.latent) / np.minimum(np.sqrt(sq)[:, None], self.norm[None, :])
            for i, p in zip(*np.nonzero(cos >= COSINE), strict=True):
                d = int(owner[low + i])
                first = int(w.first[d] + (own[low + i] - base[d]) * HALF)
                self._confirm(w, d, first, int(p), float(cos[i, p]), at, term, best)
        return tiny + [(d, *v) for (d, _), v in best.items()]

    def _tiny(self, w: Words, count: np.ndarray) -> list[tuple]:
        """The texts that are, whole, an item of fewer than TINY words."""
        if not self.whole:
            return []
        short = np.flatnonzero((count > 0) & (count < TINY))
        named = ((int(d), tuple(w.hash[w.first[d] : w.first[d + 1]].tolist())) for d in short)
        return [(d, item, 0, len(h) - 1, 1.0, 1.0, 1.0) for d, h in named for item in self.whole.get(h, ())]

    def _confirm(self, w, d, first, p, cos, at, term, best) -> None:
        end = min(first + 3 * HALF, int(w.first[d + 1]))
        x, y = np.searchsorted(at, [first, end])
        mine = at[x:y][np.isin(term[x:y], self.terms[p])]
        if not len(mine):
            return
        n = len(self.words[p])
        low, high = max(int(mine[0]) - n, int(w.first[d])), min(int(mine[-1]) + n + 1, int(w.first[d + 1]))
        if n < SHORT:
            if high - low < n or not (np.lib.stride_tricks.sliding_window_view(w.hash[low:high], n) == self.words[p]).all(axis=1).any():
                return
            lcs = answer = 1.0
        else:
            text = w.hash[low:high].tolist()
            lcs = _lcs(self.bits[p], n, text) / n
            if lcs >= PARAPHRASE and len(text) > (span := n * 3 // 2):
                # a long text holds much of any passage in some order: what counts stands close together
                step = max(1, n // 8)
                text = max((text[i : i + span] for i in range(0, len(text) - span + step, step)), key=lambda t: _lcs(self.bits[p], n, t))
                lcs = _lcs(self.bits[p], n, text) / n
            seen = set(text)
            answer = sum(a in seen for a in self.answers[p]) / max(len(self.answers[p]), 1)
            if lcs < VERBATIM and (lcs < PARAPHRASE or answer < ANSWER):
                return
        key = (d, self.items[p])
        row = (self.items[p], int(mine[0] - w.first[d]), int(mine[-1] - w.first[d]), cos, lcs, answer)
        if key not in best or (lcs, cos) > (best[key][4], best[key][3]):
            best[key] = row


def _lcs(bits: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the passage."""
    full = (1 << n) - 1
    v = full
    for word in text:
        m = bits.get(word)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def indexes(docs: DataFrame, benchmark: DataFrame) -> list[str]:
    """Files of the indexes of all blocks, in the shared folder: one count of the benchmark's
    terms over all documents, then a task a group of passages, of which none but the paths
    come back."""
    spark = docs.sparkSession
    cut = _cut(benchmark)
    every = _Lookup(_terms(cut))
    if not len(every.words):
        return []
    counts, tiles = tile_counts(docs, every)
    shared = spark.sparkContext.broadcast((every, counts, tiles))
    folder = qualified(spark, new_path(spark, "lsi"))
    parts = -(-cut.count() // (BLOCK_PASSAGES * 4 // 5))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words"], kind="stable")
        hashes = lambda x: None if x is None else np.frombuffer(x, np.uint64)
        block = [(r.item_id, hashes(r.answer), hashes(r.words)) for r in pdf.itertuples()]
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        paths = []
        for i in range(0, len(block), BLOCK_PASSAGES):
            paths.append(f"{top}/{uuid.uuid4().hex}")
            with files.open_output_stream(paths[-1]) as out:
                out.write(pickle.dumps(Index(block[i : i + BLOCK_PASSAGES], *shared.value)))
        return pd.DataFrame({"path": paths})

    built = cut.groupBy(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)).alias("part")).applyInPandas(build, "path string")
    table_ = stored(built, "lsi-blocks")  # written once: a task that is run again leaves files that nobody reads
    paths = sorted(r["path"] for r in table_.collect())
    drop_stored(table_)
    drop_stored(cut)
    return [f"{folder}/{p.rsplit('/', 1)[1]}" for p in paths]


_LOADED: OrderedDict[str, Index] = OrderedDict()


def _loaded(path: str) -> Index:
    """The index in a file; a worker keeps the last few."""
    if path not in _LOADED:
        while len(_LOADED) >= LOADED:
            _LOADED.popitem(last=False)
        files, at = fs.FileSystem.from_uri(path)
        with files.open_input_stream(at) as source:
            _LOADED[path] = pickle.loads(source.read())
    _LOADED.move_to_end(path)
    return _LOADED[path]


def _searched(batches, paths: list[str]):
    """Yields (batch, rows) with (row number, item_id, ...) of each item found in a row's text."""

    def flush():
        cut = [list(runs(b.column("text").to_pylist(), fold=True)) for b in held]
        best: list[dict] = [{} for _ in held]
        for path in paths:
            index = _loaded(path)
            for k, parts in enumerate(cut):
                for low, _, w in parts:
                    for d, item, *more in index.search(w):
                        # passages of one item can lie in two blocks
                        if (low + d, item) not in best[k] or (more[3], more[2]) > (best[k][low + d, item][3], best[k][low + d, item][2]):
                            best[k][low + d, item] = more
        for b, found in zip(held, best, strict=True):
            yield b, [(*key, *more) for key, more in found.items()]

    held, size, most = [], 0, RUN_BYTES * (1 if len(paths) <= LOADED else HELD_RUNS)
    for b in pieces(batches):
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` and benchmark item found in it: doc_id, item_id,
    first_word and last_word of the shared rare terms, cosine, lcs, answer.

    Null and empty texts have no rows; items without a word are left out; repeated rows of
    documents are searched alike and each gives its rows, repeated items count once; whole
    texts are searched; an empty table on either side gives no rows; other columns are ignored.
    """
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, last_word long, cosine double, lcs double, answer double"
    names = [x.split()[0] for x in schema.split(", ")]
    paths = indexes(docs, benchmark)
    if not paths:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches):
        for b, found in _searched(batches, paths):
            if found:
                row, *columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *map(pa.array, columns)], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, unchanged, whatever their
    columns. Null and empty texts stay, repeated rows stay or go together, and without a
    benchmark or documents nothing goes."""
    paths = indexes(docs, benchmark)
    if not paths:
        return docs

    def run(batches):
        for b, found in _searched(batches, paths):
            keep = np.ones(len(b), bool)
            keep[[row for row, *_ in found]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
