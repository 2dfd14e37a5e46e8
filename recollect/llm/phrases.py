r"""Phrase collocations: word-id suffix arrays a shard, n-gram counts merged by key.

Texts are gathered into shards of one language. A shard's words get ids (an exact
dictionary, no hashes), the id sequence is sorted by prefix doubling, and the intervals of
its longest-common-prefix array are the n-grams with their counts. These are merged over
all shards by (lang, phrase), in three passes, since a phrase is frequent only where all
its parts are: words; pairs of frequent words; phrases of three to five words whose pairs
are all frequent. What is frequent reaches the next pass as a bitmap of fixed size
(``BITS``): a collision lets more phrases be counted, it never changes a count.

Nothing whole meets in one task: counts are summed before they are shuffled, a language is
only a part of the key, and ranks are cut in each task before a language's rows meet.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, drop_stored, has_bit, stored, table, word_ids

#: Longest phrase, least occurrences, phrases reported a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A phrase goes where a longer one around it occurs this often, in percent of it.
SHARE = 100
#: Text bytes a shard.
SHARD_BYTES = 12 << 20
#: Bits of a filter (32 MB), whatever the table's size.
BITS = 1 << 28
#: Copies of a language's total, so that a language's rows need not meet.
SALTS = 32

_A, _B = 1_000_003, 7_919
_KEY = "lang string, phrase string, f long"
#: A-Z lowered; what ends a piece as \n, what ends a word as a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


# --------------------------------------------------------------------------------------
# one shard


def words_of(data: bytes) -> tuple[np.ndarray, list[str]]:
    """(ids, words): the words of folded bytes as numbers from 1, with 0 between pieces."""
    at = np.frombuffer(data, np.uint8)
    ends = at == 10
    start, _, held, words = word_ids(at, ends | (at == 32))
    if not len(start):
        return np.zeros(0, np.int64), []
    piece = np.cumsum(ends)[start]
    place = np.arange(len(start)) + piece - piece[0]  # an empty place (or more) for each piece's end
    ids = np.zeros(int(place[-1]) + 2, np.int64)
    ids[place] = held + 1
    keep = (ids > 0) | np.concatenate([[True], ids[:-1] > 0])
    return ids[keep], [w.decode("utf-8", "surrogatepass") for w in words.to_pylist()]


def chains(ids: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """``ids`` cut where ``fine`` (for each two neighbours) is false; chains of one word go."""
    inside = fine & (ids[:-1] > 0) & (ids[1:] > 0)
    before, after = np.concatenate([[False], inside]), np.concatenate([inside, [False]])
    keep = before | after
    left, ends = ids[keep], (before & ~after)[keep]
    out = np.zeros(len(left) + int(ends.sum()), np.int64)
    out[np.arange(len(left)) + np.cumsum(ends) - ends] = left
    return out


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` ordered by their next ``depth`` ids at least, by prefix doubling."""
    n, width = len(ids), 1
    rank = ids.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while width < depth:
        top = int(rank.max()) + 1
        key = rank * top
        if width < n:
            key[: n - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        there = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(there[1:] != there[:-1])]) + 1
        width *= 2
    return order


def intervals(ids: np.ndarray, least: int, most: int):
    """Yields (n, places, counts): an interval of the LCP array for each n-gram of ``least``
    to ``most`` ids without 0, with the place of one occurrence."""
    if not len(ids):
        return
    padded = np.concatenate([ids, np.zeros(most, np.int64)])
    order = suffix_array(ids, most)
    shared = np.zeros(len(order), np.int64)  # common prefix with the suffix before
    whole = np.zeros(len(order), np.int64)  # ids up to the next 0
    same, alive = np.ones(len(order), bool), np.ones(len(order), bool)
    same[0] = False
    for k in range(most):
        here = padded[order + k]
        alive &= here > 0
        same[1:] &= (here[1:] == here[:-1]) & alive[1:]
        shared += same
        whole += alive
    for n in range(least, most + 1):
        at = np.flatnonzero(whole >= n)  # suffixes between two equal n-grams hold it too
        if not len(at):
            return
        first = np.flatnonzero(shared[at] < n)
        yield n, order[at[first]], np.diff(np.concatenate([first, [len(at)]]))


def _bit(lang: int, hashes: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """The filter's bit for words, or for pairs of words, by their CRC-32."""
    return (lang * _B + hashes * (1 if after is None else _A) + (0 if after is None else after)) % BITS


def _bit_column(*words: Column) -> Column:
    crc = lambda c: F.crc32(c.cast("binary"))
    value = crc(F.col("lang")) * _B + (crc(words[0]) if len(words) == 1 else crc(words[0]) * _A + crc(words[1]))
    return value % BITS


def shard_counts(lang: str, data: bytes, least: int, most: int, words=None, pairs=None) -> pa.RecordBatch:
    """(lang, phrase, f) of a shard; for single words a row without phrase has their number."""

    def batch(found, sums):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(sums, pa.int64())], ["lang", "phrase", "f"])

    ids, names = words_of(data)
    if not len(ids):
        return batch([], [])
    if most == 1:
        counts = np.bincount(ids, minlength=len(names) + 1)[1:]
        return batch([*names, None], np.append(counts, counts.sum()))
    crc = np.array([0, *(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in names)], np.int64)
    tongue = zlib.crc32(lang.encode())
    fine = np.concatenate([[False], has_bit(words, _bit(tongue, crc[1:]))])[ids]
    edge = fine[:-1] & fine[1:]
    if pairs is not None:
        at = np.flatnonzero(edge)
        edge[at] = has_bit(pairs, _bit(tongue, crc[ids[at]], crc[ids[at + 1]]))
    ids = chains(ids, edge)
    found, sums = [], []
    named = np.array(["", *names], object)
    for n, at, counts in intervals(ids, least, most):
        text = named[ids[at]]
        for k in range(1, n):
            text = text + " " + named[ids[at + k]]
        found.append(text)
        sums.append(counts)
    return batch(np.concatenate(found), np.concatenate(sums)) if found else batch([], [])


def _pieces(data: bytes):
    """A text longer than a shard, cut where a piece ends."""
    while len(data) > SHARD_BYTES:
        cut = data.rfind(b"\n", 0, SHARD_BYTES)
        cut = data.find(b"\n", SHARD_BYTES) if cut <= 0 else cut
        if cut < 0:
            break
        yield data[:cut]
        data = data[cut:]
    yield data


def counted(docs: DataFrame, least: int, most: int, words=None, pairs=None) -> DataFrame:
    """(lang, phrase, f) of all shards, not merged yet."""

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0
        bits = [b.value if b is not None else None for b in (words, pairs)]
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for part in _pieces(text.encode("utf-8", "surrogatepass").translate(_BYTES)):
                    if held and size + len(part) > SHARD_BYTES:
                        for name, parts in held.items():
                            yield shard_counts(name, b"\n".join(parts), least, most, *bits)
                        held, size = {}, 0
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
        for name, parts in held.items():
            yield shard_counts(name, b"\n".join(parts), least, most, *bits)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''")
    return rows.mapInArrow(run, _KEY)


# --------------------------------------------------------------------------------------
# all shards


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """Shards' counts merged; a row without phrase is a language's number of words."""
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least))


def _filter(rows: DataFrame, *words: Column):
    """Broadcasts the bitmap of ``rows``."""
    return rows.sparkSession.sparkContext.broadcast(bitmap(rows.select(_bit_column(*words).alias("bit")), BITS))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, f)), stored: words of each language, and all phrases of 1 to
    ``longest`` words that occur ``least`` times or more, with exact counts."""
    first = stored(_frequent(counted(docs, 1, 1), least), "phrase-1")
    one = first.where("phrase IS NOT NULL")
    words = _filter(one, F.col("phrase"))
    two = stored(_frequent(counted(docs, 2, 2, words), least), "phrase-2")
    halves = F.split("phrase", " ")
    found = one.union(two)
    pairs = _filter(two, halves[0], halves[1])
    if longest > 2:
        found = found.union(_frequent(counted(docs, 3, longest, words, pairs), least))
    found = stored(found, "phrases")
    words.destroy()
    pairs.destroy()
    totals = stored(first.where("phrase IS NULL").select("lang", F.col("f").alias("n")), "phrase-totals")
    drop_stored(first)
    drop_stored(two)
    return totals, found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Null and empty texts have no words; a null lang counts as ``und``; repeated rows count as
    often as they are there; ties go to the phrase that comes first by its bytes; a very long
    text is cut where its pieces end; other columns are ignored; an empty table, or one
    without phrases frequent enough, gives no rows.
    """
    totals, found = frequent_phrases(docs, least, longest)
    words = F.split("phrase", " ")
    held = found.withColumn("words", words).withColumn("k", F.size("words"))
    phrases = held.where("k > 1")
    # a phrase of k + 1 words is the only longer one to ask: any longer one holds such a one, as frequent
    shorter = F.explode(F.array(F.slice("words", 1, F.col("k") - 1), F.slice("words", 2, F.col("k") - 1))).alias("part")
    around = phrases.where("k > 2").select("lang", shorter, "f").groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("f")))

    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "k", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # a language's total meets its phrases salt by salt
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    total = totals.select("lang", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    cuts = cuts.withColumn("salt", salt).join(total, ["lang", "salt"])
    number = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = cuts.withColumn("_up", number("a", 18) * (F.lit(1000) * F.col("n")).cast("decimal(19,0)")).withColumn("_down", number("l", 18) * number("r", 19))
    best = scored.withColumn("score", F.expr("_up DIV _down")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("b"))
    flat = best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM cut, range(1, 6) AS ks(k), LATERAL (SELECT unnest(range(1, len(words) - k + 2)) AS i) AS places
  GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
many AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f FROM grams WHERE f >= 100),
around AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, array_to_string(words[i:j], ' ') AS phrase, f, k
    FROM many, range(1, 6) AS a(i), range(1, 6) AS b(j) WHERE k > 2 AND j > i AND j <= k AND j - i + 1 < k) AS parts
  GROUP BY ALL
), kept AS (SELECT m.* FROM many AS m LEFT JOIN around AS r USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * f)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, cut, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept AS c, range(1, 5) AS cs(cut), many AS x, many AS y, totals AS t
  WHERE cut < c.k AND t.lang = c.lang AND x.lang = c.lang AND y.lang = c.lang
    AND x.phrase = array_to_string(c.words[1:cut], ' ') AND y.phrase = array_to_string(c.words[cut + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
