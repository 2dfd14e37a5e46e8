"""Quality rules: text statistics and divergence from language references.

A document's histograms of character classes and of common words (among each other, other
words left out) are compared with those of its language by Jensen-Shannon distance (base 2,
so from 0 to 1). A few words always differ from the reference by chance, so the second
distance also has to exceed what a sample of as many words has. Apart from which common words
there are, a text is rejected that has too few of them (gibberish) or mostly those of another
language. A reference is the mean share of each class and word over all documents of the
language that pass the base rules and are long enough to judge: each document counts once,
however long, so a few pieces of junk do not move it.

A language is the primary subtag of ``lang`` (two or three letters; null and everything else
make one more bin), so there are at most 26^2 + 26^3 + 1. One without a list of common words
is judged by its own documents' character classes alone, never by another language. No
verdict depends on the number of documents: a text that is its language's only one is its
own reference, at distance 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_stored, mix64, pieces, runs, stored, table, windows_hash

# fixed values: frequent function words by language
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have an had they from or which you one were all would there their we has been more when who will no if out so".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ont aux mais comme ou si leur y dont elle deux ces été cette nous être fait ses".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde".split(),
}
LANGS = sorted(COMMON)
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "control", "other")
N_CLASS, N_WORD = len(CLASSES), max(len(dict.fromkeys(w)) for w in COMMON.values()) + 1
#: Fewer words (or common words) than this: no verdict by divergence (of common words).
MIN_WORDS, MIN_COMMON = 50, 10
#: Distances above these reject; that of common words only where it is EXCESS times what
#: a sample of as many words has by chance.
MAX_CLASS, MAX_COMMON, EXCESS = 0.30, 0.55, 1.5
#: A document's shares are summed in units of 2^-SHARE_BITS, so that sums do not depend on their order.
SHARE_BITS = 30
#: Too few common words: less than this part of the reference's share, and by chance rarer than exp(-CHANCE).
MIN_SHARE, CHANCE = 0.5, 9.2
#: Another language: FOREIGN common words that only it has, and three more for each that only the own one has.
FOREIGN = 5
REPEAT_WINDOW, MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

_CLASS_OF = np.full(256, 7, np.int64)
_CLASS_OF[:128] = 4
_CLASS_OF[97:123], _CLASS_OF[65:91], _CLASS_OF[48:58] = 0, 1, 2
_CLASS_OF[[32, 9, 10, 11, 12, 13]] = 3
_CLASS_OF[list(SYMBOLS)] = 5
_CLASS_OF[[c for c in range(32) if not 9 <= c <= 13] + [127]] = 6
_CLASS_OF[128:192] = -1  # continuation bytes belong to the code point before


def _vocabulary():
    """Sorted word hashes, and for each the (language, bin) pairs it counts for."""
    bins: dict[int, list] = {}
    for k, lang in enumerate(LANGS):
        for j, w in enumerate(dict.fromkeys(COMMON[lang])):
            for form in dict.fromkeys((w, w.capitalize(), w.upper())):
                bins.setdefault(int(Words([form.encode()]).hash[0]), []).append((k, j))
    hashes = np.array(sorted(bins), np.uint64)
    near = np.zeros(1 << 16, bool)
    near[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    where = np.full((len(LANGS), len(hashes)), -1, np.int64)
    for i, h in enumerate(hashes.tolist()):
        for k, j in bins[h]:
            where[k, i] = j
    return hashes, near, where


def language(lang: str | None) -> str:
    """The primary subtag, "" for what is no language."""
    tag = str(lang or "").strip().replace("_", "-").split("-")[0].lower()
    return tag if tag.isascii() and tag.isalpha() and 2 <= len(tag) <= 3 else ""


def features(texts: list, langs: list) -> dict[str, np.ndarray]:
    """Statistics of whole texts; ``hist`` is (n, classes + common words + rest) of counts."""
    hashes, near, where = _VOCABULARY
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "foreign")}
    out["lang"] = np.array([language(x) for x in langs], object)
    hist = out["hist"] = np.zeros((n, N_CLASS + N_WORD), np.int64)
    code = {x: k for k, x in enumerate(LANGS)}
    for low, high, w in runs(texts):
        first = w.first
        count = np.diff(first)
        out["n_words"][low:high] = count
        maybe = np.flatnonzero(near[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(hashes, w.hash[maybe])
        at[at == len(hashes)] = 0
        found = hashes[at] == w.hash[maybe]
        maybe, at = maybe[found], at[found]
        owner = np.searchsorted(first, maybe, "right") - 1
        out["n_repeat_words"][low:high] = _repeats(w, count)
        for i in range(low, high):
            a, b = w.at[i - low], w.at[i - low + 1] - 1
            raw = w.raw[a:b]
            by = np.bincount(w.data[a:b], minlength=256)
            c = np.bincount(_CLASS_OF + 1, weights=by, minlength=N_CLASS + 1)[1:].astype(np.int64)
            hist[i, :N_CLASS] = c
            out["word_chars"][i] = c.sum() - c[3]
            out["n_symbols"][i] = c[5]
            if b"\n" in raw:
                lines = [x for x in raw.split(b"\n") if x.strip()]
                out["n_dup_lines"][i] = len(lines) - len(set(lines))
        edge = np.searchsorted(owner, np.arange(high - low + 1))
        for i in range(low, high):
            mine = at[edge[i - low] : edge[i - low + 1]]
            hits = where[:, mine]
            k = code.get(out["lang"][i], -1)
            if k < 0:  # no list: all words are rest
                hist[i, -1] = count[i - low]
                continue
            only = ((hits >= 0) & (hits[k] < 0)).sum(axis=1), ((hits < 0) & (hits[k] >= 0)).sum(axis=1)
            out["foreign"][i] = (only[0] >= FOREIGN + 3 * only[1]).any()
            own = hits[k][hits[k] >= 0]
            hist[i, N_CLASS : N_CLASS + N_WORD - 1] = np.bincount(own, minlength=N_WORD - 1)
            hist[i, -1] = count[i - low] - len(own)
    return out


def _repeats(w: Words, count: np.ndarray) -> np.ndarray:
    """Words of each text that lie in 8-word windows found twice or more in it."""
    n, first = REPEAT_WINDOW, w.first
    total = np.zeros(len(count), np.int64)
    h = windows_hash(w.hash, n)
    if not len(h):
        return total
    owner = np.repeat(np.arange(len(count)), count)
    inside = owner[: len(h)] == owner[n - 1 :]
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = mix64(h[at] + (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return total
    near = np.zeros(1 << 20, bool)
    near[(twice & np.uint64(0xFFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(near[(key & np.uint64(0xFFFFF)).astype(np.int64)])
    pos = np.minimum(np.searchsorted(twice, key[some]), len(twice) - 1)
    some = at[some[twice[pos] == key[some]]]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, some, 1)
    np.add.at(cover, some + n, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


_VOCABULARY = _vocabulary()


def base_failed(f: dict) -> np.ndarray:
    return (f["n_words"] < MIN_BASE_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from counts ``q``; 0 for an empty side."""
    sp, sq = p.sum(axis=1, keepdims=True), q.sum(axis=1, keepdims=True)
    a, b = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (a, b)]
    return np.where((sp[:, 0] > 0) & (sq[:, 0] > 0), np.sqrt(np.clip((kl[0] + kl[1]) / 2, 0, 1)), 0.0)


def _own(f: dict, reference: dict[str, np.ndarray]) -> np.ndarray:
    """Each text's reference; zeros where its language has none (distance 0)."""
    none = np.zeros(N_CLASS + N_WORD)
    return np.array([reference.get(x, none) for x in f["lang"]]).reshape(-1, N_CLASS + N_WORD)


_CLASSES, _COMMON = slice(0, N_CLASS), slice(N_CLASS, N_CLASS + N_WORD - 1)


def divergence(f: dict, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distances of classes and of common words, and the second one's part of what chance makes of
    as many common words (sqrt((bins - 1) / (8 ln 2 words)), the mean of a multinomial sample); 0
    below the length guards."""
    found = f["hist"][:, _COMMON].sum(axis=1)
    guard = f["n_words"] >= MIN_WORDS
    classes, common = (np.where(g, distance(f["hist"][:, s], own[:, s]), 0.0) for g, s in ((guard, _CLASSES), (guard & (found >= MIN_COMMON), _COMMON)))
    bins = np.count_nonzero(own[:, _COMMON], axis=1)
    chance = np.sqrt(np.maximum(bins - 1, 1) / (8 * np.log(2) * np.maximum(found, 1)))
    return classes, common, common / chance


def lacking(f: dict, own: np.ndarray) -> np.ndarray:
    """Which texts have too few common words for their language, or those of another one.
    Chances are Chernoff bounds of a binomial; false below the length guard and without a list."""
    n = np.maximum(f["n_words"], 1)
    listed = np.isin(f["lang"].astype(str), LANGS)
    share = f["hist"][:, N_CLASS:-1].sum(axis=1) / n
    usual = np.clip(own[:, N_CLASS:-1].sum(axis=1) / np.maximum(own[:, N_CLASS:].sum(axis=1), 1), 1e-12, 1 - 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = n * sum(np.where(x > 0, x * np.log(x / y), 0) for x, y in ((share, usual), (1 - share, 1 - usual)))
    few = (share < MIN_SHARE * usual) & (chance >= CHANCE)
    return listed & (f["n_words"] >= MIN_WORDS) & (few | (f["foreign"] > 0))


def passes(f: dict, reference: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Verdict of base rules and method, failure of the base rules, both distances."""
    own = _own(f, reference)
    c, w, excess = divergence(f, own)
    bad = base_failed(f)
    return ~bad & (c <= MAX_CLASS) & ((w <= MAX_COMMON) | (excess <= EXCESS)) & ~lacking(f, own), bad, c, w


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, five counts, foreign, lang, hist) by document, stored."""
    names = ["doc_id", *_FIELDS, "foreign", "lang", "hist"]

    def run(batches):
        for b in pieces(batches):
            f = features(b.column("text").to_pylist(), b.column("lang").to_pylist())
            flat = pa.ListArray.from_arrays(np.arange(0, f["hist"].size + 1, f["hist"].shape[1], dtype=np.int32), pa.array(f["hist"].ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(f[k]) for k in (*_FIELDS, "foreign")), pa.array(f["lang"], pa.string()), flat], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    return stored(rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in _FIELDS)}, foreign long, lang string, hist array<long>"), "quality")


def references(found: DataFrame) -> dict[str, np.ndarray]:
    """Mean shares (times a constant) by language, over all documents that pass the base rules and the
    length guard. One row a language, of which there are at most 26^2 + 26^3 + 1, comes to the driver."""
    n = N_CLASS + N_WORD
    fine = found.where(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = [F.slice("hist", 1, N_CLASS), F.slice("hist", N_CLASS + 1, N_WORD)]
    fine = fine.select("lang", "hist", *[F.greatest(add(p), F.lit(1)).alias(f"all{k}") for k, p in enumerate(parts)])
    share = lambda i: F.floor(F.col("hist")[i] * float(1 << SHARE_BITS) / F.col(f"all{int(i >= N_CLASS)}"))
    sums = fine.groupBy("lang").agg(*[F.sum(share(i)).alias(f"h{i}") for i in range(n)])
    return {r["lang"]: np.array([r[f"h{i}"] for i in range(n)], float) for r in sums.collect()}


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdicts by document.

    Null text counts as no words, so it fails the base rules, as do empty and very short
    texts; a null or unknown ``lang`` is judged by the classes of its own kind only; repeated
    rows are judged alike; an empty table gives no rows; very long texts are read whole; other
    columns are ignored.
    """
    found = measured(docs)
    reference = references(found)

    def run(batches):
        for b in batches:
            f = {k: b.column(k).to_numpy() for k in (*_FIELDS, "foreign")} | {"lang": np.array(b.column("lang").to_pylist(), object)}
            f["hist"] = np.asarray(b.column("hist").flatten()).reshape(len(b), N_CLASS + N_WORD)
            keep, bad, c, w = passes(f, reference)
            names = ["doc_id", *_FIELDS, "base_failed", "kept", "class_distance", "common_distance"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(k) for k in _FIELDS), *map(pa.array, (bad, keep, c, w))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in _FIELDS)}, base_failed boolean, kept boolean, class_distance double, common_distance double")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged; references are those of all of ``docs``.

    Cases are those of :func:`judge`: rows without text or with few words go, repeated rows
    stay or go together, columns of any name and type are handed on, an empty table stays empty.
    """
    found = measured(docs)
    reference = references(found)
    drop_stored(found)

    def run(batches):
        for b in pieces(batches):
            f = features(b.column("text").to_pylist(), b.column("lang").to_pylist())
            yield b.filter(pa.array(passes(f, reference)[0]))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
