r"""License scans: ordered signature rules over words.

Texts are taken as words ([0-9a-z] and non-ASCII runs, A-Z lower-cased). A search for a few
stems gates the whole text; then a rule runs only where all its keywords stand as words
(:mod:`license_rules` has the rules). Hits are word intervals; one that lies within an
interval of a higher priority, or within a longer one of the same, is suppressed. Base
phrases are counted wherever they stand, suppressed or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, table, text_or_empty
from .license_rules import SIGNATURES

#: Words of the raw text (A-Z still there) and after lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Some keyword of every rule holds one of these, or else it has "under" and a short name.
STEMS = "advertising licen lizenz gpl copyright copyleft permi redistribut domain warrant merchantab reserved proprietary prohibited commons cecill eupl wtfpl".split()
NAMES = "mit apache bsd isc mpl zlib".split()
KEYS = sorted({k for _, _, keys, _ in SIGNATURES for k in keys})
TOP = max(p for p, *_ in SIGNATURES)

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIT = "struct<start:int,back:int,rank:int,label:string>"


def gate(text: Column) -> Column:
    """False only for texts in which no rule can match."""

    def any_of(low: Column, words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        return found

    return let(F.lower(text), lambda low: any_of(low, STEMS) | (low.contains("under") & any_of(low, NAMES)))


def _places(words: Column, pattern: Column) -> Column:
    """Word intervals array<struct<start, end>> where ``pattern`` stands in ``words`` (" w w w ")."""
    # a space before, and one after that stays for the next hit; words hold no control characters
    full = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    spaces = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")

    def cut(marked: Column) -> Column:
        # every piece but the first is a hit and the gap after it
        pieces = F.transform(F.split(marked, "\u0001"), lambda p: F.struct(spaces(F.substring_index(p, "\u0002", 1)).alias("hit"), spaces(p).alias("all")))
        return let(
            pieces,
            lambda ps: F.slice(
                F.zip_with(ps, running(F.transform(ps, lambda p: p["all"])), lambda p, at: F.struct((at - 1).cast("int").alias("start"), (at + p["hit"]).cast("int").alias("end"))),
                2,
                F.greatest(F.size(ps) - 1, F.lit(0)),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int>>")
    return let(F.regexp_replace(words, full, F.lit("\u0001$0\u0002")), lambda m: F.when(F.instr(m, F.lit("\u0001")) > 0, cut(m)).otherwise(none))


def _detections(words: Column, spaced: Column) -> Column:
    """array<struct<start, back = -end, rank = -priority, label>> of all rules, sorted."""
    rules = F.array(*[F.struct(F.lit(-p).alias("rank"), F.lit(label).alias("label"), F.array(*map(F.lit, keys)).alias("keys"), F.lit(pat).alias("pat")) for p, label, keys, pat in SIGNATURES])
    live = let(F.array_intersect(words, F.array(*map(F.lit, KEYS))), lambda there: F.filter(rules, lambda r: F.forall(r["keys"], lambda k: F.array_contains(there, k))))
    hits = F.transform(live, lambda r: F.transform(_places(spaced, r["pat"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["rank"].alias("rank"), r["label"].alias("label"))))
    return F.array_sort(F.array_distinct(F.flatten(hits)))


def _unsuppressed(hits: Column) -> Column:
    """Drops hits within one of a higher priority or within a longer one of the same.

    Sorted by start, then longest, an interval can only lie within earlier ones. For each
    priority it is enough to know the farthest end so far and, of those that reach it, the
    smallest start, as one number; two labels for one interval both stay.
    """
    code = lambda h: -h["back"].cast("long") * (1 << 31) + ((1 << 31) - 1 - h["start"])

    def judged(hs: Column) -> Column:
        far = lambda wanted: running(F.transform(hs, lambda h: F.when(wanted(-h["rank"]), code(h)).otherwise(-1)), lambda a, b: F.greatest(a, b), -1)
        at_least = [far(lambda rank, p=p: rank >= p) for p in range(1, TOP + 2)]
        only = [far(lambda rank, p=p: rank == p) for p in range(1, TOP + 1)]

        def stays(h: Column, i: Column, above: Column, same: Column) -> Column:
            higher = F.element_at(F.element_at(above, -h["rank"] + 1), i + 1)
            mine = F.element_at(F.element_at(same, -h["rank"]), i + 1)
            return (F.shiftright(higher, 31) < -h["back"]) & (mine <= code(h))

        return let(F.array(*at_least), lambda above: let(F.array(*only), lambda same: F.filter(hs, lambda h, i: stays(h, i, above, same))))

    return let(hits, lambda hs: F.when(F.size(hs) > 1, judged(hs)).otherwise(hs))


def detections(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``base`` (array of label and the starts of
    its phrase) and ``hits`` (array of start, back = -end, rank = -priority, label), intervals
    of words, suppressed ones left out."""
    t = text_or_empty()
    words = F.when(gate(t), F.regexp_extract_all(F.translate(t, _UP, _LOW), F.lit(RAW_WORD), F.lit(0)))
    rows = docs.select("doc_id", F.regexp_count(t, F.lit(RAW_WORD)).cast("long").alias("n_words"), words.alias("_w"))

    def scanned(ws: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))

        def found(s: Column) -> Column:
            base = F.array(*[F.struct(F.lit(label).alias("label"), F.transform(_places(s, F.lit(phrase)), lambda x: x["start"]).alias("starts")) for label, phrase in BASE])
            return F.struct(base.alias("base"), _unsuppressed(_detections(ws, s)).alias("hits"))

        return let(spaced, found)

    rows = rows.withColumn("_x", F.when(F.col("_w").isNotNull(), scanned(F.col("_w"))))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("_x.base", F.array().cast("array<struct<label:string,starts:array<int>>>")).alias("base"),
        F.coalesce("_x.hits", F.array().cast(f"array<{_HIT}>")).alias("hits"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans (label:start:end of what is not suppressed).

    score is the share of evidence: 1 - product over distinct labels' best priorities of
    (1 - priority / 7). Null text counts as empty (no words, no labels, score 0); repeated
    rows are scanned alike; whole texts are scanned, in time that grows with text and hits;
    an empty table gives no rows; other columns are ignored.
    """
    rows = detections(docs).withColumn("_base", F.filter("base", lambda b: F.size(b["starts"]) > 0))
    rows = rows.withColumn("_starts", F.flatten(F.transform("_base", lambda b: b["starts"]))).withColumn("_own", F.transform("_base", lambda b: b["label"]))
    names = F.array_sort(F.array_union("_own", F.array_distinct(F.transform("hits", lambda h: h["label"]))))
    best = F.transform(names, lambda n: F.coalesce(F.array_max(F.transform(F.filter("hits", lambda h: h["label"] == n), lambda h: -h["rank"])), F.lit(3)))
    score = 1 - F.aggregate(best, F.lit(1.0), lambda acc, p: acc * (1 - p / (TOP + 1)))
    spans = F.transform("hits", lambda h: F.concat_ws(":", h["label"], h["start"].cast("string"), (-h["back"]).cast("string")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_own"), ",").alias("base_labels"),
        F.array_join(names, ",").alias("labels"),
        F.round(score, 6).alias("score"),
        F.array_join(spans, ",").alias("spans"),
    )


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
