r"""Secret scans: named patterns plus a randomness test battery with false-discovery control.

Only DataFrame functions: matches are located by splitting the text at a pattern and
adding up the lengths of gaps and matches, so positions are code points.

The battery takes tokens of 20 or more characters with digits and letters or mixed case,
infers an encoding (hex, base32, base36, base62, base64) and tests them as draws from its
alphabet. Of the alphabets that fit, the smallest counts that no test rejects:

* chi-squared uniformity (Wilson-Hilferty),
* runs above and below the middle of the alphabet (Wald-Wolfowitz),
* lag-one serial correlation.

A token that a test rejects (Bonferroni over the three) is no discovery; its p-value is 1.
For the others the same three statistics are set against what names, paths and prose in the
alphabet have, which gives a p-value of being language: chi-squared by way of the rate of
repeated characters, runs and correlation against theirs, combined by weighted sums of
normal deviates. Benjamini-Hochberg runs over these p-values within strata of encoding and
length (powers of two), from a histogram of their logarithms, so that short tokens with
little evidence pay for their own number. The tested set is the set that can be reported:
tokens that overlap a span of a named pattern are neither. Spans of named patterns stay
whatever the battery says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, stored, table, text_or_empty

# fixed values: the named patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 and more characters
HEX = r"[0-9a-f]{32,}"
MIN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: encoding: pattern, alphabet; of language in it: sum of squares and of cubes of the
#: characters' shares, and how often neighbours lie in different halves of the alphabet
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.14, 0.03, 0.5),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066, 0.0056, 0.45),
    ("base32 lower", r"^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 0.066, 0.0056, 0.45),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.066, 0.0056, 0.5),
    ("base36 upper", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.066, 0.0056, 0.5),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.05, 0.0034, 0.35),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.05, 0.0034, 0.45),
    ("base64 url", r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.05, 0.0034, 0.5),
    ("base64 mixed", r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 0.05, 0.0034, 0.5),
)
#: Weights of the three deviates; the correlation of neighbours in language.
WEIGHTS, CORRELATION = (1.0, 0.5, 0.25), -0.05
FALSE_DISCOVERY, REJECT = 0.05, 0.001
#: Logarithms of p-values in tenths of a decade; beyond 300 decades nothing can change.
_BIN, _BINS = 0.1, 3000
_SPAN = "array<struct<start:int,end:int,rank:int,cut:int>>"
_TOKENS = "array<struct<start:int,end:int,b:struct<stratum:int,bin:int,random:boolean>>>"


def located(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, hit>>, empty unless ``gate``."""
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")),
    )

    def placed(ps: Column) -> Column:
        before = running(F.transform(ps, lambda p: (p["gap"] + F.length(p["hit"])).cast("long")))
        return F.zip_with(ps, before, lambda p, at: F.struct((at + p["gap"]).cast("int").alias("start"), (at + p["gap"] + F.length(p["hit"])).cast("int").alias("end"), p["hit"].alias("hit")))

    return F.when(gate, let(F.filter(parts, lambda p: p["hit"].isNotNull()), placed))


def _clear_of(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no span of ``base``, by one sort of both."""
    none, far = F.lit(None).cast("string"), 1 << 40
    every = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("kind"), s["end"].alias("end"), none.alias("hit"))),
            F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("kind"), t["end"].alias("end"), t["hit"].alias("hit"))),
        )
    )

    def clear(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: F.when(x["kind"] == 0, x["end"].cast("long")).otherwise(-1)), lambda a, b: F.greatest(a, b), -1)
        starts = F.reverse(running(F.reverse(F.transform(xs, lambda x: F.when(x["kind"] == 0, x["start"].cast("long")).otherwise(far))), lambda a, b: F.least(a, b), far))
        free = lambda x, e, s: (x["kind"] == 1) & (e <= x["start"]) & (s >= x["end"])
        return let(ends, lambda es: let(starts, lambda ss: F.filter(xs, lambda x, i: free(x, F.element_at(es, i + 1), F.element_at(ss, i + 1)))))

    return let(every, clear)


def _as_spans(found: Column, rank: int, value: str | None = None) -> Column:
    cut = (lambda x: x["end"] - F.length(F.regexp_extract(x["hit"], value, 2))) if value else (lambda x: x["start"])
    out = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), cut(x).alias("cut")))
    return F.coalesce(out, F.array().cast(_SPAN))


# fixed values: a rational fit of the complementary error function, within 1.2e-7 of itself everywhere
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _log_above(z: Column) -> Column:
    """Natural logarithm of the chance that a normal deviate exceeds ``z`` (a plain field), however small."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    upper = F.log(t / 2) - x * x + poly
    return F.when(z >= 0, upper).otherwise(F.log1p(-F.exp(upper)))


def battery(token: Column) -> Column:
    """struct<stratum, bin, random>: the stratum of the token, the bin of its p-value as
    language, and whether no randomness test rejects it (if one does, the bin is 0)."""
    rules = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(float(len(a))).alias("k"), F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(r).alias("r"))
            for i, (_, p, a, s, c, r) in enumerate(ENCODINGS)
        ]
    )

    def tests(e: Column) -> Column:
        same_case = F.when(e["i"] == 0, F.lower(token)).otherwise(token)
        code = F.transform(F.filter(F.split(same_case, ""), lambda c: c != ""), lambda c: F.instr(e["a"], c) - 1)
        return let(code, lambda x: _statistics(x, e))

    fitting = F.transform(F.filter(rules, lambda e: F.regexp_like(token, e["p"])), tests)
    # a token that every alphabet rejects counts as language of the smallest
    return let(fitting, lambda x: F.element_at(F.concat(F.filter(x, lambda b: b["random"]), x), 1))


def _statistics(x: Column, e: Column) -> Column:
    k = e["k"]
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter(x, lambda c: c == d)).cast("double"), F.lit(2.0)))
    n = F.size(x).cast("double")
    total = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + c)
    high = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + (c * 2 >= k).cast("int"))
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    base = F.struct(n.alias("n"), squares.alias("sq"), (total / n).alias("mean"), high.alias("n1"))

    def more(s: Column) -> Column:
        n, mean, n1 = s["n"], s["mean"], s["n1"]
        sums = F.aggregate(
            pairs,
            F.struct(F.lit(0.0).alias("cross"), F.lit(1.0).alias("runs")),
            lambda acc, p: F.struct((acc["cross"] + (p["a"] - mean) * (p["b"] - mean)).alias("cross"), (acc["runs"] + F.when((p["a"] * 2 >= k) != (p["b"] * 2 >= k), 1.0).otherwise(0.0)).alias("runs")),
        )
        spread = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
        chi, df = k / n * s["sq"] - n, k - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

        def last(r: Column) -> Column:
            expect = 1 + 2 * n1 * (n - n1) / n
            var = (expect - 1) * (expect - 2) / (n - 1)
            z_runs = F.when(var > 0, (r["runs"] - expect) / F.sqrt(F.when(var > 0, var).otherwise(1.0))).otherwise(99.0)
            lag = F.when(spread > 0, r["cross"] / F.when(spread > 0, spread).otherwise(1.0)).otherwise(1.0)
            z_serial = F.when(spread > 0, lag * F.sqrt(n)).otherwise(99.0)
            # the same statistics as those of language: repeats (what chi-squared counts), runs, correlation
            repeat = (s["sq"] - n) / (n * (n - 1))
            sd = F.sqrt(2 * e["s"] * (1 - e["s"]) / (n * (n - 1)) + 4 * (e["c"] - e["s"] * e["s"]) / n)
            far = ((e["s"] - repeat) / sd, (r["runs"] - 1 - (n - 1) * e["r"]) / F.sqrt(2 * (n - 1) * e["r"] * (1 - e["r"])), (CORRELATION - lag) * F.sqrt(n))
            z = sum((w * d for w, d in zip(WEIGHTS, far, strict=True)), F.lit(0.0)) / sum(w * w for w in WEIGHTS) ** 0.5
            every = F.struct(z_chi.alias("chi"), F.abs(z_runs).alias("runs"), F.abs(z_serial).alias("serial"), z.alias("language"))
            return let(every, lambda d: _verdict(d, (e["i"] * 100 + F.floor(F.log2(n)).cast("int")).alias("stratum")))

        return let(sums, last)

    return let(base, more)


def _verdict(d: Column, stratum: Column) -> Column:
    worst = F.least(_log_above(d["chi"]), math.log(2) + _log_above(d["runs"]), math.log(2) + _log_above(d["serial"]))
    random = worst >= math.log(REJECT / 3)
    bin_ = F.least(F.floor(_log_above(d["language"]) / (-math.log(10) * _BIN)), F.lit(_BINS)).cast("int")
    return F.struct(stratum, F.when(random, bin_).otherwise(0).alias("bin"), random.alias("random"))


def scanned(docs: DataFrame, row: Column) -> DataFrame:
    """(row, base, tokens): ``row`` of ``docs``, spans of named patterns by start, and the tested tokens."""
    text = F.col("text")
    mixed = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]"
    found = docs.select(row.alias("row"), text_or_empty().alias("text")).select(
        "row",
        F.filter(located(text, ASSIGN, text.rlike(ASSIGN)), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= MIN_VALUE).alias("assign"),
        located(text, ACCESS, text.contains("AKIA")).alias("access"),
        located(text, HEX, text.rlike(HEX)).alias("hex"),
        F.filter(located(text, TOKEN, text.rlike(TOKEN)), lambda x: F.regexp_like(x["hit"], F.lit(mixed))).alias("long"),
    )
    base = F.array_sort(F.concat(_as_spans(F.col("assign"), 0, ASSIGN), _as_spans(F.col("access"), 1), _as_spans(F.col("hex"), 2)))
    found = found.select("row", base.alias("base"), "long").withColumn("long", F.when(F.size("long") > 0, _clear_of(F.col("long"), F.col("base"))))
    tested = F.transform("long", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["hit"]).alias("b")))
    return found.select("row", "base", F.coalesce(tested, F.array().cast(_TOKENS)).alias("tokens"))


def cutoffs(tokens: DataFrame) -> dict[int, int]:
    """For each stratum the lowest bin that Benjamini-Hochberg accepts, of rows with ``tokens``.
    The histogram that comes to the driver has at most encodings x length classes x bins rows."""
    rows = tokens.select(F.explode("tokens").alias("x")).groupBy("x.b.stratum", "x.b.bin").count().collect()
    by: dict[int, dict[int, int]] = {}
    for stratum, b, n in rows:
        by.setdefault(stratum, {})[b] = n
    found = {}
    for stratum, bins in by.items():
        m, upto = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            upto += bins[b]
            if m * 10 ** (-b * _BIN) <= FALSE_DISCOVERY * upto:
                found[stratum] = b
    return found


def all_spans(base: Column, tokens: Column, cut: dict[int, int]) -> Column:
    """Named spans and the discoveries among the tested tokens; by start, then kind."""
    if not cut:
        return base
    least = F.create_map(*[F.lit(v) for kv in sorted(cut.items()) for v in kv])
    fine = F.filter(tokens, lambda x: x["b"]["random"] & (x["b"]["bin"] >= F.coalesce(F.try_element_at(least, x["b"]["stratum"]), F.lit(1 << 20))))
    more = F.transform(fine, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(3).alias("rank"), x["start"].alias("cut")))
    return F.array_sort(F.concat(base, more), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["end"] - b["end"]))


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random,
    base_sha256, spans.

    Null text counts as empty (no spans, the digest of ""); repeated rows are scanned
    alike, and each counts in the false-discovery control; texts are scanned whole; other
    columns are ignored; an empty table gives no rows.
    """
    found = stored(scanned(docs, F.col("doc_id")).withColumnRenamed("row", "doc_id"), "secrets")
    spans = all_spans(F.col("base"), F.col("tokens"), cutoffs(found))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    ordered = F.array_sort("base", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return found.withColumn("spans", spans).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(ordered).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (of an assignment only its
    value) and ``n_chars``, where there is such a column, set to the new length where a text
    changed. Other rows and columns stay as they are, whatever their names; a null text stays
    null, repeated rows are redacted alike, and an empty table stays empty."""
    names, text = docs.columns, F.col("row.text")
    rows = scanned(docs, F.struct(*[F.col(f"`{c}`") for c in names]))
    cut = cutoffs(rows.select("tokens"))
    spans = F.col("spans")
    ends = running(F.transform(spans, lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b))
    # a value that begins within an earlier span is gone with it
    piece = lambda s, at: F.when(s["cut"] >= at, F.concat(F.substring(text, (at + 1).cast("int"), (s["cut"] - at).cast("int")), F.lit(mark))).otherwise("")
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    new = F.when(F.size(spans) > 0, F.concat(F.array_join(F.zip_with(spans, ends, piece), ""), rest)).otherwise(text)
    done = rows.select("row", all_spans(F.col("base"), F.col("tokens"), cut).alias("spans")).select("row", F.size(spans).alias("n"), new.alias("new"))
    columns = {"text": F.col("new")}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("n") > 0, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def query(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
