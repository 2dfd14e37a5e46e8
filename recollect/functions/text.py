"""Text expressions: search tokens, word sets, similarity."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that say nothing about what a memory is about
STOP = "the and for are but not you all can had her was one our out has have been its than that this with from they will".split()


def _accents() -> dict[str, str]:
    """Latin letters with marks, and what is left without them, from the Unicode tables."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return pairs


def _composed() -> dict[str, str]:
    """Letter and mark, and the one letter that both make, in Greek, Cyrillic and kana."""
    pairs = {}
    for code in [*range(0x370, 0x530), *range(0x3040, 0x3100)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]) and unicodedata.normalize("NFC", parts) == chr(code):
            pairs[parts] = chr(code)
    return pairs


_LATIN, _PAIRS = _accents(), _composed()
#: Marks that a text in decomposed form has: those over and under letters, and of voiced kana.
_MARKS = "\u0300-\u036f\u3099\u309a"
_MARKED = re.compile(f"[{_MARKS}]")


def folded(text: Column) -> Column:
    """Lower case; Latin letters without diacritics, letters of other scripts as they are.

    A text in decomposed form gets the letters of the composed one (Greek, Cyrillic, kana),
    marks on other letters go. Only texts that have marks pay for it.
    """
    whole = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), _PAIRS.items(), text)
    plain = F.when(text.rlike(f"[{_MARKS}]"), F.regexp_replace(whole, f"[{_MARKS}]", "")).otherwise(text)
    return F.lower(F.translate(plain, "".join(_LATIN), "".join(_LATIN.values())))


def search_tokens(text: Column) -> Column:
    """Runs of letters, numbers and private-use characters, folded; null: none."""
    return F.filter(F.split(F.coalesce(folded(text), F.lit("")), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def search_terms(text: str) -> list[str]:
    """:func:`search_tokens` of one text, on the driver or in a task: one rule for texts and queries."""
    if _MARKED.search(text):
        for pair, one in _PAIRS.items():
            text = text.replace(pair, one)
        text = _MARKED.sub("", text)
    text = text.translate(str.maketrans(_LATIN)).lower()
    inside = lambda c: (kind := unicodedata.category(c))[0] in "LN" or kind == "Co"
    return [t for t in "".join(c if inside(c) else " " for c in text).split(" ") if t]


def word_set(text: Column) -> Column:
    """Distinct lower-case words of three or more characters, punctuation deleted, no stop words."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    words = F.filter(F.split(plain, r"(?U)\s+"), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def entity_set(entities: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.trim(F.lower(e))))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
