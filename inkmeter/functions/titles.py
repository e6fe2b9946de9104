"""Titles and abstracts: how alike two are, and what a search may ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import folded
from .tokens import let

# ---- fixed values: stop words of the index, stock words of abstracts, word breaks ----
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
GENERIC = "we our here also can which has have been its paper propose proposed present presents novel method methods approach result results show shows study work based using new problem".split()
BREAK = r"[\s\-‐-―/]+"
EDGE = r"^[(\"`,.:;!?\[\]]+|[)\"`,.:;!?\]]+$"
# ---- end of the fixed values ----


def title_words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), F.lit(0))


def trigram_share(a: Column, b: Column) -> Column:
    """Share of the word trigrams of ``a`` that ``b`` holds; 0 without trigrams. Both are arrays of words."""

    def grams(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(grams(a), lambda x: share_held(x, grams(b)))


def share_held(a: Column, b: Column) -> Column:
    """Share of the distinct elements of ``a`` that ``b`` holds; 0 without elements."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    """Dice likeness of two arrays of words as sets; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    size = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * both / size).otherwise(0.0)


def title_terms(title: Column, most: int = 8) -> Column:
    """The plain ASCII words of a title of three letters or more that are no stop words, longest first, then by name."""
    parts = F.transform(F.split(title, BREAK), lambda x: F.lower(F.regexp_replace(x, EDGE, "")))
    kept = F.array_distinct(F.filter(parts, lambda x: x.rlike("^[a-z0-9]{3,}$") & ~x.isin(*STOP)))
    return F.slice(F.array_sort(kept, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), 1, most)


def abstract_phrase(text: Column, least: int = 6, size: int = 8, score: int = 15) -> Column:
    """The window of ``size`` plain words with most letters outside stop and stock words; null below ``score``.

    A window never crosses punctuation; a shorter run of ``least`` words is one window.
    """
    runs = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(r"(?<![^ ])[A-Za-z]+(?: [A-Za-z]+)*(?=[,.;:]?(?: |$))"), F.lit(0))
    common = F.array(*map(F.lit, [*STOP, *GENERIC]))

    def windows(run: Column) -> Column:
        words = F.split(F.lower(run), " ")
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size, F.lit(0)) + 1)
        made = F.transform(starts, lambda i: F.slice(words, i, F.lit(size)))
        weigh = lambda w: F.aggregate(w, F.lit(0), lambda acc, x: acc + F.when(F.array_contains(common, x), 0).otherwise(F.length(x)))
        return F.when(F.size(words) >= least, F.transform(made, lambda w: F.struct(weigh(w).alias("score"), F.array_join(w, " ").alias("phrase")))).otherwise(F.array().cast("array<struct<score:int,phrase:string>>"))

    found = F.flatten(F.transform(runs, windows))
    zero = F.struct(F.lit(score - 1).alias("score"), F.lit(None).cast("string").alias("phrase"))
    return F.aggregate(found, zero, lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))["phrase"]
