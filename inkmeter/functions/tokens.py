"""The tokenisers. Each measure names the one it uses; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE

#: The token patterns.
WORD = r"[a-z'’]+"
#: What ``WORD`` finds in the lower case of a text: the Kelvin sign becomes a k, the dotted capital an i and a mark that ends the word.
ANY_CASE_WORD = r"[A-Za-z\x{212A}'’]*\x{130}|[A-Za-z\x{212A}'’]+"
GRAM_WORD = r"[a-z0-9']+"
APPROX = rf"[A-Za-z]{{1,4}}|[^{SPACE}A-Za-z]"
LETTERS = r"\p{L}+"
LOOP_WORD = r"[\p{L}\p{N}'’]+"
RUN = rf"[^{SPACE}]+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return _all(F.lower(text), WORD)


def n_words(text: Column) -> Column:
    """Length of a text in words; counts without making the words or the lower case."""
    return F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long")


def gram_words(text: Column) -> Column:
    return _all(F.translate(F.lower(text), "’‘", "''"), GRAM_WORD)


def approx_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(APPROX)).cast("long")


def letter_runs(text: Column) -> Column:
    return _all(text, LETTERS)


def loop_words(text: Column) -> Column:
    return _all(F.lower(text), LOOP_WORD)


def runs(text: Column) -> Column:
    return _all(text, RUN)


def n_runs(text: Column) -> Column:
    """How many runs a text has; counts without making them."""
    return F.regexp_count(text, F.lit(RUN))


def folded_words(text: Column) -> Column:
    return _all(F.lower(text), r"[a-z0-9]+")


def grams(tokens: Column, n: int) -> Column:
    """The distinct runs of ``n`` tokens; none for fewer tokens."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for use in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def length_bin(words_: Column) -> Column:
    """0 to 3 for 80-129, 130-219, 220-399 and 400-800 words, else -1.

    The count is evaluated once, also where a filter on the bin is pushed down to the text.
    """
    return let(words_, lambda w: F.when(w.between(80, 129), 0).when(w.between(130, 219), 1).when(w.between(220, 399), 2).when(w.between(400, 800), 3).otherwise(-1))


def length_stratum(words_: Column) -> Column:
    """A tenth wide on a log scale; null for no words."""
    return F.when(words_ > 0, F.floor(F.log(words_.cast("double")) / F.log(F.lit(1.1)))).cast("long")
