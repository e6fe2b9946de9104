"""Sentences and the evenness of their lengths, as higher-order column functions.

Every place where a sentence may end is found first, with what stands before
and after it. A fold over these places keeps those that do end one; it needs
the running start only for the number of an item that opens a sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import java
from .tokens import let, n_words

# ---- fixed values: the patterns of sentence ends ----
ABBREVIATION = r"\b(?:[Ee]\.g|[Ii]\.e|[Vv]s|[Cc]f|Figs?|Eqs?|[Ww]\.r\.t|i\.i\.d|a\.k\.a|resp)\.$"
NUMBER_SIGN = r"\bNo\.$"
NAME_PART = r"(?:\bet al|(?<![\w.]|\d\s)[A-Z])\.$"
OPENING = r"^(?:A\s+[a-z]|(?:We|The|In|An|It|Its|If|However|And|But|Or|So|There|This|That|These|Those|Our|Their|For|As|On|At|By|To|With|Here|Then|Thus|Hence|Therefore|Moreover|Finally|Additionally|Furthermore|Also|Below|Above|Again|Such|Both|Each|All|Some|No|One|Using|Given|Since|When|While|Although|Let|You|Your|They|He|She|People)\b)"
ITEM = r"[^\S\n]*(?:[-*•+]|\d{1,2}[.)])[^\S\n]"
HEADING_LINE = r"^[^\S\n]*#{1,6}[^\S\n].*$"
CUT = rf"(?<=[.!?])\s+|\n\s*\n\s*|\n(?={ITEM})"
# ---- end of the fixed values ----
#: What every piece ends in that may not end a sentence: all of the vetoes need one of these.
NEAR_VETO = r"(?:\.g|\.e|[Vv]s|[Cc]f|Figs?|Eqs?|\.t|\.d|\.a|resp|No|al|[A-Z]|\d)\.$"


def sentences(text: Column) -> Column:
    """array<string>: the sentences of a text without its heading lines.

    The pieces between the places where one may end are joined on where it
    does not; most texts have no such place, and their pieces are the sentences. Work is linear in the text apart from copies of open sentences.
    """
    plain = F.when(F.contains(text, F.lit("#")), F.regexp_replace(text, java(HEADING_LINE, "m"), "")).otherwise(text)
    cut = java(CUT)
    return let(plain, lambda t: _joined(F.split(t, cut, -1), F.regexp_extract_all(t, F.lit(cut), F.lit(0))))


def _joined(pieces: Column, gaps: Column) -> Column:
    near = lambda x: F.right(x, F.lit(5)).rlike(java(NEAR_VETO))

    def joined(p: Column, g: Column) -> Column:
        rows = F.transform(p, lambda x, i: F.struct(x.alias("piece"), F.get(g, i).alias("gap"), F.get(p, i + 1).alias("next"), near(x).alias("near")))

        def stays(body: Column, x: Column) -> Column:
            """Whether the sentence goes on after ``body``; most pieces are told by their last letters, for a veto never spans a gap."""
            before = F.right(body, F.lit(12))
            after = F.substring(x["next"], 1, 20)
            whole = x["gap"].rlike(java(r"\n\s*\n")) | (x["gap"].rlike(java(r"\n[^\n]*$")) & F.concat(F.regexp_extract(x["gap"], java(r"\n([^\n]*)$"), 1), F.substring(x["next"], 1, 40)).rlike(java("^" + ITEM)))
            item = (F.char_length(body) <= 6) & before.rlike(java(r"^\s*\d{1,2}\.$"))
            veto = item | before.rlike(java(ABBREVIATION)) | (before.rlike(java(NUMBER_SIGN)) & after.rlike("^[0-9]")) | (before.rlike(java(NAME_PART)) & ~after.rlike(java(OPENING)))
            return F.when(x["gap"].isNotNull() & x["near"], F.coalesce(veto, F.lit(False)) & ~F.coalesce(whole, F.lit(False))).otherwise(False)

        def step(acc: Column, x: Column) -> Column:
            def after(body: Column, on: Column) -> Column:
                return F.struct(
                    F.when(on, acc["out"]).otherwise(F.concat(acc["out"], F.array(body))).alias("out"),
                    F.when(on, F.concat(body, F.coalesce(x["gap"], F.lit("")))).otherwise(F.lit("")).alias("open"),
                )

            return let(F.concat(acc["open"], x["piece"]), lambda body: let(stays(body, x), lambda on: after(body, on)))

        zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))
        return F.aggregate(rows, zero, step, lambda acc: acc["out"])

    kept = let(pieces, lambda p: F.when(F.exists(p, near), let(gaps, lambda g: joined(p, g))).otherwise(p))
    return F.filter(kept, lambda s: s.rlike(java(r"\S\s*\S")))


def sentence_length_cv(text: Column) -> Column:
    """Population deviation over mean of sentence lengths; null below five sentences with words."""
    lengths = F.filter(F.transform(sentences(text), lambda s: n_words(s).cast("double")), lambda n: n > 0)

    def cv(ls: Column) -> Column:
        mean = F.aggregate(ls, F.lit(0.0), lambda a, x: a + x) / F.size(ls)
        return let(mean, lambda m: F.sqrt(F.aggregate(ls, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(ls)) / m)

    return let(lengths, lambda ls: F.when(F.size(ls) >= 5, cv(ls)))


_SPACES = re.compile("[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_STOPS = re.compile(r"[.!?\n]")


def _flat(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def matches_in_sentences(text: str, pattern: re.Pattern, most: int = 240) -> list[str]:
    """For each match the sentence around it, its white space squeezed.

    A sentence reaches from stop to stop (. ! ? or a line's end). One of more
    than ``most`` characters (code points) is cut to a window of as many with
    the match in its middle, and dots tell where it goes on.
    """
    stops, out = [m.start() for m in _STOPS.finditer(text)], []
    for m in pattern.finditer(text):
        left, right = bisect_left(stops, m.start()), bisect_left(stops, m.end())
        begin = stops[left - 1] + 1 if left else 0
        raw = text[begin : stops[right] + 1 if right < len(stops) else len(text)]
        shown = _flat(raw)
        if len(shown) > most:
            room = max(0, (most - (m.end() - m.start())) // 2)
            upto = min(len(raw), max(0, m.start() - begin - room) + most)
            since = max(0, upto - most)
            shown = "…" * (since > 0) + _flat(raw[since:upto]) + "…" * (upto < len(raw))
        out.append(shown)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences_around(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """The sentences around the matches of ``pattern`` (ECMAScript, ignoring case, without white-space classes)."""
    return pd.Series([matches_in_sentences(t, re.compile(p, re.A | re.I)) for t, p in zip(text, pattern, strict=True)])
