"""Anonymisation tokens of a corpus: found, told from the writer's own capitals, and taken out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: the shape of a token and the words of the scheme ----
TOKEN = re.compile(r"(?<![A-Z0-9_])(?:[A-Z][A-Za-z0-9]*|[A-Z0-9]+)(?:_[A-Za-z0-9]+)+(?![A-Za-z0-9_])")
SCHEME = "GENERIC GENRIC GENERRIC PROPER PROEPR STUDENT TEACHER RELATIVE OTHER LOCATION NAMES NAME SCHOOLS SCHOOL CITY STATE STREET ADDRESS EMAIL PHONE NUMBER ZIP CODE MONTH DAY YEAR HOTEL TEST COURSE LAST".split()
# ---- end of the fixed values ----

_PART = re.compile("((?i:" + "|".join(sorted(SCHEME, key=len, reverse=True)) + "))([a-z]*)")
_BLANKS = re.compile(r"[^\S\n]{2,}")


def placeholder(token: str) -> str | None:
    """The placeholder that a token begins with: two words of the scheme or more; None without.

    A lower-case tail glued to the last word is the writer's and no part of it.
    """
    words: list[str] = []
    for part in token.split("_"):
        m = _PART.fullmatch(part)
        if m:
            words.append(m[1])
        if not m or m[2]:
            break
    return "_".join(words) if len(words) > 1 else None


def stripped(text: str | None) -> tuple[str | None, int]:
    """The text without its placeholders, and how many there were.

    A glued tail of one letter goes, a longer one stays. Blanks left behind are
    closed up; a text without placeholders stays as it is.
    """
    if not text:
        return text, 0
    gone = 0

    def cut(m: re.Match) -> str:
        nonlocal gone
        found = placeholder(m[0])
        if found is None:
            return m[0]
        gone += 1
        rest = m[0][len(found) :]
        return rest if len(rest) > 1 else ""

    out = TOKEN.sub(cut, text)
    if not gone:
        return text, 0
    return "\n".join(line.strip() for line in _BLANKS.sub(" ", out).split("\n")).strip(), gone


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
def strip_placeholders(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stripped(t) for t in text], columns=["text", "removed"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("removed", T.BooleanType())])))
def scanned_tokens(text: pd.Series) -> pd.Series:
    """Every token of the shape, with whether it is a placeholder of the scheme."""
    return pd.Series([[{"token": m[0], "removed": placeholder(m[0]) is not None} for m in TOKEN.finditer(t or "")] for t in text])
