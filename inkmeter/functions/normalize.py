"""Text normalisation. Flat rewrites are columns; nested markup is parsed in an Arrow kernel."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import BLANK, SPACE, java
from .tokens import let

# ---- fixed values: entities, the Windows-1252 range, line forms ----
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": "", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "bull": "•", "middot": "·", "times": "×", "minus": "−", "deg": "°",
}
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([a-zA-Z][a-zA-Z0-9]{1,31}));")
ITEM = r"^(?:[-*•+]|\d{1,2}[.)]) "
HEADING = r"^#{1,6} "
BLOCK_TAGS = "div br hr h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tr section article aside header footer figure figcaption details summary".split()
# ---- end of the fixed values ----


def entity(m: re.Match) -> str:
    """What one character reference stands for; an unknown name stays as it is."""
    if m[3]:
        return NAMED.get(m[3], m[0])
    code = int(m[1], 16) if m[1] else int(m[2])
    if 0x80 <= code <= 0x9F:
        return CP1252[code - 0x80]
    return "�" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """Character references decoded in one pass; only rows that hold one are touched."""
    return s.map(lambda x: ENTITY.sub(entity, x) if x and "&" in x else x)


def squeezed(text: Column) -> Column:
    """Line breaks kept, other space runs one blank, at most one blank line, trimmed."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, f"[{BLANK}]+", " ")
    text = F.regexp_replace(text, " ?\n ?", "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def plain_text(text: Column) -> Column:
    return squeezed(decode_entities(text))


def join_wraps(text: Column) -> Column:
    """Single line breaks that only wrap become blanks.

    A break stays beside a blank line, a heading or a list item. Whether a line
    is an item depends on the item state of the line before it, so the lines
    are folded from the left.
    """

    def folded(lines: Column) -> Column:
        rows = F.transform(lines, lambda cur, i: F.struct(cur.alias("cur"), F.get(lines, i - 1).alias("prev"), F.get(lines, i + 1).alias("next")))

        def step(acc: Column, x: Column) -> Column:
            looks = x["cur"].rlike(ITEM)
            item = looks & ((x["prev"] == "") | x["prev"].rlike(r"[.:!?;]\z") | acc["item"] | F.coalesce(x["next"].rlike(ITEM), F.lit(False)))
            first = x["prev"].isNull()
            breaks = (x["cur"] == "") | (x["prev"] == "") | item | x["cur"].rlike(HEADING) | x["prev"].rlike(HEADING)
            out = F.when(first, x["cur"]).otherwise(F.concat(acc["out"], F.when(breaks, "\n").otherwise(" "), x["cur"]))
            return F.struct(F.coalesce(out, F.lit("")).alias("out"), F.coalesce(F.when(first, looks).when(breaks, item).otherwise(acc["item"]), F.lit(False)).alias("item"))

        zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("item"))
        return F.aggregate(rows, zero, step, lambda acc: acc["out"])

    return let(F.split(text, "\n", -1), folded)


def source_text(text: Column) -> Column:
    return join_wraps(plain_text(text))


def prose_length(text: Column) -> Column:
    """Characters without bold marks, heading and list marks, with space runs as one."""
    bare = F.regexp_replace(text, r"(?md)\*\*|^#{1,6} |^(?:[-*•+]|\d{1,2}[.)]) ", "")
    return F.char_length(F.regexp_replace(F.regexp_replace(bare, f"[{SPACE}]+", " "), r"^ | \z", "")).cast("long")


_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>|<[^>]+>", re.S)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("pre", "code")}
_ITEM_PARAGRAPH = re.compile(r"\s*(?:<p\b[^>]*>)?", re.I)  # an item's own paragraph does not break it
_LINE_TAG = re.compile(r"<p\b[^>]*>|<br\s*/?>", re.I)


def _own_words(html: str) -> str:
    """``html`` without comments, quotations and closed code; what goes leaves a break or a blank.

    A code element that is never closed is no element: what follows it stays.
    """
    out, quote, at, missing = [], 0, 0, set()
    while m := _TAG.search(html, at):
        if not quote:
            out.append(html[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if name in _CLOSED and not m[1]:
            end = None if name in missing else _CLOSED[name].search(html, at)
            if end:
                at = end.end()
                out.append("" if quote else "<br>" if name == "pre" else " ")
                continue
            missing.add(name)
        if name == "blockquote":
            quote = max(0, quote - 1) if m[1] else quote + 1
            out.append("<br>")
        elif not quote and not m[0].startswith("<!--"):
            out.append(m[0])
    return "".join(out) + ("" if quote else html[at:])


def _unquoted_lines(html: str) -> str:
    """Lines typed with > in front go, and their indented continuation; each paragraph begins anew."""
    if ">" not in re.sub(r"<[^>]*>", "", html) and "&gt;" not in html:
        return html
    out, at = [], 0
    for m in [*_LINE_TAG.finditer(html), None]:
        kept, quoting = [], False
        for line in html[at : m.start() if m else len(html)].split("\n"):
            bare = re.sub(r"<[^>]+>", "", line)
            quoting = bool(re.match(r"\s*(?:&gt;|>)", bare)) or (quoting and bool(re.match(r"\s+\S", bare)))
            if not quoting:
                kept.append(line)
        out.append("\n".join(kept))
        if m:
            out.append(m[0])
            at = m.end()
    return "".join(out)


def html_text(html: str | None) -> str | None:
    """The text of a page as its reader sees it, with headings, items and bold as Markdown.

    Quotations, code, comments and quoted lines are left out, white space of
    the source is one blank, and block elements make line breaks. Lists are a
    stack, so an item belongs to the innermost open list. White space at the
    edges of bold text stands outside its marks.
    """
    if html is None:
        return None
    html = re.sub(r"\s+", " ", _unquoted_lines(_own_words(html)))
    html = re.sub(r"</li\s*>\s*(?=<li\b)", "", html, flags=re.I)  # the next item breaks the line
    out, lists, at = [], [], 0
    while m := _TAG.search(html, at):
        piece = html[at : m.start()]
        at, close, name = m.end(), m[1], (m[2] or "").lower()
        if name in ("strong", "b"):
            if close:
                out.append(piece.rstrip() + "**" + piece[len(piece.rstrip()) :])
            else:
                edge = html[at : at + 1] == " "
                at += edge
                out.append(piece + " " * edge + "**")
            continue
        out.append(piece)
        if name in ("ol", "ul"):
            if close:
                del lists[-1:]
            else:
                lists.append([name, 0])
            out.append("\n")
        elif name == "li" and not close:
            mark = "- "
            if lists and lists[-1][0] == "ol":
                lists[-1][1] += 1
                mark = f"{lists[-1][1]}. "
            out.append("\n" + mark)
            at = _ITEM_PARAGRAPH.match(html, at).end()
        elif re.fullmatch("h[1-6]", name) and not close:
            out.append("\n" + "#" * int(name[1]) + " ")
        elif name == "p":
            out.append("\n\n")
        elif name in BLOCK_TAGS:
            out.append("\n")
        elif name in ("td", "th"):
            out.append(" ")
    out.append(html[at:])
    flat = "".join(out)
    flat = ENTITY.sub(entity, flat)
    flat = re.sub(r"[^\S\n]+", " ", flat.replace("\r\n", "\n").replace("\r", "\n"))
    flat = re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", flat)).strip()
    return re.sub(r"(?<=[A-Za-z])--(?=[A-Za-z])", "—", flat)


@F.pandas_udf(T.StringType())
def to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)


_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "æ": "ae", "œ": "oe"})
_TEX_ACCENT = re.compile(r"\\(?:['`^\"~=.]|[uvHtcdbkr](?=[{ ]))\s*\{?\s*\\?([A-Za-z])\}?")
_TEX_LETTER = re.compile(r"\\(ss|ae|oe|aa|o|l|i|j)(?![A-Za-z])", re.I)


def fold(text: str) -> str:
    """Lower case without accents, in Unicode or in TeX; other TeX commands are blanks."""
    text = _TEX_LETTER.sub(r"\1", _TEX_ACCENT.sub(r"\1", text))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
    return re.sub(r"\\[a-z]+", " ", text.translate(_LETTERS).lower())


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold(x))


def title_key(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def source_id(id_: Column) -> Column:
    return F.regexp_replace(id_, "^raid:[a-z0-9.-]+:", "")


def flat_post(text: Column) -> Column:
    """A post on one line: marks go, a paragraph without a stop gets one, glued dashes are spaced."""
    text = F.regexp_replace(text, r"(?md)\*\*|^#{1,6} |^(?:[-*•+]|\d{1,2}[.)]) ", "")
    text = F.regexp_replace(text, java(r"([^\s.!?…,:;])\n\n"), "$1.\n\n")
    text = F.regexp_replace(text, java(r"\s*\n\s*"), " ")
    text = F.regexp_replace(text, r"(?<=[A-Za-z]{2})--(?=[A-Za-z]{2})", " -- ")
    text = F.regexp_replace(text, r"(?<=[A-Za-z]{2})- (?!(?:and|or|to|through)\b)(?=[A-Za-z]{2})", " - ")
    return F.when(text.rlike(r'^"[^"]*"\z'), F.substring(text, F.lit(2), F.char_length(text) - 2)).otherwise(text)
