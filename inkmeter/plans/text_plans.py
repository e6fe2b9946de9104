"""Normalised texts and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from .base import quoted, round6, table


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", N.to_text(F.col("html")).alias("text"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title element of each page with entities decoded; flat markup, so SQL can follow."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", N.squeezed(title).alias("title"))


#: Text set before and after each document, and what plain text makes of it.
BEFORE, AFTER = "  A\r\n\r\n\r\n\tb ", " caf&#233; &amp;lt; &mdash;&#x2F;&#151; &bogus; it&rsquo;s \n\n\n\n"
AFTER_PLAIN = " café &lt; —/— &bogus; it’s"


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(BEFORE), "text", F.lit(AFTER)).alias("text"))
    return docs.select("doc_id", N.plain_text(F.col("text")).alias("text"))


def join_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.join_wraps(N.squeezed(F.col("text"))).alias("text"))


def prose_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("## Head\n- **a** b\n1. c\n"), "text").alias("text"))
    return docs.select("doc_id", N.prose_length(F.col("text")).alias("prose"))


#: A word in more titles than this is searched by word groups, not by pairs; both ways are exact.
COMMON = 50
#: Titles with more common words than this are paired after all: their word groups are too many.
WIDE = 12


def title_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page title the page whose title shares most words, by overlap then Dice, at least a quarter."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]{3,}"), F.lit(0))))
    return best_matches(page_titles(spark, sf_dir).select("page_id", words.alias("w")))


def best_matches(titles: DataFrame, common: int = COMMON, wide: int = WIDE) -> DataFrame:
    """page_id, other, shared, overlap, dice from the distinct words (sorted) of each title (page_id, w).

    Pages with the same words match each other wholly. Of other titles each
    word set is searched once: through words of few sets by pairs, scored over
    all words; through common words by every group of them that a set holds,
    which keeps its two shortest sets, so no pair of sets is made. ``common``
    and ``wide`` change the cost only. Titles without words match nothing.
    """
    pages = titles.where(F.size("w") > 0)
    sets = pages.groupBy("w").agg(F.min("page_id").alias("id"), F.count("*").alias("pages")).withColumn("n", F.size("w"))
    by_word = sets.select("id", "n", F.explode("w").alias("word"))
    df = by_word.groupBy("word").agg(F.count("*").alias("df")).where("df > 1")
    held = by_word.join(df, "word")

    whole = pages.join(sets.where("pages > 1"), "w")
    second = whole.where("page_id <> id").groupBy("id").agg(F.min("page_id").alias("second"))
    whole = whole.join(second, "id").select("page_id", F.when(F.col("page_id") == F.col("id"), F.col("second")).otherwise(F.col("id")).alias("other"), F.col("n").alias("shared"), "n", F.col("n").alias("m"))

    alone = sets.where("pages = 1").select("id")
    often = held.where(F.col("df") > common).groupBy("id", "n").agg(F.array_sort(F.collect_list("word")).alias("c"))
    widest = often.where(F.size("c") > wide).select("id")
    rare, hot = held.where(F.col("df") <= common), held.where(F.col("df") > common)
    linked = _pairs(rare, rare).union(_pairs(hot.join(widest, "id", "left_semi"), hot)).union(_pairs(hot, hot.join(widest, "id", "left_semi")))
    linked = linked.distinct().join(alone, "id", "left_semi")
    mine, theirs = sets.select("id", "w", "n"), sets.select(F.col("id").alias("other"), F.col("w").alias("v"), F.col("n").alias("m"))
    near = linked.join(mine, "id").join(theirs, "other").select(F.col("id").alias("page_id"), "other", F.size(F.array_intersect("w", "v")).alias("shared"), "n", "m")

    taken = F.filter(F.transform("c", lambda x, i: F.when(F.getbit(F.col("mask"), i) == 1, x)), lambda x: x.isNotNull())
    groups = often.where(F.size("c") <= wide).withColumn("mask", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(c)) - 1"))))
    groups = groups.select("id", F.bit_count("mask").alias("shared"), F.concat_ws(" ", taken).alias("key"), F.struct(F.col("n").alias("m"), F.col("id").alias("other")).alias("at"))
    first = groups.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("sets")).where("sets > 1")
    met = groups.join(first, "key").withColumn("own", F.col("first.other") == F.col("id"))
    next_ = met.where("not own").groupBy("key").agg(F.min("at").alias("first"))
    got = met.where("not own").select("id", "shared", "first").union(met.where("own").select("id", "shared", "key").join(next_, "key").select("id", "shared", "first"))
    far = got.join(alone, "id", "left_semi").groupBy("id").agg(F.min(F.struct((-F.col("shared")).alias("k"), "first")).alias("b"))
    far = far.join(mine.select("id", "n"), "id").select(F.col("id").alias("page_id"), F.col("b.first.other").alias("other"), (-F.col("b.k")).alias("shared"), "n", F.col("b.first.m").alias("m"))

    scored = near.unionByName(far).where("4 * shared >= n")
    order = F.struct((-F.col("shared")).alias("k"), "m", "other", "n")
    best = whole.unionByName(scored.groupBy("page_id").agg(F.min(order).alias("b")).select("page_id", "b.other", (-F.col("b.k")).alias("shared"), "b.n", "b.m"))
    shared = F.col("shared").cast("long")
    return best.select("page_id", "other", shared.alias("shared"), round6(shared / F.col("n")).alias("overlap"), round6(2 * shared / (F.col("n") + F.col("m"))).alias("dice"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, other): different sets that hold a word of both sides."""
    return a.select("id", "word").join(b.select(F.col("id").alias("other"), "word"), "word").where("id <> other").select("id", "other")


SQUEEZE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _html_sql() -> str:
    """Pages without quotations, code, numbered lists and lines typed with >, which SQL's patterns cannot follow."""
    blocks = "|".join(N.BLOCK_TAGS)
    steps = [
        (r"(?s)<!--.*?-->", ""), (r"[\s\x0b\x{feff}\pZ]+", " "), (r"(?i)</li\s*>\s*(<li\b)", r"\1"), (r"(?i)<li\b[^>]*>\s*(?:<p\b[^>]*>)?", "\n- "),
        *((rf"(?i)<h{i}\b[^>]*>", "\n" + "#" * i + " ") for i in range(1, 7)),
        (r"(?i)<(?:strong|b)\b[^>]*>(\s*)", r"\1**"), (r"(?i)(\s*)</(?:strong|b)\s*>", r"**\1"), (r"(?i)</?p\b[^>]*>", "\n\n"), (rf"(?i)</?(?:{blocks})\b[^>]*>", "\n"), (r"(?i)</?t[dh]\b[^>]*>", " "), ("<[^>]+>", ""),
    ]
    out = "html"
    for pattern, to in steps:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
    for name in ("middot", "quot", "amp"):
        out = f"replace({out}, '&{name};', {quoted(N.NAMED[name])})"
    return f"SELECT page_id, regexp_replace({SQUEEZE.format(out)}, '([A-Za-z])--([A-Za-z])', '\\1—\\2', 'g') AS text FROM pages"


TITLES = "SELECT page_id, " + SQUEEZE.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)") + " AS title FROM pages"
MATCH_SQL = f"""WITH t AS ({TITLES}), w AS (SELECT page_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}')) AS w FROM t),
x AS (SELECT page_id, unnest(w) AS word, len(w) AS n FROM w),
p AS (SELECT a.page_id, b.page_id AS other, a.n, b.n AS m, count(*) AS shared FROM x a JOIN x b ON a.word = b.word AND a.page_id <> b.page_id GROUP BY ALL),
s AS (SELECT *, shared::DOUBLE / n AS overlap, 2 * shared::DOUBLE / (n + m) AS dice FROM p WHERE shared::DOUBLE / n >= 0.25)
SELECT page_id, other, shared, round(overlap, 6) AS overlap, round(dice, 6) AS dice FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overlap DESC, dice DESC, other) AS r FROM s) WHERE r = 1"""

#: Whether a line is an item depends on the one before it only through a state that some lines set and the others keep.
WRAPS_SQL = f"""WITH p AS (SELECT doc_id, {SQUEEZE.format('text')} AS t FROM documents), s AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM p),
l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS cur FROM s), n AS (SELECT *, lag(cur) OVER w AS prev, lead(cur) OVER w AS next FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, regexp_matches(cur, {quoted(N.ITEM)}) AS looks, cur = '' OR prev = '' OR regexp_matches(cur, {quoted(N.HEADING)}) OR regexp_matches(prev, {quoted(N.HEADING)}) AS apart,
  prev = '' OR regexp_matches(prev, '[.:!?;]$') OR coalesce(regexp_matches(next, {quoted(N.ITEM)}), false) AS leads FROM n),
g AS (SELECT *, last_value(CASE WHEN i = 1 THEN looks::INT WHEN looks AND leads THEN 1 WHEN NOT looks AND apart THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS state FROM f),
h AS (SELECT *, apart OR (looks AND (leads OR lag(state) OVER (PARTITION BY doc_id ORDER BY i) = 1)) AS breaks FROM g)
SELECT doc_id, text FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN i = 1 THEN '' WHEN breaks THEN chr(10) ELSE ' ' END || cur, '' ORDER BY i) AS text FROM h GROUP BY doc_id) USING (doc_id)"""

QUERIES = {
    "html_to_text": html_to_text, "page_titles": page_titles, "plain_text": plain_text, "join_wraps": join_wraps, "prose_length": prose_length, "title_key_match": title_key_match,
}
SQL = {
    "html_to_text": _html_sql(),
    "join_wraps": WRAPS_SQL,
    "page_titles": TITLES,
    "plain_text": "SELECT doc_id, " + SQUEEZE.format("('  A' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(9) || 'b ' || text || " + quoted(AFTER_PLAIN) + ")") + " AS text FROM documents",
    "prose_length": r"SELECT doc_id, length(trim(regexp_replace(regexp_replace('## Head' || chr(10) || '- **a** b' || chr(10) || '1. c' || chr(10) || text, '(?m)\*\*|^#{1,6} |^(?:[-*•+]|\d{1,2}[.)]) ', '', 'g'), '\s+', ' ', 'g')))::BIGINT AS prose FROM documents",
    "title_key_match": MATCH_SQL,
}
