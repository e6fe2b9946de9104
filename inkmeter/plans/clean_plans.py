"""Checks on texts: language, truncation, task talk, and the accounting of what they drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import markers as M
from ..functions.tokens import approx_tokens, n_runs
from ..operators import overlap
from ..operators.records import dated_exclusions
from .base import quoted, round6, table
from .marker_plans import FLAG_SQL

META_SEEDS = [
    (20, 1, "I cannot provide a response to this request. "),
    (20, 2, "As an AI language model, I must say. "),
    (20, 3, "Sure, here's a possible post: "),
    (20, 4, "The abstract would likely describe it. "),
    (20, 5, "Title: one. "),
    (20, 6, "I hope this post meets it. "),
    (20, 7, "Dear [Your Name] it is. "),
]
#: Ends cut or finished in several ways, by doc_id % 6.
ENDINGS = ["", " and then, (", " he said 2.\n3.", " a b a b a b a b a b a b a b", ' "Then we', " #done"]


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("grp"), "text")
    head = F.lit("")
    for k, r, s in META_SEEDS:
        head = F.when(F.col("doc_id") % k == r, s).otherwise(head)
    tail = F.lit("")
    for i, s in enumerate(ENDINGS):
        tail = F.when(F.col("doc_id") % len(ENDINGS) == i, s).otherwise(tail)
    model = F.element_at(F.array(*map(F.lit, ["gpt4", "llama-chat", "claude", "llama3", "other"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select("doc_id", "lang", "grp", model.alias("model"), F.concat(head, "text", tail).alias("text"))


def _case(rows, default="''") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(s)}" for c, s in rows) + f" ELSE {default} END"


EDITED_SQL = f"""e AS (SELECT doc_id, lang, source AS grp, ['gpt4', 'llama-chat', 'claude', 'llama3', 'other'][doc_id % 5 + 1] AS model,
  {_case([(f"doc_id % {k} = {r}", s) for k, r, s in META_SEEDS])} || text || {_case([(f"doc_id % {len(ENDINGS)} = {i}", s) for i, s in enumerate(ENDINGS)])} AS text FROM documents)"""


def english_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    share = C.english_share(F.col("text"))
    return docs.select("doc_id", round6(share).alias("share"), (share >= C.ENGLISH_FROM).alias("english"))


WORD_LIST = "[" + ", ".join(map(quoted, C.FUNCTION_WORDS)) + "]"
SHARE_SQL = f"""w AS (SELECT doc_id, lang, source, text, regexp_extract_all(lower(text), '\\pL+') AS w FROM documents),
sh AS (SELECT doc_id, lang, source, text, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: list_contains({WORD_LIST}, x)))::DOUBLE / len(w) END AS share FROM w)"""


def foreign_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, and how many of their documents stay when those of foreign text go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", C.is_english(F.col("text")).alias("english"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if("english").alias("kept"))


def approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens"))


def ends_in_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir).select("doc_id", C.ends_in_loop(F.col("text")).alias("loops"))


def _loop_sql() -> str:
    tests = []
    for n in range(1, 13):
        length = n * max(3, -(-12 // n))
        for cut in range(n):
            tests.append(f"(len(w) >= {cut + length} AND w[len(w) - {cut + length} + 1 : len(w) - {cut + n}] = w[len(w) - {cut + length - n} + 1 : len(w) - {cut}])")
    return " OR ".join(tests)


LOOP_SQL = f"WITH {EDITED_SQL}, x AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN''’]+') AS w FROM e) SELECT doc_id, ({_loop_sql()}) AS loops FROM x"


def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edited text: how its ending is finished, and whether the text was cut off."""
    text = F.col("text")
    return edited(spark, sf_dir).select("doc_id", "model", C.finished_ending(text).alias("ending"), C.is_truncated(text, F.col("model")).alias("truncated"))


def meta_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir).select("doc_id", C.meta_kind(F.col("text")).alias("kind"))


def _meta_sql() -> str:
    rows = []
    for kind, where, pattern, flags in C.META:
        plain = pattern.replace(r"(?!\()", "").replace("{0,160}?", "{0,160}")
        if plain.startswith(r"\[(?!(?:deleted"):
            continue
        at = {"start": "left(t, 300)", "anywhere": "t", "unsigned": "t"}[where]
        rows.append(f"WHEN regexp_matches({at}, {quoted(('(?i)' if 'i' in flags else '') + plain)}) THEN {quoted(kind)}")
    slot = quoted(r"\[[a-z][a-z' ]{1,30}\]")
    return "CASE " + " ".join(rows) + f" WHEN regexp_matches(t, {slot}) THEN 'placeholder' END"


META_SQL = f"WITH {EDITED_SQL}, x AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM e) SELECT doc_id, {_meta_sql()} AS kind FROM x"


def cleaning(rows: DataFrame, reasons: list[tuple[str, object]], by: list[str]) -> DataFrame:
    """Per group: texts, how many each ordered reason dropped, and how many stay.

    A text is dropped by the first reason that holds, in one pass.
    """
    reason = None
    for name, test in reasons:
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    got = rows.select(*by, reason.alias("r")).groupBy(*by)
    return got.agg(F.count("*").alias("texts"), *(F.count_if(F.col("r") == n).alias(n) for n, _ in reasons), F.count_if(F.col("r").isNull()).alias("kept"))


def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ordered steps over documents and labels, with what each drops per language.

    Null texts count as empty. Copies are told by digest. Truncated, task-talk
    and remembered texts are counted by ``cleaning_by_writer``.
    """
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.sha2("text", 256))
    docs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    firsts = docs.groupBy("key").agg(F.min("doc_id").alias("first"))
    n = n_runs(F.col("text"))
    rows = docs.select("lang", "doc_id", "key", "quality", n.alias("n"), C.is_english(F.col("text")).alias("english")).join(firsts, "key")
    return cleaning(
        rows,
        [
            ("short", F.col("n") < 80), ("long", F.col("n") > 800), ("foreign", ~F.col("english")), ("copy", F.col("doc_id") != F.col("first")), ("poor", F.col("quality") == 0),
        ],
        ["lang"],
    )


CLEANING_SQL = f"""WITH {SHARE_SQL}, d AS (SELECT s.*, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS n, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM sh s),
r AS (SELECT lang, CASE WHEN n < 80 THEN 'short' WHEN n > 800 THEN 'long' WHEN share < 0.12 THEN 'foreign' WHEN doc_id <> first THEN 'copy' WHEN quality = 0 THEN 'poor' END AS r
  FROM d LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))
SELECT lang, count(*) AS texts, count(*) FILTER (r = 'short') AS short, count(*) FILTER (r = 'long') AS "long", count(*) FILTER (r = 'foreign') AS "foreign",
  count(*) FILTER (r = 'copy') AS copy, count(*) FILTER (r = 'poor') AS poor, count(*) FILTER (r IS NULL) AS kept FROM r GROUP BY lang"""


def cleaned_by_writer(rows: DataFrame, excluded: DataFrame, person: str = "person", reports: tuple[str, ...] = ("claude",)) -> DataFrame:
    """Per writer: texts and what each ordered check drops; a text counts for the first that drops it.

    ``rows`` are (writer, doc, text, model, containment); ``excluded`` names
    documents left out by date. The order is date, language, truncated, task
    talk, remembered. A document any writer has in another language goes for
    all writers. The person's texts meet the first two checks alone; of the
    writers in ``reports`` cut-off texts and task talk are kept. Remembered is
    a containment above one half; without one a text is unchecked and stays.
    """
    foreign = rows.where(~C.is_english(F.coalesce("text", F.lit("")))).select("doc").distinct().withColumn("_f", F.lit(True))
    out = rows.join(excluded.select("doc").distinct().withColumn("_e", F.lit(True)), "doc", "left").join(foreign, "doc", "left")
    model, cleans = F.col("writer") != person, ~F.col("writer").isin(person, *reports)
    reason = (
        F.when(F.col("_e").isNotNull(), "excluded_by_date")
        .when(F.col("_f").isNotNull(), "excluded_by_language")
        .when(cleans & C.is_truncated(F.coalesce("text", F.lit("")), F.col("model")), "truncated")
        .when(cleans & C.meta_kind(F.coalesce("text", F.lit(""))).isNotNull(), "meta")
        .when(model & (F.col("containment") > REMEMBERED_ABOVE), "remembered")
    )
    out = out.select("writer", reason.alias("r"), (model & F.col("containment").isNull()).alias("bare"))
    by = [F.count_if(F.col("r") == x).alias(x) for x in ("excluded_by_date", "excluded_by_language", "truncated", "meta", "remembered")]
    unchecked = F.count_if(F.col("bare") & F.col("r").isNull()).alias("unchecked")
    return out.groupBy("writer").agg(F.count("*").alias("texts"), *by, unchecked, F.count_if(F.col("r").isNull()).alias("kept"))


def cleaning_by_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks over the edited documents by model, the arm "other" being the person.

    Dates are those of the orders with the documents' numbers; texts are held
    against the grams of the benchmark.
    """
    rows = edited(spark, sf_dir)
    pool = overlap.exploded(table(spark, sf_dir, "benchmark"), 5).distinct()
    near = overlap.containment(rows.select(F.col("doc_id").alias("id"), "text"), pool, 5).where("grams > 0").select(F.col("id").alias("doc"), "containment")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    excluded = dated_exclusions(dates, rows.select(F.col("doc_id").alias("doc")), "1995-01-01", "1995-06-30").where("status = 'excluded'")
    writer = F.when(F.col("model") == "other", "person").otherwise(F.col("model"))
    rows = rows.select(writer.alias("writer"), F.col("doc_id").alias("doc"), "text", "model").join(near, "doc", "left")
    return cleaned_by_writer(rows, excluded)


#: Fixed value: a text that shares more than this of its grams is remembered.
REMEMBERED_ABOVE = 0.5
#: Typography features of a census; those in ``FLAGS`` have no occurrences to count.
TYPOGRAPHY = {
    "em_dash_char": "—", "en_dash_char": "–", "double_hyphen": "--", "spaced_hyphen": " - ", "curly_double_quotes": "[“”]", "straight_double_quotes": '"', "curly_apostrophe": "’", "straight_apostrophe": "'",
    "wont_without_an_apostrophe": r"(?iu)(?<![\p{L}\p{N}_'’])wont(?![\p{L}\p{N}_'’])", "ellipsis_char": "…", "three_dots": r"\.\.\.", "bold_marks": r"\*\*",
}
FLAGS = {"bullet_line": r"(?m)^[^\S\n]*(?:[-*•+]|\d{1,2}[.)])[^\S\n]", "heading_line": r"(?m)^[^\S\n]*#{1,6}[^\S\n]", "blank_line": r"\n[^\S\n]*\n", "line_break": r"\n"}


def typography_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature: texts, those that have it, and occurrences where there are such, in one pass over the texts."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    none = ~text.rlike("['’]")
    bare = ~M.BY_ID["no_contraction"].test(text)
    flags = {"no_apostrophe_at_all": none, "contraction": bare, "contraction_without_an_apostrophe": none & bare} | {k: text.rlike(p) for k, p in FLAGS.items()}
    each = [F.struct(F.lit(k).alias("feature"), F.regexp_count(text, F.lit(p)).cast("long").alias("n"), F.lit(True).alias("counts")) for k, p in TYPOGRAPHY.items()]
    each += [F.struct(F.lit(k).alias("feature"), c.cast("long").alias("n"), F.lit(False).alias("counts")) for k, c in flags.items()]
    got = docs.select(F.explode(F.array(*each)).alias("f")).groupBy("f.feature", "f.counts")
    got = got.agg(F.count("*").alias("texts"), F.count_if(F.col("f.n") > 0).alias("texts_with"), F.sum("f.n").alias("n"))
    return got.select("feature", "texts", "texts_with", F.when(F.col("counts"), F.col("n")).alias("occurrences"))


def _census_sql() -> str:
    def counted(k: str, p: str) -> str:
        if k.startswith("wont"):  # RE2 has no look-around
            return f"SELECT {quoted(k)} AS feature, len(list_filter(regexp_extract_all(lower(t), {quoted(LOOSE_WORD)}), lambda x: x = 'wont')) AS n, true AS c FROM d"
        return f"SELECT {quoted(k)} AS feature, len(regexp_extract_all(t, {quoted(p)})) AS n, true AS c FROM d"

    bare = f"NOT ({FLAG_SQL['no_contraction']})"
    none = "NOT regexp_matches(t, '[''’]')"
    tests = {"no_apostrophe_at_all": none, "contraction": bare, "contraction_without_an_apostrophe": f"{none} AND {bare}"} | {k: f"regexp_matches(t, {quoted(p)})" for k, p in FLAGS.items()}
    rows = [counted(k, p) for k, p in TYPOGRAPHY.items()] + [f"SELECT {quoted(k)} AS feature, ({c})::BIGINT AS n, false AS c FROM d" for k, c in tests.items()]
    return f"WITH d AS (SELECT coalesce(text, '') AS t, replace(coalesce(text, ''), '**', '') AS rt FROM documents), c AS ({' UNION ALL '.join(rows)}) SELECT feature, count(*) AS texts, count(*) FILTER (n > 0) AS texts_with, CASE WHEN c THEN sum(n)::BIGINT END AS occurrences FROM c GROUP BY feature, c"


LOOSE_WORD = r"[\pL\pN_'’]+"
TYPOGRAPHY_SQL = _census_sql()


QUERIES = {
    "english_share": english_share,
    "foreign_documents": foreign_documents,
    "approx_tokens": approx,
    "ends_in_loop": ends_in_loop,
    "truncation": truncation,
    "meta_kind": meta_kind,
    "cleaning_report": cleaning_report,
    "cleaning_by_writer": cleaning_by_writer,
    "typography_census": typography_census,
}
SQL = {
    "english_share": f"WITH {SHARE_SQL} SELECT doc_id, round(share, 6) AS share, share >= 0.12 AS english FROM sh",
    "foreign_documents": f"WITH {SHARE_SQL} SELECT source, count(*) AS n, count(*) FILTER (share >= 0.12) AS kept FROM sh GROUP BY source",
    "approx_tokens": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{1,4}|[^\\sA-Za-z]'))::BIGINT AS tokens FROM documents",
    "ends_in_loop": LOOP_SQL,
    "meta_kind": META_SQL,
    "cleaning_report": CLEANING_SQL,
    "typography_census": TYPOGRAPHY_SQL,
}
