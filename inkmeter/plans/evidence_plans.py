"""Matching, guards, panels, work lists and per-assignment counts over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import placeholders as P
from ..functions.dialect import java
from ..functions.tokens import n_runs, n_words
from ..operators import draws, evidence, matching, memory, worklist
from ..operators.records import allocate
from ..session import cut
from .base import TEXTS_SQL, WORDS_SQL, order_key, quoted, round6, table, texts
from .marker_plans import FLAG_SQL, SIMPLE, WHOLE, count_sql, counted, flagged
from .measure_plans import ARMS_SQL, arms
from .pair_plans import GRAM_SQL, GRAMS_SQL, upper_median


# ---- titles ----
def _papers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their first words as titles, the same as entries with some renamed, and each document's own entry and the next two."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"), "text")
    renamed = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("On "), "title")).when(F.col("doc") % 3 == 1, F.concat("title", F.lit(" and all that it is about"))).otherwise(F.col("title"))
    short = F.when(F.col("doc") % 5 == 0, F.substring("text", 1, 400)).otherwise(F.col("text"))
    entries = docs.select(F.col("doc").alias("entry"), renamed.alias("title"), short.alias("summary"))
    pairs = docs.select("doc", F.explode(F.sequence(F.col("doc"), F.col("doc") + 2)).alias("entry"))
    return docs, entries, pairs


def pick_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = matching.pick_match(matching.scored(*_papers(spark, sf_dir)))
    return got.select("doc", "entry", "how", round6(F.col("overlap")).alias("overlap"))


def _words_sql(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(replace(replace(replace({x}, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))), '[a-z0-9]+')"


PICK_SQL = f"""WITH d AS (SELECT doc_id AS doc, array_to_string(string_split(text, ' ')[1:6], ' ') AS title, text FROM documents),
e AS (SELECT doc AS entry, CASE doc % 3 WHEN 0 THEN 'On ' || title WHEN 1 THEN title || ' and all that it is about' ELSE title END AS title, CASE WHEN doc % 5 = 0 THEN left(text, 400) ELSE text END AS summary FROM d),
w AS (SELECT d.doc, e.entry, {_words_sql('d.title')} AS t, {_words_sql('e.title')} AS u, {_words_sql('d.text')} AS x, {_words_sql('e.summary')} AS y FROM d JOIN e ON e.entry BETWEEN d.doc AND d.doc + 2),
g AS (SELECT *, list_distinct([x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] FOR i IN range(1, len(x) - 1)]) AS a, list_distinct([y[i] || ' ' || y[i + 1] || ' ' || y[i + 2] FOR i IN range(1, len(y) - 1)]) AS b FROM w),
s AS (SELECT doc, entry, array_to_string(t, ' ') = array_to_string(u, ' ') AS same, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS ov,
  CASE WHEN len(t) = 0 OR len(u) = 0 THEN 0.0::DOUBLE ELSE 2 * len(list_intersect(list_distinct(t), list_distinct(u)))::DOUBLE / (len(list_distinct(t)) + len(list_distinct(u))) END AS dice FROM g),
f AS (SELECT *, CASE WHEN same THEN 'title' WHEN (ov >= 0.5 OR (ov >= 0.25 AND dice >= 0.6)) AND dice >= 0.6 THEN 'title+abstract' WHEN ov >= 0.5 THEN 'abstract' END AS how FROM s)
SELECT doc, entry, how, round(ov, 6) AS overlap FROM f WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY same DESC, ov DESC, entry) = 1"""


# ---- guards and panels ----
def whole_text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold eight words which exactly one benchmark text holds and no conversation does."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    people = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return evidence.one_persons_words(docs, people, table(spark, sf_dir, "conversations").select("text"))


WHOLE_GUARD_SQL = f"""WITH {GRAMS_SQL}, cw AS (SELECT regexp_extract_all(translate(lower(text), '’‘', ''''''), '[a-z0-9'']+') AS w FROM conversations),
d8 AS (SELECT id, unnest({GRAM_SQL.format(n=8)}) AS gram FROM dw), b8 AS (SELECT item_id, unnest({GRAM_SQL.format(n=8)}) AS gram FROM bw), c8 AS (SELECT DISTINCT unnest({GRAM_SQL.format(n=8)}) AS gram FROM cw),
one AS (SELECT gram FROM b8 GROUP BY gram HAVING count(*) = 1)
SELECT DISTINCT id FROM d8 WHERE gram IN (SELECT gram FROM one) AND gram NOT IN (SELECT gram FROM c8)"""

TOUCHED = " He was arrested for it."


def document_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six documents in hash order that labels and documents both name, every ninth being on a subject that is not shown, benchmark passages guarded."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(TOUCHED))).otherwise(F.col("text"))
    one = docs.select(F.lit("gpt").alias("arm"), F.col("doc_id").alias("doc"), text.alias("text"))
    two = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.lit("llama").alias("arm"), F.col("doc_id").alias("doc"), "text")
    guarded = whole_text_guard(spark, sf_dir).select(F.col("id").alias("doc"))
    return evidence.panel(one.unionByName(two), ["gpt", "llama"], guarded, order_key("panel", F.col("doc")))


def _sensitive_sql(text: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + evidence.SENSITIVE)})"


PANEL_SQL = f"""WITH guard AS ({WHOLE_GUARD_SQL}), d AS (SELECT doc_id AS doc, CASE WHEN doc_id % 9 = 0 THEN text || {quoted(TOUCHED)} ELSE text END AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
k AS (SELECT doc FROM d WHERE NOT coalesce({_sensitive_sql('text')}, false) AND doc NOT IN (SELECT id FROM guard))
SELECT doc, row_number() OVER (ORDER BY md5('panel/' || doc), doc)::INTEGER AS rank FROM k QUALIFY rank <= 6"""


def level_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source one text of each of three writers, held level by language (as grade) and length."""
    grade = F.element_at(F.create_map(*(x for i, v in enumerate(("en", "de", "fr", "es")) for x in (F.lit(v), F.lit(i)))), F.col("lang"))
    rows = texts(spark, sf_dir).select("arm", F.col("doc_id").alias("id"), "grp", grade.alias("grade"), "bin")
    return evidence.level_draw(rows, "machine", ["person", "casual"], order_key("level", F.col("grp"), F.col("arm"), F.col("id")))


LEVEL_SQL = f"""WITH {TEXTS_SQL}, r AS (SELECT arm, doc_id AS id, grp, md5('level/' || grp || '/' || arm || '/' || doc_id) AS k, CASE lang WHEN 'en' THEN 'g0' WHEN 'de' THEN 'g1' WHEN 'fr' THEN 'g2' WHEN 'es' THEN 'g3' ELSE 'g?' END AS g, bin FROM f),
e AS (SELECT arm, id, grp, k, 0 AS level, g || '/b' || bin AS key FROM r WHERE bin >= 0 UNION ALL SELECT arm, id, grp, k, 1, g FROM r UNION ALL SELECT arm, id, grp, k, 2, '' FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY grp, arm, level, key ORDER BY k, id) AS rn FROM e), a AS (SELECT * FROM s WHERE rn = 1),
w AS (SELECT grp, level, key, min(k) FILTER (arm = 'machine') AS lk, min(id) FILTER (arm = 'machine') AS li FROM a GROUP BY ALL HAVING count(*) = 3),
b AS (SELECT grp, level, key FROM w QUALIFY row_number() OVER (PARTITION BY grp ORDER BY level, lk, li) = 1)
SELECT grp, ['grade and length', 'grade', 'assignment only'][level + 1] AS matched, arm, id FROM a JOIN b USING (grp, level, key)"""


def person_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per assignment (source) and marker: the person's texts, those with it, words, and occurrences where they can be counted."""
    rows = texts(spark, sf_dir).where("arm = 'person'")
    words = counted(rows, SIMPLE, ["grp", "n_words"]).select("grp", "marker", "n_words", (F.col("n") > 0).alias("hit"), "n")
    whole = flagged(rows, WHOLE, ["grp", "n_words"]).select("grp", "marker", "n_words", "hit", F.lit(None).cast("long").alias("n"))
    got = words.unionByName(whole).groupBy("grp", "marker")
    return got.agg(F.count("*").alias("texts"), F.count_if("hit").alias("with_marker"), F.sum("n_words").alias("words"), F.sum("n").alias("occurrences"))


PERSON_SQL = f"""WITH {TEXTS_SQL}, p AS (SELECT * FROM f WHERE arm = 'person'), c AS ({' UNION ALL '.join([f"SELECT grp, {quoted(x)} AS marker, n_words, ({count_sql(x)})::BIGINT AS n, ({count_sql(x)}) > 0 AS hit FROM p" for x in SIMPLE] + [f"SELECT grp, {quoted(x)}, n_words, NULL, {FLAG_SQL[x]} FROM p" for x in WHOLE])})
SELECT grp, marker, count(*) AS texts, count(*) FILTER (hit) AS with_marker, sum(n_words)::BIGINT AS words, sum(n)::BIGINT AS occurrences FROM c GROUP BY ALL"""


# ---- assignments ----
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents of up to 800 words, the commonest language, their lengths in words, and how many were longer."""
    n = F.coalesce(n_runs(F.col("text")), F.lit(0))
    counts = cut(table(spark, sf_dir, "documents").select("source", "lang", n.alias("n")).groupBy("source", "lang", "n").agg(F.count("*").alias("c")))  # all below reads these; the texts are read once
    kept = counts.where("n <= 800")
    median = upper_median(kept, "source", "n", F.col("c"))
    commonest = kept.groupBy("source", "lang").agg(F.sum("c").alias("c")).groupBy("source").agg(F.min_by("lang", F.struct(-F.col("c"), "lang")).alias("modal"))
    sizes = kept.groupBy("source").agg(F.sum("c").alias("texts"), F.min("n").alias("least"), F.max("n").alias("most"))
    over = counts.groupBy("source").agg(F.sum("c").alias("base"), F.sum(F.when(F.col("n") > 800, F.col("c")).otherwise(0)).alias("dropped"))
    share = F.round(100 * F.col("dropped") / F.col("base"), 2)
    return over.join(sizes, "source").join(commonest, "source").join(median, "source").select("source", "texts", "modal", "median", "least", "most", "base", "dropped", share.alias("share"))


PROMPT_SQL = r"""WITH d AS (SELECT source, lang, coalesce(len(regexp_extract_all(text, '\S+')), 0)::INTEGER AS n FROM documents), k AS (SELECT * FROM d WHERE n <= 800),
c AS (SELECT source, lang, count(*) AS c FROM k GROUP BY ALL), m AS (SELECT source, lang AS modal FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, lang) = 1)
SELECT source, texts, modal, median, least, most, base, dropped, round(100.0::DOUBLE * dropped / base, 2) AS share FROM (SELECT source, count(*) AS base, count(*) FILTER (n > 800) AS dropped FROM d GROUP BY source)
JOIN (SELECT source, count(*) AS texts, min(n) AS least, max(n) AS most, list_sort(list(n))[count(*) // 2 + 1] AS median FROM k GROUP BY source) USING (source) JOIN m USING (source)"""


def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of two writers over cells of source and language."""
    cells = allocate(table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), 200, 5, ["source", "lang"])
    cells = cells.select(F.col("source").alias("slug"), F.length("lang").alias("grade"), F.col("lang"), "slots").groupBy("slug", "grade").agg(F.sum("slots").alias("slots"))
    return worklist.slots(cells, ["gpt", "llama"], order_key("slots", F.col("slug"), F.col("grade"), F.col("n")))


WORK_SQL = """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 5), e AS (SELECT *, n::DOUBLE * 200 / sum(n) OVER () AS x FROM c),
f AS (SELECT *, floor(x) AS fl, round(x - floor(x), 9) AS part FROM e), r AS (SELECT *, row_number() OVER (ORDER BY part DESC, n DESC, source, lang) AS rk, 200 - sum(fl) OVER () AS lft FROM f),
a AS (SELECT source AS slug, len(lang) AS grade, sum(fl + (rk <= lft)::INTEGER)::INTEGER AS slots FROM r GROUP BY ALL), s AS (SELECT slug, grade, unnest(range(1, slots + 1)) AS n FROM a),
i AS (SELECT *, row_number() OVER (ORDER BY md5('slots/' || slug || '/' || grade || '/' || n), slug, grade, n) - 1 AS index FROM s)
SELECT arm || '.' || slug || '.g' || grade || '.' || lpad(n::VARCHAR, 3, '0') AS id, arm, slug, grade::INTEGER AS grade, n::INTEGER AS n, index::INTEGER AS index FROM i, (VALUES ('gpt'), ('llama')) AS w(arm)"""


def placeholder_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, removed, corpus, eligible: anonymisation tokens of the documents, to which some are added, and the same among those of 80 to 800 words."""
    added = F.when(F.col("doc_id") % 4 == 0, " Dear STUDENT_NAME, see Generic_School").when(F.col("doc_id") % 4 == 1, " a TEACHER_NAMEif of COMMUNITY_SERVICE").otherwise("")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("text", F.lit("")), added).alias("text"))
    docs = docs.withColumn("fit", n_runs(F.col("text")).between(80, 800))
    each = docs.where(F.contains("text", F.lit("_"))).select("fit", F.explode(P.scanned_tokens(F.col("text"))).alias("t"))
    return each.groupBy("t.token", "t.removed").agg(F.count("*").alias("corpus"), F.count_if("fit").alias("eligible"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten conversations of each role by the older generator."""
    rows = table(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("turns"))
    return draws.sampled(rows, "role", "conv_id", 10).select("role", "conv_id", "rank")


# ---- one text analysed ----
def analyse_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, words, whole, unjudged: the markers of the whole text that hold, and those that cannot judge it."""
    rows = texts(spark, sf_dir).withColumn("_cv", M.evenness(F.col("text")))
    told = [(m, *M.hit_and_judged(m, F.col("text"), F.col("_cv"))) for m in M.MARKERS if not m.count]
    held = F.concat_ws(",", *(F.when(hit, F.lit(m.id)) for m, hit, _ in told))
    cannot = F.concat_ws(",", *(F.when(~ok, F.lit(m.id)) for m, _, ok in told if m.eligible))
    return rows.select("doc_id", F.col("n_words").alias("words"), held.alias("whole"), cannot.alias("unjudged"))


def analyse_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, marker, start, end of every match in the readable text that no earlier match covers, as they are shown."""
    rows = texts(spark, sf_dir).select("doc_id", M.readable(F.col("text")).alias("rt")).withColumn("low", F.lower("rt"))
    return rows.select("doc_id", F.explode(shown_spans(F.col("rt"), F.col("low"), SIMPLE)).alias("x")).select("doc_id", "x.marker", "x.start", "x.end")


def shown_spans(readable, lower, names: list[str]):
    """array<struct<start, end, marker>>: matches by start, the longer of two first, without those that begin inside one before."""

    def found(name: str):
        pattern = M.BY_ID[name].pattern
        gaps, got = F.split(readable, pattern, -1), F.regexp_extract_all(readable, F.lit(pattern), F.lit(0))

        def step(acc, x):
            start = acc["at"] + F.char_length(x["gap"])
            end = start + F.char_length(x["m"])
            return F.struct(F.coalesce(end, start).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(start.alias("start"), (-end).alias("end"), F.lit(name).alias("marker"))))).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(KIND).alias("out"))
        return F.when(M.BY_ID[name].may(readable, lower), F.aggregate(F.arrays_zip(gaps.alias("gap"), got.alias("m")), zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(KIND))

    every = F.array_sort(F.concat(*map(found, names)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(KIND).alias("out"))
    take = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct((-x["end"]).alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))
    return F.transform(F.aggregate(every, zero, take, lambda acc: acc["out"]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["marker"].alias("marker")))


KIND = "array<struct<start:int,end:int,marker:string>>"


def _spans_sql() -> str:
    rows = []
    for x in SIMPLE:
        p = quoted("(?i)" + {**M.WORDS, **M.PHRASES}[x])
        rows.append(f"SELECT doc_id, {quoted(x)} AS marker, string_split_regex(rt, {p}) AS g, regexp_extract_all(rt, {p}) AS m FROM f WHERE regexp_matches(rt, {p})")
    return f"""WITH {TEXTS_SQL}, h AS ({' UNION ALL '.join(rows)}), j AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM h),
s AS (SELECT doc_id, marker, (list_sum(list_transform(g[1:j], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: len(x))), 0))::INTEGER AS start, len(m[j]) AS n FROM j)
SELECT doc_id, marker, start, (start + n)::INTEGER AS "end" FROM s"""


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per arm its texts, words and uses of "we" per 1,000 words."""
    we = F.regexp_count(F.lower("text"), F.lit(java(r"\bwe\b"))).cast("long")
    got = texts(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("texts"), F.sum("n_words").alias("words"), F.sum(we).alias("we"))
    return got.select("arm", "texts", "words", round6(F.coalesce(1000 * F.col("we") / F.nullif("words", F.lit(0)), F.lit(0.0))).alias("we_per1000"))


ARM_SUMMARY_SQL = rf"""WITH {TEXTS_SQL} SELECT arm, count(*) AS texts, sum(n_words)::BIGINT AS words, round(coalesce(1000.0::DOUBLE * sum(len(regexp_extract_all(lower(text), '\bwe\b'))) / nullif(sum(n_words), 0), 0.0), 6) AS we_per1000 FROM f GROUP BY arm"""


# ---- what persons' texts already hold ----
def _report(rows: DataFrame, by: str) -> DataFrame:
    return rows.select(by, "texts", round6(F.col("mean")).alias("mean"), round6(F.col("most")).alias("most"), "above", "worst")


def memorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, how much of its documents the benchmark's texts hold, and the three that share most."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("arm"), F.col("doc_id").alias("id"), "text")
    return _report(memory.memorisation(docs, table(spark, sf_dir, "benchmark").select("text")), "arm")


MEMORY_SQL = f"""WITH {GRAMS_SQL}, g AS (SELECT id, count(*) AS grams, count(bg.gram) AS shared FROM dg LEFT JOIN bg USING (gram) GROUP BY id),
c AS (SELECT d.source AS arm, d.doc_id AS id, coalesce(shared::DOUBLE / grams, 0.0) AS c FROM documents d LEFT JOIN g ON d.doc_id = g.id), r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY c DESC, id) AS r FROM c)
SELECT arm, count(*) AS texts, round(avg(c), 6) AS mean, round(max(c), 6) AS most, count(*) FILTER (c > 0.2) AS above, string_agg(id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS worst FROM r GROUP BY arm"""


def person_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's own texts, up to 200 and at most half, against the grams of the others."""
    people = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    got = memory.baseline(people, order_key("held", F.col("id")))
    return got.select("texts", round6(F.col("mean")).alias("mean"), round6(F.col("most")).alias("most"), "above")


BASELINE_SQL = f"""WITH bw AS (SELECT item_id, regexp_extract_all(translate(lower(text), '’‘', ''''''), '[a-z0-9'']+') AS w, row_number() OVER (ORDER BY md5('held/' || item_id), item_id) AS r, count(*) OVER () AS n FROM benchmark),
g AS (SELECT item_id, r <= least(200, n // 2) AS held, unnest({GRAM_SQL.format(n=5)}) AS gram FROM bw), pool AS (SELECT DISTINCT gram FROM g WHERE NOT held),
c AS (SELECT item_id, count(*) FILTER (gram IN (SELECT gram FROM pool))::DOUBLE / count(*) AS c FROM g WHERE held GROUP BY item_id), h AS (SELECT item_id, coalesce(c, 0.0) AS c FROM bw LEFT JOIN c USING (item_id) WHERE r <= least(200, n // 2))
SELECT count(*) AS texts, round(avg(c), 6) AS mean, round(max(c), 6) AS most, count(*) FILTER (c > 0.2) AS above FROM h"""


def shared_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the words and phrases on the documents that every writer has."""
    rows = arms(spark, sf_dir).where("arm <> 'casual'")
    writers = rows.select("arm").distinct().count()
    have = rows.groupBy("doc").agg(F.countDistinct("arm").alias("n")).where(F.col("n") == writers).select("doc")
    rows = rows.join(have, "doc", "left_semi").withColumn("n_words", n_words(F.col("text")))
    got = counted(rows, SIMPLE, ["arm", "n_words"]).groupBy("arm", "marker").agg(F.count("*").alias("texts"), F.sum("n").alias("occurrences"), F.sum("n_words").alias("words"))
    return got.withColumn("per1000", round6(1000 * F.col("occurrences") / F.col("words")))


SHARED_SQL = f"""WITH t AS ({ARMS_SQL}), f AS (SELECT *, {WORDS_SQL} AS n_words, replace(text, '**', '') AS rt FROM t WHERE doc IN (SELECT doc FROM t GROUP BY doc HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM t))),
c AS ({' UNION ALL '.join(f"SELECT arm, n_words, {quoted(x)} AS marker, ({count_sql(x)})::BIGINT AS n FROM f" for x in SIMPLE)})
SELECT arm, marker, count(*) AS texts, sum(n)::BIGINT AS occurrences, sum(n_words)::BIGINT AS words, round(1000.0::DOUBLE * sum(n) / sum(n_words), 6) AS per1000 FROM c GROUP BY ALL"""

QUERIES = {
    "pick_match": pick_match, "whole_text_guard": whole_text_guard, "document_panel": document_panel, "level_draw": level_draw, "person_counts": person_counts, "prompt_rows": prompt_rows, "work_list": work_list,
    "placeholder_tokens": placeholder_tokens, "seeded_sample": seeded_sample, "analyse_whole": analyse_whole, "analyse_spans": analyse_spans,
    "memorisation": memorisation, "person_baseline": person_baseline, "shared_rates": shared_rates, "arm_summary": arm_summary,
}
SQL = {"pick_match": PICK_SQL, "whole_text_guard": WHOLE_GUARD_SQL, "document_panel": PANEL_SQL, "level_draw": LEVEL_SQL, "person_counts": PERSON_SQL, "prompt_rows": PROMPT_SQL, "work_list": WORK_SQL, "analyse_spans": _spans_sql(), "memorisation": MEMORY_SQL, "person_baseline": BASELINE_SQL, "shared_rates": SHARED_SQL, "arm_summary": ARM_SUMMARY_SQL}
