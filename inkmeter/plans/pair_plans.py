"""Lengths, bins, pairings, placebo halves, overlap and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import markers as M
from ..functions.tokens import gram_words, length_bin, n_words
from ..functions.sentences import sentences_around
from ..operators import overlap, pairing
from ..session import cut
from .base import TEXTS_SQL, order_key, quoted, round6, table, texts
from .clean_plans import REMEMBERED_ABOVE
from .marker_plans import SIMPLE

N = 5


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, words and gram words per arm."""
    rows = texts(spark, sf_dir).select("arm", "n_words", F.size(gram_words(F.col("text"))).cast("long").alias("g"))
    return rows.groupBy("arm").agg(F.count("*").alias("texts"), F.sum("n_words").alias("words"), F.sum("g").alias("gram_words"))


def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).groupBy("arm", "bin").agg(F.count("*").alias("texts"))


def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).where("n_words > 0").groupBy("arm", "stratum").agg(F.count("*").alias("texts"), F.sum("n_words").alias("words"))


def upper_median(rows: DataFrame, by: str, value: str, times: Column | None = None) -> DataFrame:
    """The upper middle of whole numbers per group, from counts per value (no group is collected). ``times`` is how often a row counts."""
    counts = rows.groupBy(by, value).agg((F.count("*") if times is None else F.sum(times)).alias("c"))
    upto = W.partitionBy(by).orderBy(value)
    total = F.sum("c").over(W.partitionBy(by))
    at = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("total", total)
    return at.where("upto > floor(total / 2) and upto - c <= floor(total / 2)").select(by, F.col(value).alias("median"))


def median_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_median(texts(spark, sf_dir), "arm", "n_words")


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A person's documents and a machine's edit of each that is not French, twice for every tenth."""
    docs = table(spark, sf_dir, "documents")
    a = docs.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), length_bin(n_words(F.col("text"))).alias("bin"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" "), "text")).otherwise(F.concat("text", F.lit(" moreover")))
    b = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("doc"), F.explode(F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"), text.alias("text"))
    b = b.select("doc", (F.col("doc") * 10 + F.col("k")).alias("id"), (F.col("doc") * 10 + F.col("k")).alias("pos"), length_bin(n_words(F.col("text"))).alias("bin"))
    return a, b


BIN = "CASE WHEN {0} BETWEEN 80 AND 129 THEN 0 WHEN {0} BETWEEN 130 AND 219 THEN 1 WHEN {0} BETWEEN 220 AND 399 THEN 2 WHEN {0} BETWEEN 400 AND 800 THEN 3 ELSE -1 END"
_W = "len(regexp_extract_all(lower(text), '[a-z''’]+'))"
SHIFTED_SQL = f"""a AS (SELECT doc_id AS doc, doc_id AS id, {BIN.format(_W)} AS bin FROM documents),
b0 AS (SELECT doc_id AS doc, unnest(CASE WHEN doc_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS k, CASE WHEN doc_id % 4 = 0 THEN text || ' ' || text ELSE text || ' moreover' END AS text FROM documents WHERE lang <> 'fr'),
b AS (SELECT doc, doc * 10 + k AS id, {BIN.format(_W)} AS bin FROM b0),
ra AS (SELECT *, row_number() OVER (PARTITION BY doc, bin ORDER BY id) AS rn FROM a WHERE bin >= 0),
rb AS (SELECT *, row_number() OVER (PARTITION BY doc, bin ORDER BY id) AS rn FROM b WHERE bin >= 0)"""


def pair_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.by_document(*_shifted(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, arm, grp, bin of the texts that a bin holds; read once, for a draw reads its rows several times."""
    return cut(texts(spark, sf_dir).where("bin >= 0").select(F.col("doc_id").alias("id"), "arm", "grp", "bin"))


def pair_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = order_key("pair", F.col("bin"), F.col("arm"), F.col("id"))
    return pairing.drawn(_rows(spark, sf_dir), ["bin"], key, ("person", "machine")).select("arm", "bin", "id")


def pair_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = order_key("group", F.col("grp"), F.col("bin"), F.col("arm"), F.col("id"))
    return pairing.drawn(_rows(spark, sf_dir), ["grp", "bin"], key, ("person", "machine")).select("arm", "grp", "bin", "id")


def _drawn_sql(cell: str, key: str) -> str:
    return f"""WITH {TEXTS_SQL}, x AS (SELECT doc_id AS id, arm, grp, bin FROM f WHERE bin >= 0 AND arm <> 'casual'),
r AS (SELECT *, row_number() OVER (PARTITION BY arm, {cell} ORDER BY md5({key}), id) AS rn, count(*) FILTER (arm = 'person') OVER (PARTITION BY {cell}) AS n0, count(*) FILTER (arm = 'machine') OVER (PARTITION BY {cell}) AS n1 FROM x)"""


def placebo_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    quota = rows.where("arm = 'machine'").groupBy("bin").agg(F.count("*").alias("quota"))
    got = pairing.halves(rows.where("arm = 'person'"), ["bin"], order_key("placebo", F.col("bin"), F.col("id")), quota)
    return got.select("bin", "half", "id")


PLACEBO_SQL = f"""WITH {TEXTS_SQL}, q AS (SELECT bin, count(*) AS quota FROM f WHERE bin >= 0 AND arm = 'machine' GROUP BY bin),
p AS (SELECT doc_id AS id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('placebo/' || bin || '/' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM f WHERE bin >= 0 AND arm = 'person')
SELECT bin, (rn > least(quota, n // 2))::INTEGER AS half, id FROM p JOIN q USING (bin) WHERE rn <= 2 * least(quota, n // 2)"""


def pairing_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each writer is paired: by document if more than half its texts share one with the person, else by length."""
    convs = table(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("turns"))
    ref = convs.where("role = 'user'").select("conv_id").distinct().withColumn("shared", F.lit(1))
    got = convs.join(ref, "conv_id", "left").groupBy("role").agg(F.count("*").alias("texts"), F.count("shared").alias("shared"))
    return got.withColumn("pairing", F.when(F.col("role") == "user", "self").when(2 * F.col("shared") > F.col("texts"), "document").otherwise("length"))


PAIRING_SQL = """WITH c AS (SELECT role, conv_id FROM conversations GROUP BY ALL), r AS (SELECT DISTINCT conv_id FROM c WHERE role = 'user')
SELECT role, count(*) AS texts, count(r.conv_id) AS shared, CASE WHEN role = 'user' THEN 'self' WHEN 2 * count(r.conv_id) > count(*) THEN 'document' ELSE 'length' END AS pairing FROM c LEFT JOIN r USING (conv_id) GROUP BY role"""


def tested_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person's documents that the machine also has."""
    a, b = _shifted(spark, sf_dir)
    return a.join(b.select("doc").distinct(), "doc", "left_semi").select("doc", "bin")


def shared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that every role takes part in."""
    convs = table(spark, sf_dir, "conversations")
    roles = convs.select("role").distinct()
    have = convs.groupBy("conv_id").agg(F.countDistinct("role").alias("roles"))
    return have.join(F.broadcast(roles.agg(F.count("*").alias("all"))), F.col("roles") == F.col("all")).select("conv_id")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.exploded(table(spark, sf_dir, "benchmark"), N).distinct()


def containment_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's share of 5-grams that the benchmark holds, and whether it is above one half."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    got = overlap.containment(docs, _pool(spark, sf_dir), N)
    return got.select("id", "grams", "shared", round6(F.col("containment")).alias("containment"), (F.col("containment") > REMEMBERED_ABOVE).alias("remembered"))


GRAM_SQL = "list_distinct([array_to_string(w[i : i + {n} - 1], ' ') FOR i IN range(1, len(w) - {n} + 2)])"
GRAMS_SQL = f"""dw AS (SELECT doc_id AS id, doc_id, regexp_extract_all(translate(lower(text), '’‘', ''''''), '[a-z0-9'']+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(lower(text), '’‘', ''''''), '[a-z0-9'']+') AS w FROM benchmark),
dg AS (SELECT id, unnest({GRAM_SQL.format(n=N)}) AS gram FROM dw), bg AS (SELECT DISTINCT unnest({GRAM_SQL.format(n=N)}) AS gram FROM bw)"""
CONTAINMENT_SQL = f"""WITH {GRAMS_SQL}, g AS (SELECT id, count(*) AS grams, count(bg.gram) AS shared FROM dg LEFT JOIN bg USING (gram) GROUP BY id)
SELECT dw.id, coalesce(grams, 0) AS grams, coalesce(shared, 0) AS shared, round(coalesce(shared::DOUBLE / grams, 0.0), 6) AS containment, coalesce(shared::DOUBLE / grams, 0.0) > 0.5 AS remembered FROM dw LEFT JOIN g USING (id)"""


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's grams that the other documents of its source hold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    got = overlap.among(docs, N, "source")
    return got.select("id", "grams", "shared", round6(F.col("containment")).alias("containment"))


PAIRS_SQL = f"""WITH dw AS (SELECT doc_id AS id, source, regexp_extract_all(translate(lower(text), '’‘', ''''''), '[a-z0-9'']+') AS w FROM documents),
dg AS (SELECT id, source, unnest({GRAM_SQL.format(n=N)}) AS gram FROM dw), p AS (SELECT source, gram, 1 AS hit FROM dg GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT dg.id, count(*) AS grams, count(hit) AS shared FROM dg LEFT JOIN p USING (source, gram) GROUP BY dg.id)
SELECT dw.id, coalesce(grams, 0) AS grams, coalesce(shared, 0) AS shared, round(coalesce(shared::DOUBLE / grams, 0.0), 6) AS containment FROM dw LEFT JOIN g USING (id)"""


def gram_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many 8-grams only a document has, outside the benchmark."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    own = overlap.unique_grams(docs, 8).join(overlap.exploded(table(spark, sf_dir, "benchmark"), 8).select("gram").distinct(), "gram", "left_anti")
    return own.groupBy("id").agg(F.count("*").alias("unique_grams"))


UNIQUE_SQL = f"""WITH {GRAMS_SQL}, d8 AS (SELECT id, unnest({GRAM_SQL.format(n=8)}) AS gram FROM dw), b8 AS (SELECT DISTINCT unnest({GRAM_SQL.format(n=8)}) AS gram FROM bw),
u AS (SELECT gram, min(id) AS id FROM d8 GROUP BY gram HAVING count(*) = 1) SELECT id, count(*) AS unique_grams FROM u WHERE gram NOT IN (SELECT gram FROM b8) GROUP BY id"""


def text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that must not be shown for a person's words, the benchmark's texts being the persons'.

    The tables name neither a document's source text nor its title, so of the
    guard's three rules only that of 8 words can hold here.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("doc"), "text")
    people = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("doc"), "text")
    return overlap.guarded(docs, people, people.select("doc", F.col("text").alias("title")).limit(0))


GUARD_SQL = f"""WITH {GRAMS_SQL}, d8 AS (SELECT id, unnest({GRAM_SQL.format(n=8)}) AS gram FROM dw), b8 AS (SELECT DISTINCT unnest({GRAM_SQL.format(n=8)}) AS gram FROM bw)
SELECT DISTINCT id FROM d8 WHERE gram IN (SELECT gram FROM b8)"""

# ---- evidence ----
#: The markers shown: all whose pattern SQL can follow.
SHOWN = SIMPLE


def hits(rows: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, arm, marker, k, form, before: every match in its text, in one pass over the texts.

    What a pattern splits and what it extracts alternate, so the text before
    a match is the piece before it.
    """
    rows = rows.select("doc_id", "arm", M.readable(F.col("text")).alias("_rt")).withColumn("_low", F.lower("_rt"))

    def found(name: str):
        pattern = M.BY_ID[name].pattern
        pieces = F.arrays_zip(F.split("_rt", pattern, -1).alias("gap"), F.regexp_extract_all("_rt", F.lit(pattern), F.lit(0)).alias("form"))
        return F.struct(F.lit(name).alias("marker"), F.when(M.BY_ID[name].may("_rt", "_low"), pieces).alias("h"))

    each = rows.select("doc_id", "arm", F.explode(F.array(*map(found, names))).alias("m")).where("m.h is not null")
    out = each.select("doc_id", "arm", "m.marker", F.posexplode("m.h").alias("k", "h")).where("h.form is not null")
    before = F.regexp_extract(F.lower(F.right("h.gap", F.lit(40))), r"([a-z][a-z'’-]*)[^a-z]*\z", 1)
    return out.select("doc_id", "arm", "marker", "k", F.lower("h.form").alias("form"), before.alias("before"))


def top(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The n commonest values per group; ties in order of the value; empty ones do not count."""
    counts = rows.where(F.col(value) != "").groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), value))).where(F.col("rank") <= n)


def evidence_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(hits(texts(spark, sf_dir), SHOWN), ["arm", "marker"], "form", 8)


def evidence_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(hits(texts(spark, sf_dir), SHOWN), ["arm", "marker"], "before", 8)


def evidence_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each document, in hash order, at most five per arm and marker."""
    first = hits(texts(spark, sf_dir), SHOWN).where("k = 0")
    order = W.partitionBy("arm", "marker").orderBy(order_key("examples", F.col("marker"), F.col("doc_id")), "doc_id")
    return first.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("arm", "marker", "rank", "doc_id", "form")


_RX = {x: quoted("(?i)" + {**M.WORDS, **M.PHRASES}[x]) for x in SHOWN}
HITS_SQL = f"{TEXTS_SQL}, h0 AS (" + " UNION ALL ".join(f"SELECT doc_id, arm, {quoted(x)} AS marker, unnest(list_zip(string_split_regex(rt, {p}), range(1, len(regexp_extract_all(rt, {p})) + 1), regexp_extract_all(rt, {p}))) AS h FROM f" for x, p in _RX.items()) + "), h AS (SELECT doc_id, arm, marker, h[2] AS k, lower(h[3]) AS form, regexp_extract(lower(right(h[1], 40)), '([a-z][a-z''’-]*)[^a-z]*$', 1) AS before FROM h0 WHERE h[3] IS NOT NULL)"


def _top_sql(value: str) -> str:
    return f"""WITH {HITS_SQL}, c AS (SELECT arm, marker, {value}, count(*) AS n FROM h WHERE {value} <> '' GROUP BY ALL)
SELECT arm, marker, {value}, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY arm, marker ORDER BY n DESC, {value}) AS rank FROM c) WHERE rank <= 8"""


EXAMPLES_SQL = f"""WITH {HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY marker, doc_id ORDER BY k) AS r FROM h)
SELECT arm, marker, rank, doc_id, form FROM (SELECT *, row_number() OVER (PARTITION BY arm, marker ORDER BY md5('examples/' || marker || '/' || doc_id), doc_id) AS rank FROM r WHERE r = 1) WHERE rank <= 5"""


def kwic_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around every match of the shown markers, at most 240 characters with the match kept in view."""
    rows = texts(spark, sf_dir).select("doc_id", M.readable(F.col("text")).alias("rt"))
    each = F.array(*(F.struct(F.lit(x).alias("marker"), F.lit({**M.WORDS, **M.PHRASES}[x]).alias("pattern"), M.BY_ID[x].may("rt", "low").alias("may")) for x in SHOWN))
    rows = rows.withColumn("low", F.lower("rt")).select("doc_id", "rt", F.explode(each).alias("m")).where("m.may")
    found = rows.select("doc_id", "m.marker", F.posexplode(sentences_around("rt", "m.pattern")).alias("k", "sentence"))
    return found.select("doc_id", "marker", "k", "sentence")


def _kwic_sql() -> str:
    rx = {x: quoted("(?i)" + {**M.WORDS, **M.PHRASES}[x]) for x in SHOWN}
    rows = " UNION ALL ".join(f"SELECT doc_id, {quoted(x)} AS marker, rt, string_split_regex(rt, {p}) AS g, regexp_extract_all(rt, {p}) AS m FROM f WHERE regexp_matches(rt, {p})" for x, p in rx.items())
    flat = "trim(regexp_replace({0}, '[\\s\\x0b\\x85\\pZ]+', ' ', 'g'))"
    return f"""WITH {TEXTS_SQL}, h0 AS ({rows}), h1 AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM h0),
h2 AS (SELECT doc_id, marker, j - 1 AS k, rt, m[j] AS w, list_sum(list_transform(g[1:j], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: len(x))), 0) AS s FROM h1),
h3 AS (SELECT *, regexp_extract(left(rt, s::BIGINT), '[^.!?\n]*$') AS a, regexp_extract(substr(rt, (s + len(w) + 1)::BIGINT), '^[^.!?\n]*[.!?\n]?') AS b FROM h2),
h4 AS (SELECT *, a || w || b AS raw, greatest(0, (240 - len(w)) // 2) AS half FROM h3), h5 AS (SELECT *, least(len(raw), greatest(0, len(a) - half) + 240) AS hi FROM h4), h6 AS (SELECT *, greatest(0, hi - 240) AS lo FROM h5)
SELECT doc_id, marker, k::INTEGER AS k, CASE WHEN len({flat.format('raw')}) <= 240 THEN {flat.format('raw')}
  ELSE CASE WHEN lo > 0 THEN '…' ELSE '' END || {flat.format('substr(raw, lo + 1, hi - lo)')} || CASE WHEN hi < len(raw) THEN '…' ELSE '' END END AS sentence FROM h6"""


KWIC_SQL = _kwic_sql()

QUERIES = {
    "token_lengths": token_lengths, "length_bins": length_bins, "length_strata": length_strata, "upper_median": median_words,
    "pair_by_document": pair_by_document, "pair_by_length": pair_by_length, "pair_by_group": pair_by_group, "placebo_halves": placebo_halves,
    "pairing_choice": pairing_choice, "tested_reference": tested_reference, "shared_documents": shared_documents,
    "containment_pool": containment_pool, "containment_pairs": containment_pairs, "gram_uniqueness": gram_uniqueness, "text_guard": text_guard,
    "evidence_forms": evidence_forms, "evidence_before": evidence_before, "evidence_examples": evidence_examples, "kwic_sentence": kwic_sentence,
}
SQL = {
    "token_lengths": f"WITH {TEXTS_SQL} SELECT arm, count(*) AS texts, sum(n_words)::BIGINT AS words, sum(len(regexp_extract_all(translate(lower(text), '’‘', ''''''), '[a-z0-9'']+')))::BIGINT AS gram_words FROM f GROUP BY arm",
    "length_bins": f"WITH {TEXTS_SQL} SELECT arm, bin, count(*) AS texts FROM f GROUP BY ALL",
    "length_strata": f"WITH {TEXTS_SQL} SELECT arm, floor(ln(n_words) / ln(1.1))::BIGINT AS stratum, count(*) AS texts, sum(n_words)::BIGINT AS words FROM f WHERE n_words > 0 GROUP BY ALL",
    "upper_median": f"WITH {TEXTS_SQL} SELECT arm, list_sort(list(n_words))[count(*) // 2 + 1] AS median FROM f GROUP BY arm",
    "pair_by_document": f"WITH {SHIFTED_SQL} SELECT ra.doc, ra.bin, ra.id AS a_id, rb.id AS b_id FROM ra JOIN rb ON ra.doc = rb.doc AND ra.bin = rb.bin AND ra.rn = rb.rn",
    "pair_by_length": _drawn_sql("bin", "'pair/' || bin || '/' || arm || '/' || id") + " SELECT arm, bin, id FROM r WHERE rn <= least(n0, n1)",
    "pair_by_group": _drawn_sql("grp, bin", "'group/' || grp || '/' || bin || '/' || arm || '/' || id") + " SELECT arm, grp, bin, id FROM r WHERE rn <= least(n0, n1)",
    "placebo_halves": PLACEBO_SQL,
    "pairing_choice": PAIRING_SQL,
    "tested_reference": f"WITH {SHIFTED_SQL} SELECT doc, bin FROM a WHERE doc IN (SELECT doc FROM b)",
    "shared_documents": "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) = (SELECT count(DISTINCT role) FROM conversations)",
    "containment_pool": CONTAINMENT_SQL, "containment_pairs": PAIRS_SQL, "gram_uniqueness": UNIQUE_SQL, "text_guard": GUARD_SQL,
    "evidence_forms": _top_sql("form"), "evidence_before": _top_sql("before"), "evidence_examples": EXAMPLES_SQL, "kwic_sentence": KWIC_SQL,
}
