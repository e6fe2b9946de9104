"""The texts that the queries measure: documents as three arms, with marker sentences added.

The prose of ``documents`` is made of invented syllables, so the markers would
never fire on it; a sentence is appended to every k-th document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import length_bin, length_stratum, n_words
from ..session import spread

#: (k, r, sentence): appended where doc_id % k = r.
SEEDS = [
    (7, 0, " Moreover, we delve into it and delve again."),
    (5, 1, " Furthermore, this realm is crucial."),
    (11, 2, " It is important to note that in today's world we dive into it."),
    (13, 3, " In conclusion, they showcase and underscore a rich tapestry."),
    (6, 4, " We leverage data, and they have leverage. Leveraged trades fell."),
    (9, 5, " It is not only fast but also cheap."),
    (8, 6, " It's not a bug, it's a feature."),
    (10, 7, " The plan - a good one - works — well."),
    (4, 3, " I don't think my wife said so last year."),
    (12, 1, " gonna try"),
    (15, 2, "\n## Two Words\n"),
    (16, 5, "\n- **bold** item\n"),
    (14, 9, " To sum up, it works. To sum up over all is work."),
    (17, 4, " We bought apples, pears and plums."),
]


def seeded(text: Column, doc_id: Column) -> Column:
    return F.concat(text, *(F.when(doc_id % k == r, s).otherwise("") for k, r, s in SEEDS))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SEEDED_SQL = "text || " + " || ".join(f"CASE WHEN doc_id % {k} = {r} THEN {quoted(s)} ELSE '' END" for k, r, s in SEEDS)
ARM_SQL = "CASE doc_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'machine' ELSE 'casual' END"
WORDS_SQL = "len(regexp_extract_all(lower(text), '[a-z''’]+'))::BIGINT"
BIN_SQL = "CASE WHEN n_words BETWEEN 80 AND 129 THEN 0 WHEN n_words BETWEEN 130 AND 219 THEN 1 WHEN n_words BETWEEN 220 AND 399 THEN 2 WHEN n_words BETWEEN 400 AND 800 THEN 3 ELSE -1 END"
#: CTEs: texts(doc_id, grp, lang, arm, text), f(+ n_words, bin, rt)
TEXTS_SQL = f"""texts AS (SELECT doc_id, source AS grp, lang, {ARM_SQL} AS arm, {SEEDED_SQL} AS text FROM documents),
f0 AS (SELECT *, {WORDS_SQL} AS n_words, replace(text, '**', '') AS rt FROM texts),
f AS (SELECT *, {BIN_SQL} AS bin FROM f0)"""


#: Tables whose rows hold texts: their few splits are spread over the cores.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, grp, lang, arm, text, n_words, bin, stratum of every document."""
    docs = table(spark, sf_dir, "documents")
    arm = F.when(F.col("doc_id") % 3 == 0, "person").when(F.col("doc_id") % 3 == 1, "machine").otherwise("casual")
    rows = docs.select("doc_id", F.col("source").alias("grp"), "lang", arm.alias("arm"), seeded(F.col("text"), F.col("doc_id")).alias("text"))
    rows = rows.withColumn("n_words", n_words(F.col("text")))
    return rows.withColumn("bin", length_bin(F.col("n_words"))).withColumn("stratum", length_stratum(F.col("n_words")))


def order_key(seed: str, *cols: Column) -> Column:
    """A pseudo-random order that SQL engines share: md5 of seed and key."""
    return F.md5(F.concat_ws("/", F.lit(seed), *(c.cast("string") for c in cols)))


def round6(c: Column) -> Column:
    return F.round(c, 6)
