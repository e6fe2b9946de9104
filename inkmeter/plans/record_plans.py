"""Record keeping over documents and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from .base import table


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, told by digest; null texts are one text."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.sha2("text", 256), F.lit("")).alias("key"), "doc_id", "lang", "source")
    return R.keep_first(docs, ["key"], "doc_id").select("doc_id", "lang", "source")


def exclusive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha"))
    return R.exclusive(docs, "source", "sha")


def allocate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return R.allocate(cells, 200, 5, ["source", "lang"])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders but urgent ones, and all but low ones with every fifth price changed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    a, b = orders.where("o_orderpriority <> '1-URGENT'"), orders.where("o_orderpriority <> '5-LOW'").withColumn("o_totalprice", price)
    return a.drop("o_orderpriority"), b.drop("o_orderpriority")


HALVES_SQL = """a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')"""


def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.upsert(*_halves(spark, sf_dir), "o_orderkey", True)


def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.difference(*_halves(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_totalprice"])


def dated_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents and their orders as versions."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    corpus = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"))
    return R.dated_exclusions(entries, corpus, "1995-01-01", "1995-12-31")


QUERIES = {
    "dedup_keep_first": dedup_keep_first, "exclusive_groups": exclusive_groups, "allocate_slots": allocate_slots,
    "merge_records": merge_records, "frame_diff": frame_diff, "dated_exclusions": dated_exclusions,
}
SQL = {
    "dedup_keep_first": "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "exclusive_groups": "SELECT source, sha256(text) AS sha, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
    "allocate_slots": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 5), e AS (SELECT *, n::DOUBLE * 200 / sum(n) OVER () AS x FROM c),
f AS (SELECT *, floor(x) AS fl, round(x - floor(x), 9) AS part FROM e), r AS (SELECT *, row_number() OVER (ORDER BY part DESC, n DESC, source, lang) AS rk, 200 - sum(fl) OVER () AS lft FROM f)
SELECT source, lang, n, (fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END)::BIGINT AS slots FROM r""",
    "merge_records": f"""WITH {HALVES_SQL} SELECT o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice,
  CASE WHEN a.o_totalprice IS NULL THEN 'added' WHEN b.o_totalprice IS NULL THEN 'orphan' WHEN a.o_totalprice = b.o_totalprice THEN 'same' ELSE 'replaced' END AS status FROM a FULL JOIN b USING (o_orderkey)""",
    "frame_diff": f"""WITH {HALVES_SQL} SELECT o_orderkey, CASE WHEN b.o_totalprice IS NULL THEN 'missing right' WHEN a.o_totalprice IS NULL THEN 'missing left' ELSE 'o_totalprice' END AS problem
FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
    "dated_exclusions": """WITH e AS (SELECT o_custkey AS doc, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders),
k AS (SELECT doc, min(date) AS first, bool_or(date BETWEEN '1995-01-01' AND '1995-12-31') AS inside FROM e GROUP BY doc)
SELECT c_custkey AS doc, first, CASE WHEN first IS NULL THEN 'not looked up' WHEN inside THEN 'excluded' ELSE 'kept' END AS status FROM customer LEFT JOIN k ON doc = c_custkey""",
}
