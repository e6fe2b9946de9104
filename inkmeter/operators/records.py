"""Record keeping: allocation, upserts, diffs, dated exclusions, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One row per key, the one with the smallest ``pos``, by aggregation: a hot key is combined early."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(*key, "_r.*")


def allocate(cells: DataFrame, slots: int, least: int, names: list[str]) -> DataFrame:
    """Largest remainder: ``slots`` over cells (names, n) with n >= least, by n.

    Ties of remainders go to the larger cell, then by name. Windows run over
    the cells, which are groups and not rows of data.
    """
    cells = cells.where(F.col("n") >= least)
    every = W.partitionBy(F.lit(0))
    exact = F.col("n") * slots / F.sum("n").over(every)
    cells = cells.withColumn("_floor", F.floor(exact)).withColumn("_part", F.round(exact - F.floor(exact), 9))
    rank = F.row_number().over(every.orderBy(F.desc("_part"), F.desc("n"), *names))
    left = F.lit(slots) - F.sum("_floor").over(every)
    return cells.withColumn("slots", (F.col("_floor") + (rank <= left).cast("long")).cast("long")).drop("_floor", "_part")


def upsert(old: DataFrame, new: DataFrame, key: str, replace: bool) -> DataFrame:
    """key, both sides' value, status: existing rows stay unless ``replace``; orphans stay."""
    a, b = old.select(key, F.struct(*old.columns).alias("_a")), new.select(key, F.struct(*new.columns).alias("_b"))
    both = a.join(b, key, "full_outer")
    chosen = F.coalesce("_b", "_a") if replace else F.coalesce("_a", "_b")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "orphan").when(F.col("_a") == F.col("_b"), "same").otherwise("replaced" if replace else "conflict")
    return both.select(chosen.alias("_c"), status.alias("status")).select("_c.*", "status")


def difference(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, problem: rows that one side lacks, and fields that differ (nulls are values)."""
    x, y = a.select(key, *(F.col(f).alias(f"a_{f}") for f in fields), F.lit(1).alias("_in_a")), b.select(key, *(F.col(f).alias(f"b_{f}") for f in fields), F.lit(1).alias("_in_b"))
    both = x.join(y, key, "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields)), lambda v: v.isNotNull())
    problems = F.when(F.col("_in_b").isNull(), F.array(F.lit("missing right"))).when(F.col("_in_a").isNull(), F.array(F.lit("missing left"))).otherwise(changed)
    return both.select(key, F.explode(problems).alias("problem"))


def exclusive(rows: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, n: items that come more than once in a group."""
    return rows.groupBy(group, item).agg(F.count("*").alias("n")).where("n > 1")


def dated_exclusions(entries: DataFrame, corpus: DataFrame, since: str, until: str) -> DataFrame:
    """doc, first, status of every document: an entry's versions in the window exclude it.

    ``entries`` is (doc, date); ends are inclusive and later versions do not
    excuse. A document without an entry was not looked up.
    """
    inside = F.col("date").between(since, until)
    known = entries.groupBy("doc").agg(F.min("date").alias("first"), F.bool_or(inside).alias("inside"), F.count("date").alias("dated"))
    status = F.when(F.col("dated").isNull(), "not looked up").when(F.col("dated") == 0, "unmatched").when(F.col("inside"), "excluded").otherwise("kept")
    return corpus.select("doc").join(known, "doc", "left").select("doc", "first", status.alias("status"))
