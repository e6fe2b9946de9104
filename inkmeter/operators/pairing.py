"""Pairings of texts of two arms. Order within a cell comes from a hash of seed and id.

Who is among the first of a cell is decided without sorting the cell: texts
are counted in ranges of the hash, and only the one range in which a limit
falls is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Hexadecimal digits of the order's hash that name a range; three make 4,096 ranges a cell.
DIGITS = 3


def by_document(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc, bin, a_id, b_id: the k-th text of one side with the k-th of the other, by document and bin.

    Both have doc, bin, pos and id. Candidates of a document and bin are taken
    first come first served, so ranks pair them. Bin -1 is never paired.
    """
    rank = F.row_number().over(W.partitionBy("doc", "bin").orderBy("pos", "id"))
    left, right = (x.where("bin >= 0").withColumn("rn", rank).select("doc", "bin", "rn", F.col("id").alias(n)) for x, n in ((a, "a_id"), (b, "b_id")))
    return left.join(right, ["doc", "bin", "rn"]).drop("rn")


def among_first(rows: DataFrame, cell: list[str], key: Column, limits: DataFrame, *names: str) -> DataFrame:
    """``rows`` (with id) of the cells in ``limits``, and per name whether a row is among so many first.

    ``key`` is a hash in hexadecimal; equal ones go by id. ``limits`` has one
    row a cell with the columns ``names``. Cells are never null.
    """
    rows = rows.withColumn("_key", key).withColumn("_at", F.substring("_key", 1, DIGITS))
    counts = rows.groupBy(*cell, "_at").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(W.partitionBy(*cell).orderBy("_at")))
    over = counts.join(limits, cell)
    edges = []
    for x in names:
        whole = F.col("_upto") <= F.col(x)
        edges += [F.min(F.when(~whole, F.col("_at"))).alias(f"_edge_{x}"), (F.first(x) - F.coalesce(F.max(F.when(whole, F.col("_upto"))), F.lit(0))).alias(f"_need_{x}")]
    rows = rows.join(over.groupBy(*cell).agg(*edges), cell)
    on_edge = F.lit(False)
    for x in names:
        on_edge = on_edge | F.coalesce(F.col("_at") == F.col(f"_edge_{x}"), F.lit(False))
    ranked = rows.where(on_edge).withColumn("_rank", F.row_number().over(W.partitionBy(*cell, "_at").orderBy("_key", "id")))
    rows = rows.where(~on_edge).withColumn("_rank", F.lit(0)).unionByName(ranked)
    for x in names:
        edge = F.col(f"_edge_{x}")
        rows = rows.withColumn(x, F.when(edge.isNull() | (F.col("_at") < edge), True).when(F.col("_at") > edge, False).otherwise(F.col("_rank") <= F.col(f"_need_{x}")))
    return rows.drop("_key", "_at", "_rank", *(f"_{k}_{x}" for k in ("edge", "need") for x in names))


def drawn(rows: DataFrame, cell: list[str], key: Column, sides: tuple[str, str], by: str = "arm") -> DataFrame:
    """``rows`` (arm, id, ...) cut to the same number on both sides of each cell.

    Null cells (unnamed groups) are left out.
    """
    rows = rows.where(F.col(by).isin(*sides))
    for c in cell:
        rows = rows.where(F.col(c).isNotNull())
    sizes = rows.groupBy(*cell).agg(*(F.count_if(F.col(by) == s).alias(f"_n{i}") for i, s in enumerate(sides))).where("_n0 > 0 and _n1 > 0")
    limits = sizes.select(*cell, F.explode(F.array(*map(F.lit, sides))).alias(by), F.least("_n0", "_n1").alias("_in"))
    return among_first(rows, [by, *cell], key, limits, "_in").where("_in").drop("_in")


def halves(rows: DataFrame, cell: list[str], key: Column, quota: DataFrame) -> DataFrame:
    """``rows`` with half 0 or 1: per cell, the first and next least(quota, n div 2) texts."""
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n")).join(quota, cell)
    limits = sizes.select(*cell, F.least("quota", F.floor(F.col("_n") / 2)).alias("_one")).withColumn("_two", 2 * F.col("_one"))
    return among_first(rows, cell, key, limits, "_one", "_two").where("_two").withColumn("half", (~F.col("_one")).cast("int")).drop("_one", "_two")
