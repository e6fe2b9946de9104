"""How much of a machine's texts the persons' texts already hold, and how the persons score by the same measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .overlap import containment, exploded

HIGH, HELD_OUT = 0.2, 200


def report(scores: DataFrame, by: str, worst: int = 3) -> DataFrame:
    """by, texts, mean, most, above, worst (ids) of scored texts (by, id, containment); above is the count beyond one fifth."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("containment"), "id"))
    top = scores.withColumn("_r", rank).where(F.col("_r") <= worst).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col("id").cast("string").alias("id")))), lambda x: x["id"]), ",").alias("worst"))
    sums = scores.groupBy(by).agg(F.count("*").alias("texts"), F.avg("containment").alias("mean"), F.max("containment").alias("most"), F.count_if(F.col("containment") > HIGH).alias("above"))
    return sums.join(top, by)


def memorisation(machine: DataFrame, people: DataFrame) -> DataFrame:
    """``report`` per arm of machine texts (arm, id, text) against all persons' texts (text)."""
    scores = containment(machine, exploded(people, 5).distinct(), 5)
    return report(machine.select("arm", "id").join(scores.select("id", "containment"), "id"), "arm")


def baseline(people: DataFrame, order: Column, held: int = HELD_OUT) -> DataFrame:
    """texts, mean, most, above of persons' texts (id, text) that are held out, against the grams of the others.

    The first ``held`` in order of a hash, at most half of all, are held out; a
    gram that only held-out texts have is not in the pool.
    """
    size = min(held, people.count() // 2)
    out = people.withColumn("_k", order).orderBy("_k", "id").limit(size).drop("_k")
    rest = people.join(out.select("id"), "id", "left_anti")
    scores = containment(out, exploded(rest, 5).distinct(), 5)
    return scores.agg(F.count("*").alias("texts"), F.coalesce(F.avg("containment"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("containment"), F.lit(0.0)).alias("most"), F.count_if(F.col("containment") > HIGH).alias("above"))


def flags_agree(flagged: DataFrame, found: DataFrame) -> DataFrame:
    """id, only: ids that one of two sets (id) lacks; none where they agree."""
    a, b = (x.select("id").distinct().withColumn(n, F.lit(1)) for x, n in ((flagged, "_a"), (found, "_b")))
    return a.join(b, "id", "full_outer").where("_a is null or _b is null").select("id", F.when(F.col("_a").isNull(), "found").otherwise("flagged").alias("only"))
