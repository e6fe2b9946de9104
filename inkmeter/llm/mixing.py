"""Mixing sources to target weights, in DataFrame functions alone.

The sources form a tree of domain, language and source. A token budget is
handed down by weight; no node gets more than its leaves can give in
``max_epochs`` passes, and what a node cannot use goes to its siblings by their
weights, so a shortage reaches an ancestor only after the siblings are full.
Each leaf takes whole epochs and then a prefix of the next one. An epoch's
order is a hash of seed, epoch and doc_id.

The place where a leaf's prefix ends is found by counting tokens in 4,096 equal
ranges of the hash and then within the one range that holds the end, so a leaf
of any size is never sorted in one task. A row is then taken by comparing its
hash with the leaf's end; texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

LEVELS = ["domain", "lang", "source"]
#: Fewer leaves than this are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_LEAVES = 50_000
RANGE_BITS = 12


def fill(nodes: DataFrame, parents: list[str], budget: str, out: str, name: str) -> DataFrame:
    """Adds ``out``: each node's part of its parent's ``budget`` by ``w``, within ``cap``.

    Of the siblings in order of cap/w, those whose cap lies below the water
    level are full; the others share what is left by weight. Windows run over
    the nodes of the tree, never over rows of data.
    """
    order = [(F.col("cap") / F.col("w")), F.col(name)]
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    before = by.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = by.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    nodes = nodes.withColumn("_level", (F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    nodes = nodes.withColumn("_full", F.col("cap") <= F.col("_level") * F.col("w"))
    nodes = nodes.withColumn("_water", F.max(F.when(~F.col("_full"), F.col("_level"))).over(by))
    return nodes.withColumn(out, F.when(F.col("_full"), F.col("cap")).otherwise(F.greatest(F.col("_water"), F.lit(0.0)) * F.col("w"))).drop("_level", "_full", "_water")


def _weight(weights: Mapping[tuple, float], path: list[str]) -> Column:
    own = {k: v for k, v in weights.items() if len(k) == len(path)}
    out = F.lit(1.0)
    for key, value in own.items():
        match = F.lit(True)
        for column, x in zip(path, key, strict=True):
            if x is not None:
                match = match & F.col(column).eqNullSafe(F.lit(x))
        out = F.when(match, float(value)).otherwise(out)
    return out


def quotas(leaves: DataFrame, weights: Mapping[tuple, float], budget: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, quota): the whole tokens that each leaf gives.

    ``leaves`` has tokens per leaf. ``weights`` maps paths such as (domain,) or
    (domain, lang) to weights above 0; ``None`` in a path stands for any name,
    and a path that is not named weighs 1. A budget above all caps fills every leaf.
    """
    nodes = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    tops = nodes.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(weights, ["domain"])).withColumn("_b", F.lit(float(budget)))
    tops = fill(tops, [], "_b", "b1", "domain").select("domain", "b1")
    mids = nodes.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(weights, ["domain", "lang"]))
    mids = _on(mids, tops, ["domain"])
    mids = fill(mids, ["domain"], "b1", "b2", "lang").select("domain", "lang", "b2")
    nodes = _on(nodes.withColumn("w", _weight(weights, LEVELS)), mids, ["domain", "lang"])
    nodes = fill(nodes, ["domain", "lang"], "b2", "b3", "source")
    return nodes.select(*LEVELS, "tokens", F.least(F.floor(F.col("b3") + 1e-6), F.col("tokens") * max_epochs).cast("long").alias("quota"))


def _on(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """An equi-join in which nulls are equal."""
    right = right.select(*(F.col(c).alias(f"_{c}" if c in names else c) for c in right.columns))
    match = F.lit(True)
    for c in names:
        match = match & left[c].eqNullSafe(right[f"_{c}"])
    return left.join(right, match).drop(*(f"_{c}" for c in names))


def mix(docs: DataFrame, domain: Column, weights: Mapping[tuple, float], share: float = 0.5, max_epochs: int = 4, seed: int = 20) -> DataFrame:
    """doc (the whole row of ``docs``), domain, epoch, n_tokens and taken of each row taken.

    ``docs`` has doc_id, text, lang and source, and any other columns, which
    come back inside ``doc`` and so clash with nothing. A row comes once per
    epoch that takes it. Tokens are runs of non-blanks; ``taken`` is less than
    ``n_tokens`` only for the document in which a leaf's prefix ends. The
    budget is ``share`` of all tokens there are. Texts without tokens and null
    texts have no tokens; they come in whole epochs and where their hash lies
    before the prefix's end. Null names are names of their own. Rows of equal
    doc_id, and all of null doc_id, are taken together. An empty table gives no
    rows.
    """
    key = ["domain", "lang", "source"]
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    id_ = F.coalesce(F.col("doc_id"), F.lit(-1))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), id_.alias("id"), domain.alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source"), tokens.alias("tokens"))
    small = cut(named.drop("doc"))
    leaves = small.groupBy(*key).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = quotas(leaves, weights, share * total, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("left", F.col("quota") - F.col("whole") * F.col("tokens"))
    plan = cut(plan.select(*(F.col(c).alias(f"p_{c}") for c in key), "whole", "left"))

    def spot(id_: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("whole"), id_), 1)

    def planned(df: DataFrame, plan: DataFrame) -> DataFrame:
        plan = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan
        match = F.lit(True)
        for c in key:
            match = match & F.col(c).eqNullSafe(F.col(f"p_{c}"))
        return df.join(plan, match, "left").drop(*(f"p_{c}" for c in key))

    marked = planned(small, plan.where("left > 0")).where("left > 0").withColumn("u", spot(F.col("id"))).withColumn("r", F.shiftright("u", 63 - RANGE_BITS))
    ranges = marked.groupBy(*key, "left", "r").agg(F.sum("tokens").alias("t"))
    upto = W.partitionBy(*key).orderBy("r")
    ranges = ranges.withColumn("after", F.sum("t").over(upto)).where("after >= left and after - t < left")
    ends = cut(ranges.select(*(F.col(c).alias(f"p_{c}") for c in key), "r", (F.col("left") - F.col("after") + F.col("t")).alias("need")))
    inside = planned(marked.withColumnRenamed("r", "own"), ends).where("own = r").groupBy(*key, "need", "u").agg(F.sum("tokens").alias("t"))
    inside = inside.withColumn("after", F.sum("t").over(W.partitionBy(*key).orderBy("u"))).where("after >= need and after - t < need")
    ends = inside.select(*(F.col(c).alias(f"e_{c}") for c in key), F.col("u").alias("end"), (F.col("need") - F.col("after") + F.col("t")).alias("last"))
    match = F.lit(True)
    for c in key:
        match = match & F.col(f"p_{c}").eqNullSafe(F.col(f"e_{c}"))
    plan = cut(plan.join(ends, match, "left").select(*(f"p_{c}" for c in key), "whole", F.coalesce("end", F.lit(-1)).alias("end"), "last"))

    rows = planned(named, plan).withColumn("u", spot(F.col("id"))).withColumn("times", F.col("whole") + (F.col("u") <= F.col("end")).cast("int")).where("times > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    taken = F.when((F.col("epoch") == F.col("whole")) & (F.col("u") == F.col("end")), F.least("tokens", "last")).otherwise(F.col("tokens"))
    return rows.select("doc", "domain", "epoch", F.col("tokens").alias("n_tokens"), taken.alias("taken"))


def domain_of() -> Column:
    """The domain of a source: its number modulo 4; sources without a number are of domain 0."""
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int)"), F.lit(0)), F.lit(4)).cast("string"))


#: Production weights: by domain, then by language in any domain; sources of a language are equal.
WEIGHTS = {
    ("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1,
    (None, "en"): 5, (None, "de"): 2, (None, "fr"): 2, (None, "es"): 1,
}


def mixed_once(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """``docs`` cut down to the production weights, each row at most once.

    Whole documents are kept: that in which a leaf's prefix ends too, so a leaf
    may exceed its budget by a part of one document.
    """
    return mix(docs, domain_of(), WEIGHTS, share, 1).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, domain_of(), WEIGHTS)
    return out.select("doc.doc_id", "domain", "doc.lang", "doc.source", "epoch", "n_tokens", "taken")
