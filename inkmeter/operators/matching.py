"""Which of a document's search results is the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.titles import dice, share_held, title_words
from ..functions.tokens import let
from .overlap import hashed

#: An abstract that is the same paper's by itself; a renamed paper's title and abstract; results worth another look.
SAME_ABSTRACT, RENAMED_TITLE, RENAMED_ABSTRACT = 0.5, 0.6, 0.25
NEAR_TITLE, NEAR_ABSTRACT, CHECKS = 0.5, 0.1, 2


def trigrams(text):
    return let(title_words(text), lambda w: hashed(w, 3))


def scored(docs: DataFrame, entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc, entry, same (title), overlap (null without text), likeness of the pairs of ``candidates`` (doc, entry).

    ``docs`` are (doc, title, text), ``entries`` (entry, title, summary). Words
    and trigrams are taken once per text, before the pairs are made; a trigram
    is its 64-bit hash.
    """
    left = docs.select("doc", title_words(F.col("title")).alias("t"), F.when(F.col("text").isNotNull(), trigrams(F.col("text"))).alias("x"))
    right = entries.select("entry", title_words(F.col("title")).alias("u"), trigrams(F.coalesce("summary", F.lit(""))).alias("y"))
    pairs = candidates.join(left, "doc").join(right, "entry")
    return pairs.select("doc", "entry", (F.array_join("t", " ") == F.array_join("u", " ")).alias("same"), F.when(F.col("x").isNotNull(), share_held(F.col("x"), F.col("y"))).alias("overlap"), dice(F.col("t"), F.col("u")).alias("likeness"))


def pick_match(pairs: DataFrame) -> DataFrame:
    """doc, entry, how, overlap from ``scored`` pairs: the accepted result of each document that has one.

    An equal title is taken first, whatever its text; of several the one whose
    abstract is closest, then the smallest entry. Another title needs the abstract's word.
    """
    renamed = F.col("likeness") >= RENAMED_TITLE
    confirmed = (F.col("overlap") >= SAME_ABSTRACT) | ((F.col("overlap") >= RENAMED_ABSTRACT) & renamed)
    fit = pairs.withColumn("how", F.when(F.col("same"), "title").when(confirmed & renamed, "title+abstract").when(confirmed, "abstract")).where("how is not null")
    order = F.struct(~F.col("same"), -F.coalesce("overlap", F.lit(0.0)), "entry")
    best = fit.groupBy("doc").agg(F.min_by(F.struct("entry", "how", "overlap"), order).alias("b"))
    return best.select("doc", "b.*")


def near_misses(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """doc, entry: of results that were not accepted, the two closest that have several versions (entry, version)."""
    left = pairs.join(versions.where("version > 1 and not contains(cast(entry as string), '/')").select("entry"), "entry")
    close = left.where((F.col("likeness") >= NEAR_TITLE) | (F.coalesce("overlap", F.lit(0.0)) >= NEAR_ABSTRACT)).join(pick_match(pairs).select("doc"), "doc", "left_anti")
    ranked = close.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list(F.struct((-(F.col("likeness") + F.coalesce("overlap", F.lit(0.0)))).alias("s"), "entry"))), 1, CHECKS).alias("r"))  # a document's few results
    return ranked.select("doc", F.explode("r.entry").alias("entry"))
