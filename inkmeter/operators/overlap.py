"""Shares of a text's n-grams that others hold. Grams are rows, so no group meets in one task.

A gram is the 64-bit hash of its words: rows stay small, and two different
grams are taken for one with a probability of 2**-64.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.tokens import gram_words, let

#: A pool of at most so many grams (some 16 bytes each) is broadcast; a larger one is joined by shuffle.
SMALL_POOL = 2_000_000


def hashed(words: Column, n: int) -> Column:
    """The distinct hashes of the runs of ``n`` words; none for fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<long>"))


def exploded(rows: DataFrame, n: int, *keep: str) -> DataFrame:
    """keep, gram: the distinct n-grams of each text."""
    return rows.select(*keep, F.explode(let(gram_words(F.col("text")), lambda w: hashed(w, n))).alias("gram"))


def small(pool: DataFrame) -> DataFrame:
    """``pool``, marked for broadcast if it is small. It is counted for that, up to the limit."""
    return F.broadcast(pool) if pool.limit(SMALL_POOL + 1).count() <= SMALL_POOL else pool


def containment(rows: DataFrame, pool: DataFrame, n: int, *key: str, small: bool = True) -> DataFrame:
    """id, grams, shared, containment: the share of a text's grams that its pool (key, gram) holds.

    Null texts have no grams. Unless ``small`` is false the pool is counted, and broadcast if it is small.
    """
    mine = exploded(rows, n, "id", *key)
    pool = pool.select(*key, "gram").distinct().withColumn("hit", F.lit(1))
    if small and pool.limit(SMALL_POOL + 1).count() <= SMALL_POOL:
        pool = F.broadcast(pool)
    got = mine.join(pool, [*key, "gram"], "left").groupBy("id").agg(F.count("*").alias("grams"), F.count("hit").alias("shared"))
    return _shares(rows, got)


def _shares(rows: DataFrame, got: DataFrame) -> DataFrame:
    return rows.select("id").join(got, "id", "left").select("id", F.coalesce("grams", F.lit(0)).alias("grams"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce(F.col("shared") / F.col("grams"), F.lit(0.0)).alias("containment"))


def unique_grams(rows: DataFrame, n: int) -> DataFrame:
    """gram, id: the grams that exactly one text holds.

    Most grams are in one text, so nothing is gained by adding up before they
    are dealt: only gram and id are shuffled.
    """
    return exploded(rows, n, "id").repartition("gram").groupBy("gram").agg(F.count("*").alias("texts"), F.min("id").alias("id")).where("texts = 1").select("gram", "id")


def among(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """id, grams, shared, containment: the share of a text's grams that another text of its key holds.

    A text's own grams count once, so what two texts hold is what others hold.
    Grams are made and dealt once; a gram's rows are at most one a text. Rows
    with a null key share nothing.
    """
    named = reduce(Column.__and__, (F.col(k).isNotNull() for k in key), F.lit(True))
    mine = exploded(rows, n, "id", *key).withColumn("_texts", F.count("*").over(W.partitionBy(*key, "gram")))
    return _shares(rows, mine.groupBy("id").agg(F.count("*").alias("grams"), F.count_if((F.col("_texts") > 1) & named).alias("shared")))


def guarded(rows: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """id of the texts (id, doc, text) that would show a person's words.

    A text shares 5 words in a row with the person's text (doc, text) of its own
    document, or 8 with any person's text or title, or repeats the title
    (doc, title) of its document where that has 3 words. Null docs have neither.
    """
    own = exploded(rows, 5, "id", "doc").join(exploded(people, 5, "doc"), ["doc", "gram"], "left_semi").select("id")
    said = people.select("text").union(titles.select("title"))
    anyone = exploded(rows, 8, "id").join(exploded(said, 8).distinct(), "gram", "left_semi").select("id")
    named = titles.select("doc", gram_words(F.col("title")).alias("t")).where(F.size("t") >= 3)
    repeats = F.contains(_phrase(gram_words(F.col("text"))), _phrase(F.col("t")))
    return own.union(anyone).union(rows.join(named, "doc").where(repeats).select("id")).distinct()


def _phrase(words):
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
