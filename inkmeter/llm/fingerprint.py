"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's tokens are runs of letters and digits, lower-cased, of at most 16
characters. Each run of ``k`` tokens is hashed; of every ``w`` neighbouring
hashes the smallest is chosen, the rightmost of equal ones, and kept with its
position. Two texts that share ``w + k - 1`` tokens in a row share a choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let

K, WINDOW = 5, 8
#: Bytes of text that weigh as one when ranges are cut.
UNIT = 2048
#: A choice is packed as 36 bits of hash and 27 bits of position counted from the right.
POSITIONS = 1 << 27
TOKEN = r"[\p{L}\p{N}\p{M}]{1,16}"


def winnow(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """array<struct<h: bigint, pos: int>>: the chosen hashes in order of position.

    A text with fewer than ``k`` tokens is one hash of all of them; one without
    tokens, or null, has an empty fingerprint. A text with fewer than ``w``
    hashes is one window.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))

    def grams(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))
        return F.when(F.size(words) > 0, many).otherwise(F.array().cast("array<bigint>"))

    def packed(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.shiftrightunsigned(h, 28) * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - i))

    def chosen(marks: Column) -> Column:
        last = F.greatest(F.size(marks) - (w - 1), F.lit(1))
        least = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_min(F.slice(marks, i, F.lit(w))))
        return F.when(F.size(marks) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))

    def named(hashes: Column) -> Column:
        return F.transform(
            let(packed(hashes), chosen),
            lambda m: let(
                (F.lit(POSITIONS - 1) - F.pmod(m, F.lit(POSITIONS))).cast("int"),
                lambda p: F.struct(F.element_at(hashes, p + 1).alias("h"), p.alias("pos")),
            ),
        )

    return let(let(tokens, lambda t: F.transform(t, lambda x: F.xxhash64(x))), lambda t: let(grams(t), named))


def shown(print_: Column) -> Column:
    """A fingerprint as text: hash in hexadecimal, ``@``, position; joined by blanks."""
    return F.array_join(F.transform(print_, lambda x: F.concat(F.hex(x["h"]), F.lit("@"), x["pos"].cast("string"))), " ")


def hashes_of(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: x["h"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike (1)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def _keys(spark, n: int) -> list[int]:
    """``n`` different numbers, of which each goes to a partition of its own when dealt by hash to ``n``."""
    found = spark.range(64 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    return [dict(found).get(p, 64 * n + p) for p in range(n)]


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Each row of ``docs`` (doc_id, ...) with the next row's columns, prefixed ``next_``.

    Next is in descending doc_id; after the last comes the first. The rows are
    dealt by ranges of doc_id whose bounds are ids that occur, from one pass in
    which a row counts by the bytes of its text, so that ranges are of like
    size; a bound's row is also sent to the range above, whose last row it
    follows. So the texts are shuffled once, and no task sees all rows. Rows
    with a null doc_id come after the smallest id. Rows of equal doc_id are in
    order of text, in one range.
    """
    spot = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    weight = F.least(F.octet_length("text") / UNIT, F.lit(1 << 16)).cast("int") + 1
    found = docs.select(F.explode(F.array_repeat(spot, weight)).alias("d")).agg(F.percentile_approx("d", F.array(*(F.lit(i / parts) for i in range(1, parts + 1))), F.lit(100 * parts)).alias("at"), F.max("d").alias("top")).first()
    bounds = sorted({*(found["at"] or []), *([found["top"]] if found["top"] is not None else [])})
    if not bounds:
        bounds = [0]
    ends = F.lit(bounds)
    # The number of bounds below a row's place is its range; ranges run up from the smallest ids.
    range_ = F.size(F.filter(ends, lambda b: b < F.col("_at")))
    rows = docs.withColumn("_at", spot).withColumn("_own", range_)
    # The first row of a range follows the last of the range above; that of the topmost follows all.
    above = F.pmod(F.col("_own") + 1, F.lit(len(bounds)))
    is_end = F.array_contains(ends, F.col("_at"))
    own, copy = F.struct(F.col("_own").alias("r"), F.lit(0).alias("c")), F.struct(above.alias("r"), F.lit(1).alias("c"))
    places = F.when(is_end, F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.withColumn("_place", F.explode(places)).withColumn("_copy", F.col("_place.c"))
    # One partition a range: two ranges that a hash sends to one partition would make a long task.
    keys = _keys(docs.sparkSession, len(bounds))
    dealt = dealt.withColumn("_range", F.element_at(F.lit(keys), F.col("_place.r") + 1)).repartition(len(bounds), "_range")
    # A copy stands below every row of its range, whatever its own id.
    order = W.partitionBy("_range").orderBy(F.col("_copy"), F.col("_at").desc(), F.col("text"))
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in docs.columns]
    return dealt.select(*docs.columns, "_copy", *nexts).where("_copy = 0").drop("_copy")


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the fingerprints of the
    text and of its edited text, whose last half is taken from the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty. Other columns of
    ``docs`` are ignored.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, parts)
    n = F.char_length("text").cast("int")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), winnow(F.col("text"), k, w).alias("p"), winnow(edited, k, w).alias("q"), hashes_of(winnow(F.col("next_text"), k, w)).alias("r"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("p")).alias("fingerprint"), shown(F.col("q")).alias("edited_fingerprint"),
        let(hashes_of(F.col("p")), lambda a: likeness(a, hashes_of(F.col("q")))).alias("near_edited"),
        let(hashes_of(F.col("p")), lambda a: likeness(a, F.col("r"))).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
