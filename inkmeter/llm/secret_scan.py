"""Secret scan, in DataFrame functions alone.

Three patterns find secrets by their form. Beside them, long runs of key
characters are judged by two first-order Markov models of characters, one of
random strings and one of ordinary identifiers, by the mean log-likelihood
ratio of their transitions. Both models are trained from labelled samples: the
random strings are drawn from digests, the identifiers are put together from
words in the usual styles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

KINDS = ["assign", "access", "hex", "markov"]
#: The patterns of the three base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the whole run; a later start in the same run would be shorter still
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLES = 4_000
LEAST_RATIO = 0.35

#: Words of ordinary identifiers.
WORDS = (
    "access account active add address admin agent alias all app array async auth auto back base batch block body bool box buffer build button byte cache call cell char check child class clear client clone close cloud code color column command commit common config connect content context control copy core count create current cursor data date debug default delete delta depth device dict dir disk display document domain down driver edit element email empty enable end engine entry enum error event exec exit export "
    "factory field file filter find first flag float flow folder font form format frame from function game gateway get global graph grid group handle handler hash head header height help hidden host icon image import index info init inner input insert install instance int item iterator job join json key kind label last layer layout left length level library limit line link list load local lock log login loop main manager map mark master match max memory menu merge message method min mode model module month mouse "
    "move name network new next node normal null number object offset open option order outer output owner package page panel param parent parse password patch path pattern pipe pixel plan player plugin point pool port position post prefix press print process profile project property proxy public query queue random range rank rate read record region release remote remove render replace report request reset resource response result return right role root route row rule run sample save scale scan scene schema scope "
    "score screen script search section select send server service session set setting shape shared shift show signal simple single size sort source space split stack start state static status step stop storage store stream string style submit suffix sum super switch symbol sync system table tag target task temp template test text theme thread time title token tool total trace track tree trigger type unit update upload url user util valid value vector version video view visible wait warning watch web weight width window word worker world write"
).split()


def samples(spark: SparkSession) -> DataFrame:
    """(random: boolean, s): labelled strings, the same in every session."""
    n = F.col("id").cast("string")
    digest = F.base64(F.unhex(F.sha2(F.concat(n, F.lit("/random")), 256)))
    url_safe = F.translate(digest, "+/", "-_")
    plain = F.regexp_replace(F.concat(digest, F.base64(F.unhex(F.sha2(F.concat(n, F.lit("/more")), 256)))), "[+/=]", "")
    random = F.substring(F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, url_safe).otherwise(plain), 1, 40)
    words = F.lit(WORDS)
    drawn = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))) + 1).cast("int")))
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(6))
    number = F.pmod(F.xxhash64("id", F.lit("number")), F.lit(100)).cast("string")
    ordinary = (
        F.when(style == 0, F.array_join(drawn, "_"))
        .when(style == 1, F.array_join(drawn, "-"))
        .when(style == 2, F.upper(F.array_join(drawn, "_")))
        .when(style == 3, F.array_join(F.transform(drawn, F.initcap), ""))
        .when(style == 4, F.concat(F.array_join(drawn, "/"), F.lit("_v"), number))
        .otherwise(F.concat(F.array_join(drawn, ""), number))
    )
    ids = spark.range(SAMPLES)
    return ids.select(F.lit(True).alias("random"), random.alias("s")).union(ids.select(F.lit(False), ordinary))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of characters of the alphabet, row by row.

    ``labelled`` (random, s) may have any size; only the counts of pairs, at
    most twice the square of the alphabet, come to the driver. Each model's
    rows are smoothed by one half. Null strings and other characters are ignored.
    """
    at = F.transform(F.split(F.coalesce("s", F.lit("")), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("at") - 1, F.lit(1))), lambda i: F.struct(F.get("at", i - 1).alias("a"), F.get("at", i).alias("b")))
    rows = labelled.select("random", at.alias("at")).select("random", F.explode(pairs).alias("p")).where("p.a >= 0 and p.b >= 0")
    n = len(ALPHABET)
    counts = {True: [0.5] * (n * n), False: [0.5] * (n * n)}
    for random, a, b, k in rows.groupBy("random", "p.a", "p.b").count().collect():
        counts[random][a * n + b] += k
    totals = {side: [sum(c[a * n : a * n + n]) for a in range(n)] for side, c in counts.items()}
    return [math.log(counts[True][i] / totals[True][i // n]) - math.log(counts[False][i] / totals[False][i // n]) for i in range(n * n)]


#: Characters of a piece in which long strings are taken apart, and elements of a block of a running fold.
PIECE, BLOCK = 1024, 256


def pieces(text: Column) -> Column:
    """array<string>: a text in pieces of ``PIECE`` code points, from one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions; above 0: likelier random.

    A token is taken apart in pieces, each with the character after it, so time
    is linear in its length and only a piece's characters are held.
    """
    n = len(ALPHABET)
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1

    def total(piece: Column) -> Column:
        codes = F.transform(F.split(piece, ""), code)
        return let(codes, lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(model, F.element_at(c, i) * n + F.element_at(c, i + 1) + 1)))

    def over(parts: Column) -> Column:
        linked = F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(parts, i + 1), 1, 1), F.lit(""))))
        sums = F.transform(F.filter(linked, lambda x: F.char_length(x) > 1), total)
        return F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x)

    return let(pieces(token), over) / (F.char_length(token) - 1)


def running(values: Column, merge, zero: Column) -> Column:
    """For each element of an array of integers, ``merge`` of all before it, from ``zero`` on.

    Folds run in blocks, and once more over the blocks' results, so that what
    a fold copies stays small beside the input.
    """

    def fold(block: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int"))
    folds = F.transform(blocks, lambda b: fold(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    starts = lambda all_: fold(F.transform(all_, lambda x: x["at"]))["out"]
    placed = lambda all_: F.flatten(F.zip_with(all_, starts(all_), lambda x, at: F.transform(x["out"], lambda v: merge(at, v))))
    return let(folds, placed)


NONE = "array<struct<s:int,k:int,e:int>>"


def _none() -> Column:
    return F.array().cast(NONE)


def spans(text: Column, pattern: str, kind: int, group: int = 0, keep=None) -> Column:
    """array<struct<s, k, e>>: the leftmost non-overlapping matches that ``keep`` accepts.

    What the pattern splits and what it extracts alternate, so the places
    follow from the lengths, in code points.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(z: Column) -> Column:
        whole = F.transform(z, lambda x: F.char_length(x["gap"]) + F.char_length(x["m"]))
        ends = let(whole, lambda n: running(n, lambda a, b: a + b, F.lit(0)))

        def one(x: Column, before: Column) -> Column:
            start = before + F.char_length(x["gap"])
            return F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + F.char_length(x["m"])).alias("e"))

        kept = F.transform(z, lambda x: F.lit(True) if keep is None else keep(x["g"]))
        made = let(ends, lambda at: F.transform(z, lambda x, i: one(x, F.get(at, i))))
        return F.transform(F.filter(F.arrays_zip(made.alias("span"), kept.alias("kept")), lambda x: x["kept"]), lambda x: x["span"])

    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("m"), groups.alias("g")), lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), let(zipped, placed)).otherwise(_none())


def apart(base: Column, judged: Column) -> Column:
    """``base`` and those of ``judged`` (kind 3) that no base span touches, in order of start, then kind."""

    def kept(every: Column) -> Column:
        is_base = lambda x: x["k"] < 3
        far = 1 << 30
        past = running(F.transform(every, lambda x: F.when(is_base(x), x["e"]).otherwise(0)), F.greatest, F.lit(0))
        coming = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(is_base(x), x["s"]).otherwise(far))), F.least, F.lit(far)))
        marked = F.arrays_zip(every.alias("x"), past.alias("past"), coming.alias("coming"))
        return F.transform(F.filter(marked, lambda v: is_base(v["x"]) | ((v["past"] <= v["x"]["s"]) & (v["coming"] >= v["x"]["e"]))), lambda v: v["x"])

    every = F.array_sort(F.concat(base, judged))
    return F.when((F.size(base) == 0) | (F.size(judged) == 0), every).otherwise(let(every, kept))


def secret_spans(text: Column, model: list[float]) -> Column:
    """All spans of a text, in order of start, then kind.

    Null texts count as empty. A run that a base span touches is not judged
    again. Time is linear in the text and its spans, but for sorting them.
    """
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    text = F.coalesce(text, F.lit(""))
    base = F.concat(
        spans(text, ASSIGN, 0, 1, lambda value: F.char_length(value) >= LEAST_VALUE),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, 1)).otherwise(_none()),
        spans(text, HEX, 2),
    )
    judged = spans(text, CANDIDATE, 3, 0, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (ratio(t, table) >= LEAST_RATIO))
    return let(base, lambda b: let(judged, lambda j: apart(b, j)))


def _listed(found: Column) -> Column:
    names = F.lit(KINDS)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of start ``s``, kind number ``k``, end ``e``) of every row.

    Places are code points, ends exclusive. Empty and null texts have no spans.
    Rows are independent: repeated rows and null doc_ids come back as they are.
    """
    model = train(samples(docs.sparkSession))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), secret_spans(F.col("text"), model).alias("found"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``; no row goes.

    Overlapping spans are replaced once. Where there is a column n_chars, it is
    set to the new length of the text. Null texts stay null.
    """
    model = train(samples(docs.sparkSession))
    text = F.col("text")

    def between(parts: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor(F.greatest(end - 1, start) / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start - first * PIECE + 1, end - start)

    def rebuilt(found: Column) -> Column:
        def joined(before: Column, parts: Column) -> Column:
            kept = F.transform(found, lambda x, i: F.when(F.get(before, i) <= x["s"], F.concat(between(parts, F.get(before, i), x["s"]), F.lit(mark))).otherwise(""))
            done = F.array_max(F.transform(found, lambda x: x["e"]))
            return F.concat(F.array_join(kept, ""), between(parts, done, F.char_length(text)))

        before = running(F.transform(found, lambda x: x["e"]), F.greatest, F.lit(0))
        return let(before, lambda b: let(pieces(text), lambda p: joined(b, p)))

    new = let(secret_spans(text, model), lambda found: F.when(F.size(found) > 0, rebuilt(found)).otherwise(text))
    out = docs.select(*(new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def n(kind: int) -> Column:  # a lambda's second argument, even one with a default, is the element's place
        return F.size(F.filter("found", lambda x: x["k"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("found", lambda x: x["k"] < 3)
    return found.select("doc_id", *map(n, range(3)), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
