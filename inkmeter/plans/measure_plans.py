"""A kind of writing measured: pairings, tests, placebo and verdicts of all markers, and the count over writers.

Every text is read once; what its markers say is kept as an array beside its
length, and all that follows reads that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import stats as S
from ..functions.tokens import length_bin, length_stratum, n_words
from ..operators import pairing
from ..session import cut
from .base import BIN_SQL, SEEDS, WORDS_SQL, order_key, quoted, round6, seeded, table
from .marker_plans import FLAG_SQL, WHOLE, benjamini_hochberg, bounded_rates, rate_tests, summed

SEED = "20260916"
#: What a writer's comparison must rest on to count, unless its verdict separates.
MIN_USES, MIN_PAIRS = 5, 30


@dataclass(frozen=True)
class Genre:
    """How a kind of writing is measured. ``pairing`` is "prompt" or None, ``placebo`` "matched" or "whole"."""

    reference: str
    casual: str
    decider: str
    writers: tuple[str, ...]
    pairing: str | None = None
    placebo: str | None = None
    not_recorded: tuple[str, ...] = ()
    seed: str = SEED

    @property
    def matched_placebo(self) -> bool:
        return (self.placebo or ("matched" if self.pairing else "whole")) == "matched"


def signals(rows: DataFrame, markers: list[M.Marker] = M.MARKERS) -> DataFrame:
    """arm, id, doc, grp, pos, n_words, bin, stratum and what every marker of ``markers`` says of each text (arm, id, doc, grp, pos, text).

    ``marks`` holds per marker ``n`` (null for markers of a whole text), ``hit``
    and whether the marker can judge the text. Null texts count as empty.
    """
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_rt", M.readable(F.col("text"))).withColumn("_low", F.lower("_rt"))
    if any(m.eligible for m in markers):
        rows = rows.withColumn("_cv", M.evenness(F.col("text")))

    def mark(m: M.Marker) -> Column:
        n = m.counted(F.col("_rt"), F.col("_low")) if m.count else F.lit(None).cast("long")
        hit, ok = (n > 0, F.lit(True)) if m.count else M.hit_and_judged(m, F.col("text"), F.col("_cv"))
        return F.struct(F.lit(m.id).alias("marker"), n.alias("n"), hit.alias("hit"), ok.alias("ok"))

    keep = ["arm", "id", "doc", "grp", "pos"]
    rows = rows.select(*keep, n_words(F.col("text")).alias("n_words"), F.array(*map(mark, markers)).alias("marks"))
    return cut(rows.withColumn("bin", length_bin(F.col("n_words"))).withColumn("stratum", length_stratum(F.col("n_words"))))


def pairings(found: DataFrame, genre: Genre) -> dict[str, str]:
    """How each arm is paired with the reference: self, prompt, document or length.

    Pairing by prompt is asked for by the kind of writing; it needs every text
    of an arm to name an assignment, and an arm that names some is an error.
    Otherwise an arm most of whose texts share a document with the reference is
    paired by document. At most a row per arm comes to the driver.
    """
    docs = found.where(F.col("arm") == genre.reference).select("doc").distinct().withColumn("_s", F.lit(1))
    arms = found.join(docs, "doc", "left").groupBy("arm").agg(F.count("*").alias("texts"), F.count("grp").alias("named"), F.count("_s").alias("shared")).collect()
    if not any(a.arm == genre.reference for a in arms):
        raise ValueError(f"the reference {genre.reference} is not among the arms")
    out = {}
    for a in arms:
        if genre.pairing == "prompt":
            if 0 < a.named < a.texts:
                raise ValueError(f"{a.arm}: {a.texts - a.named} of {a.texts} texts name no assignment")
            if a.arm == genre.reference and not a.named:
                raise ValueError(f"{a.arm}: no text names an assignment, so nothing can be paired by one")
        if a.arm == genre.reference:
            out[a.arm] = "self"
        else:
            out[a.arm] = "prompt" if genre.pairing == "prompt" and a.named else "document" if 2 * a.shared > a.texts else "length"
    return out


def _key(seed: str, side: Column, *cell: str) -> Column:
    return order_key(f"{seed}/pair", *(F.col(c) for c in cell), side, F.col("id"))


def paired(found: DataFrame, genre: Genre, arm: str, how: str) -> DataFrame:
    """label, side, arm, id: the texts of an arm (side arm) and of the reference (side ref) that are compared."""
    mine, ref = found.where(F.col("arm") == arm), found.where(F.col("arm") == genre.reference)
    side = F.when(F.col("arm") == arm, "arm").otherwise("ref")
    if how == "self":
        got = mine.select("arm", "id", F.explode(F.array(F.lit("arm"), F.lit("ref"))).alias("side"))
    elif how == "document":
        pairs = pairing.by_document(ref.select("doc", "bin", "pos", "id"), mine.select("doc", "bin", "pos", "id"))
        both = F.array(F.struct(F.lit(genre.reference).alias("arm"), F.col("a_id").alias("id"), F.lit("ref").alias("side")), F.struct(F.lit(arm).alias("arm"), F.col("b_id").alias("id"), F.lit("arm").alias("side")))
        got = pairs.select(F.explode(both).alias("x")).select("x.arm", "x.id", "x.side")
    else:
        cell = ["grp", "bin"] if how == "prompt" else ["bin"]
        rows = mine.unionByName(ref).where("bin >= 0").select("arm", "id", *cell, side.alias("side"))
        got = pairing.drawn(rows, cell, _key(genre.seed, F.col("side"), *cell), ("ref", "arm"), "side").select("arm", "id", "side")
    return got.select(F.lit(arm).alias("label"), "side", "arm", "id")


def _said(found: DataFrame, names: list[str]) -> DataFrame:
    return found.select("arm", "id", F.explode(F.filter("marks", lambda x: x["marker"].isin(*names))).alias("m")).select("arm", "id", "m.*")


def _judged(found: DataFrame, name: str) -> DataFrame:
    return found.where(F.exists("marks", lambda x: (x["marker"] == name) & x["ok"]))


def _chosen(found: DataFrame, genre: Genre, arm: str, how: str, name: str) -> DataFrame:
    """The pairing of an arm for a marker that cannot judge every text.

    A document pair stays if both texts can be judged; a draw is drawn again.
    """
    if how != "document":
        return paired(_judged(found, name), genre, arm, how)
    mine, ref = (found.where(F.col("arm") == a).select("doc", "bin", "pos", "id") for a in (arm, genre.reference))
    pairs = pairing.by_document(ref, mine)
    fine = _judged(found, name).select("arm", "id")
    for c, a in (("a_id", genre.reference), ("b_id", arm)):
        pairs = pairs.join(fine.where(F.col("arm") == a).select(F.col("id").alias(c)), c, "left_semi")
    both = F.array(F.struct(F.lit(genre.reference).alias("arm"), F.col("a_id").alias("id"), F.lit("ref").alias("side")), F.struct(F.lit(arm).alias("arm"), F.col("b_id").alias("id"), F.lit("arm").alias("side")))
    return pairs.select(F.lit(arm).alias("label"), F.explode(both).alias("x")).select("label", "x.side", "x.arm", "x.id")


def _counted(chosen: DataFrame, said: DataFrame) -> DataFrame:
    return chosen.join(said, ["arm", "id"]).groupBy("label", "side", "marker").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))


ELIGIBLE = [m.id for m in M.MARKERS if m.eligible]
PLAIN = [m.id for m in M.MARKERS if not m.eligible]


def matched_shares(found: DataFrame, genre: Genre, how: dict[str, str], plain: list[str] = PLAIN, eligible: list[str] = ELIGIBLE) -> DataFrame:
    """label (arm), side, marker, n, k, lo, hi: shares of texts on each arm's pairing with the reference."""
    out = None
    for arm, mode in sorted(how.items()):
        parts = [_counted(paired(found, genre, arm, mode), _said(found, plain))]
        parts += [_counted(_chosen(found, genre, arm, mode, x), _said(found, [x])) for x in eligible]
        for part in parts:
            out = part if out is None else out.unionByName(part)
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return out.withColumns({"lo": lo, "hi": hi})


def placebo(found: DataFrame, genre: Genre, machine: str, how: str) -> DataFrame:
    """arm, id, half (a or b): the reference in two, whole or to the size of the machine's pairing in every cell."""
    ref = found.where(F.col("arm") == genre.reference)
    key = order_key(f"{genre.seed}/placebo", F.col("id"))
    if genre.matched_placebo:
        cell = ["grp", "bin"] if how == "prompt" else ["bin"]
        mine = paired(found, genre, machine, how).where("side = 'arm'").select("arm", "id").join(found.select("arm", "id", *cell), ["arm", "id"])
        quota = mine.where("bin >= 0").groupBy(*cell).agg(F.count("*").alias("quota"))
        got = pairing.halves(ref.where("bin >= 0").select("arm", "id", *cell), cell, key, quota)
        return got.select("arm", "id", F.when(F.col("half") == 0, "a").otherwise("b").alias("half"))
    rows = ref.select("arm", "id", F.lit(0).alias("cell"))
    limit = rows.groupBy("cell").agg(F.floor(F.count("*") / 2).alias("first"))
    return pairing.among_first(rows, ["cell"], key, limit, "first").select("arm", "id", F.when(F.col("first"), "a").otherwise("b").alias("half"))


def tested_reference(found: DataFrame, genre: Genre, machine: str, how: str) -> DataFrame:
    """arm, id of the reference's texts that the machine's words are tested against: of its documents, where it is paired by document."""
    ref = found.where(F.col("arm") == genre.reference)
    if how == "document":
        ref = ref.join(found.where(F.col("arm") == machine).select("doc").distinct(), "doc", "left_semi")
    return ref.select("arm", "id")


def measure(found: DataFrame, genre: Genre, machine: str, how: dict[str, str]) -> DataFrame:
    """One row per marker: shares, rates, tests, placebo and verdict of ``machine`` against the reference.

    ``found`` are signals, ``how`` the pairings of their arms. Words and phrases
    are decided by the length-matched rate test, corrected over all markers
    that are recorded; markers of a whole text by intervals on the pairing.
    """
    here = found.where(F.col("arm").isin(genre.reference, genre.casual, machine))
    how = {a: h for a, h in how.items() if a in (genre.reference, genre.casual, machine)}
    split = cut(placebo(here, genre, machine, how[machine]))

    # one table of sums for every side that a rate is told of
    keep = ["arm", "id", "stratum", "n_words", "marks"]
    groups = here.select(F.col("arm").alias("label"), *keep)
    groups = groups.unionByName(here.join(tested_reference(here, genre, machine, how[machine]), ["arm", "id"], "left_semi").select(F.lit("tested").alias("label"), *keep))
    groups = groups.unionByName(here.join(split, ["arm", "id"]).select(F.concat(F.lit("half "), "half").alias("label"), *keep))
    words = groups.select(F.col("label").alias("arm"), "stratum", "n_words", F.explode("marks").alias("m")).where("m.ok and m.n is not null")
    tallies = cut(summed(words.select("arm", "stratum", "n_words", "m.marker", "m.n")))
    test = rate_tests(tallies, machine, "tested").select("marker", F.col("p").alias("rate_p"), "observed", "expected")
    blank = rate_tests(tallies, "half a", "half b").select("marker", F.col("p").alias("blank_p"))
    rates = bounded_rates(tallies)
    rate = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    rates = rates.groupBy("marker").agg(*(rate(a, c).alias(f"{x}_{c}") for x, a in (("ref", genre.reference), ("machine", machine), ("casual", genre.casual)) for c in ("words", "occurrences", "per1000", "lo", "hi")))

    shares = matched_shares(here, genre, how)
    side = lambda arm, s, c: F.max(F.when((F.col("label") == arm) & (F.col("side") == s), F.col(c)))
    shares = shares.groupBy("marker").agg(*(side(a, s, c).alias(f"{x}{c}") for x, a, s in (("m", machine, "arm"), ("r", machine, "ref"), ("c", genre.casual, "arm")) for c in ("n", "k", "lo", "hi")))

    both = here.join(split.select("arm", "id", "half"), ["arm", "id"])
    key = order_key(f"{genre.seed}/halves", F.col("bin"), F.col("half"), F.col("id"))
    plain = pairing.drawn(both.where("bin >= 0").select("arm", "id", "half", "bin"), ["bin"], key, ("a", "b"), "half")
    parts = [plain.join(_said(here, PLAIN), ["arm", "id"])]
    for x in ELIGIBLE:
        again = pairing.drawn(_judged(both, x).where("bin >= 0").select("arm", "id", "half", "bin"), ["bin"], key, ("a", "b"), "half")
        parts.append(again.join(_said(here, [x]), ["arm", "id"]))
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    half = lambda h, c: F.count_if((F.col("half") == h) & c)
    halves = parts[0].groupBy("marker").agg(*(half(h, c).alias(f"{h}{x}") for h in "ab" for x, c in (("n", F.lit(True)), ("k", F.col("hit")))))

    rows = found.sparkSession.createDataFrame([(m.id, m.family, m.count is not None, m.id not in genre.not_recorded) for m in M.MARKERS], "marker string, family string, countable boolean, recorded boolean")
    for part in (test, blank, rates, shares, halves):
        rows = rows.join(F.broadcast(part), "marker", "left")  # a row per marker
    zero = lambda *cs: {c: F.coalesce(c, F.lit(0)) for c in cs}
    rows = rows.withColumns(zero("mn", "mk", "rn", "rk", "cn", "ck", "an", "ak", "bn", "bk", "ref_occurrences", "machine_occurrences"))
    share_p, blank_p = (S.two_proportion_p(*(F.col(c) for c in cs)) for cs in (("mk", "mn", "rk", "rn"), ("ak", "an", "bk", "bn")))
    pick = lambda a, b: F.when(F.col("recorded"), F.when(F.col("countable"), a).otherwise(b))
    rows = cut(rows.select("*", pick(F.col("rate_p"), share_p).alias("p"), pick(F.col("blank_p"), blank_p).alias("placebo_p")))
    rows = benjamini_hochberg(benjamini_hochberg(rows, "p", "q"), "placebo_p", "placebo_q")
    alo, ahi = S.wilson(F.col("ak"), F.col("an"))
    blo, bhi = S.wilson(F.col("bk"), F.col("bn"))
    tie = F.when(F.col("countable"), ~F.coalesce(F.col("placebo_q") < S.SIGNIFICANCE, F.lit(False))).otherwise(~F.col("recorded") | ((alo <= bhi) & (blo <= ahi)))
    low = F.col("q") < S.SIGNIFICANCE
    above = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    by_rate = (
        F.when(F.coalesce("machine_words", F.lit(0)) == 0, "not recorded")
        .when(low & (F.col("observed") > F.col("expected")), "machine marker")
        .when(low, "points the other way")
        .when((F.col("casual_words") > 0) & above("ref_lo", "casual_hi") & above("machine_lo", "casual_hi"), "register marker")
        .otherwise("no signal")
    )
    by_share = (
        F.when(F.col("mn") == 0, "not recorded")
        .when(above("mlo", "rhi"), "machine marker")
        .when(above("rlo", "mhi"), "points the other way")
        .when((F.col("cn") > 0) & above("rlo", "chi") & above("mlo", "chi"), "register marker")
        .otherwise("no signal")
    )
    verdict = F.when(~F.col("recorded"), "not recorded").when(F.col("countable"), by_rate).otherwise(by_share)
    rows = rows.select(
        "marker", "family", "countable", "p", "q", "observed", "expected", F.col("ref_occurrences"), F.col("machine_occurrences"), F.col("ref_per1000"), F.col("machine_per1000"),
        F.col("mn").alias("pairs"), F.col("mk").alias("machine_k"), F.col("rk").alias("ref_k"), "placebo_p", "placebo_q", tie.alias("placebo_tie"), verdict.alias("verdict"),
    )
    separates = F.col("verdict").isin("machine marker", "points the other way")
    carrying = F.col("machine_k") + F.col("ref_k")
    thin = F.when(F.col("countable"), F.col("ref_occurrences") + F.col("machine_occurrences") < MIN_USES).otherwise((F.col("pairs") < MIN_PAIRS) | (F.least(carrying, 2 * F.col("pairs") - carrying) < MIN_USES))
    return rows.withColumn("too_few", ~separates & thin)


def measured(rows: DataFrame, genre: Genre) -> DataFrame:
    """writer and the columns of ``measure`` for every counted writer of a kind of writing that is among the arms."""
    found = signals(rows)
    how = pairings(found, genre)
    out = None
    for w in genre.writers:
        if w in how:
            one = measure(found, genre, w, how).select(F.lit(w).alias("writer"), "*")
            out = one if out is None else out.unionByName(one)
    if out is None or genre.decider not in how:
        raise ValueError("the decider is not among the arms")
    return out


def summary(cells: DataFrame, decider: str) -> DataFrame:
    """marker, verdict, q, placebo_tie of the decider, and over the writers: ai, person, of, too_few."""
    counts = F.col("verdict") != "not recorded"
    side = lambda v: F.count_if(F.col("verdict") == v)
    k = cells.groupBy("marker").agg(side("machine marker").alias("ai"), side("points the other way").alias("person"), F.count_if(counts & ~F.col("too_few")).alias("of"), F.count_if(counts & F.col("too_few")).alias("too_few"))
    mine = cells.where(F.col("writer") == decider).select("marker", "verdict", F.when(F.col("countable"), F.col("q")).alias("q"), "placebo_tie")
    return mine.join(k, "marker")


def summarised(genres: dict[str, tuple[DataFrame, Genre]]) -> tuple[DataFrame, DataFrame]:
    """Over kinds of writing: (genre, marker, the decider's verdict and the count over writers), and
    (genre, placebo_disagreements). ``genres`` maps a name to ``measured`` cells and how they were measured."""
    grid = checks = None
    for name, (cells, genre) in genres.items():
        one = summary(cells, genre.decider).select(F.lit(name).alias("genre"), "*")
        apart = cells.where(F.col("writer") == genre.decider).agg(F.count_if(~F.col("placebo_tie")).alias("placebo_disagreements")).select(F.lit(name).alias("genre"), "*")
        grid, checks = (one, apart) if grid is None else (grid.unionByName(one), checks.unionByName(apart))
    return grid, checks


# ---- the registered queries: documents as a person's texts, and three writers' edits of them ----
ARMS = Genre("person", "casual", "gpt", ("gpt", "llama"))
#: Writer, the language it leaves out, how far its seeded sentences are shifted against the person's, and one of its own where doc_id % k = r.
WRITERS = [("gpt", "fr", 1, (3, 0, " We showcase a crucial realm. gonna")), ("llama", "de", 3, (2, 1, "\n- **x** and — so — on"))]


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the person, edits of it by two writers, and the conversations as casual writing."""
    docs = table(spark, sf_dir, "documents")
    keep = [F.col("doc_id").alias("doc"), F.col("source").alias("grp"), F.col("doc_id").alias("pos")]
    made = docs.select(F.lit("person").alias("arm"), *keep, seeded(F.col("text"), F.col("doc_id")).alias("text"))
    for name, without, shift, (k, r, own) in WRITERS:
        text = F.concat(seeded(F.col("text"), F.col("doc_id") + shift), F.when(F.col("doc_id") % k == r, own).otherwise(""))
        made = made.unionByName(docs.where(F.col("lang") != without).select(F.lit(name).alias("arm"), *keep, text.alias("text")))
    talk = table(spark, sf_dir, "conversations").select(F.lit("casual").alias("arm"), (-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("doc"), F.lit(None).cast("string").alias("grp"), F.col("turn").alias("pos"), "text")
    return made.unionByName(talk).withColumn("id", F.concat_ws("/", "arm", "doc"))


def measure_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(arms(spark, sf_dir), ARMS)


def summary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(measured(arms(spark, sf_dir), ARMS), ARMS.decider)


def matched_share_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the whole-text markers on the document pairs of two writers with the person."""
    found = signals(arms(spark, sf_dir), [M.BY_ID[x] for x in WHOLE])
    how = {a: h for a, h in pairings(found, ARMS).items() if a in ARMS.writers}
    got = matched_shares(found, ARMS, how, WHOLE, [])
    return got.select("label", "side", "marker", "n", "k", round6(F.col("lo")).alias("lo"), round6(F.col("hi")).alias("hi"))


def _seeded_sql(shift: int) -> str:
    return "text || " + " || ".join(f"CASE WHEN (doc_id + {shift}) % {k} = {r} THEN {quoted(s)} ELSE '' END" for k, r, s in SEEDS)


def _arms_sql() -> str:
    """The three writers' texts as a SELECT of arm, doc, text."""
    arms_ = [f"SELECT 'person' AS arm, doc_id AS doc, {_seeded_sql(0)} AS text FROM documents"] + [f"SELECT {quoted(n)} AS arm, doc_id AS doc, {_seeded_sql(s)} || CASE WHEN doc_id % {k} = {r} THEN {quoted(own)} ELSE '' END AS text FROM documents WHERE lang <> {quoted(w)}" for n, w, s, (k, r, own) in WRITERS]
    return " UNION ALL ".join(arms_)


ARMS_SQL = _arms_sql()


def _matched_sql() -> str:
    flags = " UNION ALL ".join(f"SELECT arm, doc, bin, {quoted(x)} AS marker, {FLAG_SQL[x]} AS hit FROM f" for x in WHOLE)
    p = "(k::DOUBLE / n)"
    wilson = [f"round(100 * ({p} + 1.96*1.96/(2*n) {s} 1.96*sqrt({p}*(1-{p})/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6)" for s in "-+"]
    return f"""WITH t AS ({ARMS_SQL}), f0 AS (SELECT *, {WORDS_SQL} AS n_words, replace(text, '**', '') AS rt FROM t), f AS (SELECT *, {BIN_SQL} AS bin FROM f0),
h AS ({flags}), j AS (SELECT a.arm AS label, a.marker, a.hit AS mine, r.hit AS theirs FROM h a JOIN h r ON a.doc = r.doc AND a.bin = r.bin AND a.marker = r.marker WHERE a.bin >= 0 AND a.arm <> 'person' AND r.arm = 'person'),
g AS (SELECT label, 'arm' AS side, marker, count(*) AS n, count(*) FILTER (mine) AS k FROM j GROUP BY ALL UNION ALL SELECT label, 'ref', marker, count(*), count(*) FILTER (theirs) FROM j GROUP BY ALL)
SELECT label, side, marker, n, k, {wilson[0]} AS lo, {wilson[1]} AS hi FROM g"""


QUERIES = {"measure_genre": measure_genre, "summary_cells": summary_cells, "matched_share_counts": matched_share_counts}
SQL = {"matched_share_counts": _matched_sql()}
