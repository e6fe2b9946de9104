"""Patterns that are tried only where a match can begin, the word count without lower case, and sentences told without a fold."""

import random

from pyspark.sql import functions as F

from inkmeter.functions import markers as M
from inkmeter.functions import sentences as S
from inkmeter.functions import tokens as T
from inkmeter.functions.dialect import java
from inkmeter.plans import measure_plans

PARTS = [
    "I", "I'm", "i think", "my", "Me", "MY", "mine", " ", "  ", "\n", "-", "--", "---", "—", "–", " - A", "| --- |", "arent", "ARENT", "dont", "Don’t", "van't", "it's", "who’s", "im so", "Im not", "ive a",
    "my wife", "last week", "When I was", "gonna", "TBH", "leverage", "have leverage", "Leverages loans", "Type I", "é", "_", "'", '"', ".", "K", "İ", "aİb", "ſ", "Å", "e.g.", "No. 5", "Fig.", "J.", "et al.", "1. a", "# A b", "## Two Words", "word", "?", "!\n\n", "1990",
]


def made(n=400):
    rnd = random.Random(7)
    return ["", *PARTS, *("".join(rnd.choice(PARTS) + rnd.choice(["", " ", ". "]) for _ in range(rnd.randint(1, 40))) for _ in range(n))]


def test_prefixes_change_no_match(spark):
    rows = spark.createDataFrame([(t,) for t in made()], "text string")
    pairs = [
        ("em_dash", M.DASH, "m"), ("leverage", M.LEVERAGE, "i"), ("no_first_person", M.FIRST_PERSON, "u"), ("no_personal_detail", M.PERSONAL, "i"),
        ("no_typo_markers", M.INFORMAL, "i"), ("contraction", M.CONTRACTION, "i"), ("bare_contraction", M.BARE_CONTRACTION, "iu"), ("bare_i", M.BARE_I, "u"),
    ]
    for name, pattern, flags in pairs:
        assert name in M.BEGINS
        plain, quick = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (java(pattern, flags), M.begun(name, pattern, flags)))
        assert rows.where(plain != quick).count() == 0, name
        assert rows.where(F.size(plain) > 0).count() > 0, name


def test_word_count_needs_no_lower_case(spark):
    rows = spark.createDataFrame([(t,) for t in [*made(), *map(chr, range(0x20, 0x2200))]], "text string")
    assert rows.where(T.n_words(F.col("text")) != F.size(T.words(F.col("text")))).count() == 0


def test_sentences_with_and_without_places_that_do_not_end_one(spark):
    cases = {
        "One two. Three four! Five?": ["One two.", "Three four!", "Five?"],
        "See e.g. the one. No. 5 is it.": ["See e.g. the one.", "No. 5 is it."],
        "By J. Doe et al. then we left. 1. a": ["By J. Doe et al. then we left.", "1. a"],
        "# Head\nOne two. A": ["\nOne two."],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select("text", S.sentences(F.col("text")).alias("s"))
    assert {r.text: r.s for r in rows.collect()} == cases


def test_shares_read_only_the_markers_they_tell_of(spark, sf_dir):
    found = measure_plans.signals(measure_plans.arms(spark, sf_dir), [M.BY_ID[x] for x in measure_plans.WHOLE])
    assert {len(r.marks) for r in found.select("marks").limit(50).collect()} == {len(measure_plans.WHOLE)}
