"""Checks that look at less of a text first, against their plain forms; counts that are read once."""

import random

from pyspark.sql import functions as F

from inkmeter.functions import clean as C
from inkmeter.functions import titles
from inkmeter.functions import tokens as T
from inkmeter.functions.dialect import java
from inkmeter.operators import overlap
from inkmeter.plans import pair_plans

PARTS = [
    "I'm an AI,", "As an AI language model,", "i am a chatbot", "I must advise against", "I 'd caution against", "I would advise against", "Here's a post", "here's a possible reddit post:", "here is an example of an abstract", "this abstract would likely describe", "The paper would probably",
    "is an academic paper", "an academic study titled “", 'the paper "', ". Title :", "; Body:", "Abstract:", "ABSTRACT :", "xAbstract:", "( note :", "I hope this meets", "Let me know if you'd like me to", "feel free to edit it", "word", "there", "a", " ", "\n", "　", ".", ")", ":)", "(a", "“", '"b',
]


def made(n=500):
    rnd = random.Random(11)
    return ["", *PARTS, *(" ".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 25))) for _ in range(n))]


def test_beginnings_change_no_rule(spark):
    rows = spark.createDataFrame([(t,) for t in made()], "text string")
    for i, begin in C.META_BEGINS.items():
        _, _, pattern, flags = C.META[i]
        plain, quick = (F.regexp_extract_all("text", F.lit(java(p, flags)), F.lit(0)) for p in (pattern, f"{begin}(?:{pattern})"))
        assert rows.where(plain != quick).count() == 0, i
        assert rows.where(F.size(plain) > 0).count() > 0, i


def test_caps_and_loops_of_long_texts(spark):
    loop = "a b c " * 5
    texts = ["x " * 465, "x " * 475, "é " * 20_000, "abcdefgh " * 10_000, "w" * 1300, " " * 30_000 + "x " * 471, "a" * 900, "word " * 9_000 + loop, loop + "q" * 5_000, "a b c " * 9 + "long" * 900, "ab " * 12 + " " * 4_000]
    rows = spark.createDataFrame([(t, m) for t in texts for m in ("gpt4", "llama3", "claude", "x")], "text string, model string")
    got = rows.select("text", "model", C.reaches_cap(F.col("text"), F.col("model")).alias("quick"), (T.approx_tokens(F.col("text")) >= C.cap(F.col("model"))).alias("plain"), C.ends_in_loop(F.col("text")).alias("loop")).collect()
    assert all(r.quick == r.plain for r in got) and {r.quick for r in got} == {True, False}
    loops = {r.text: r.loop for r in got}
    assert [loops[t] for t in texts[7:]] == [True] * 4 and not loops["w" * 1300] and not loops["a" * 900]


def test_trigrams_as_hashes(spark):
    rnd = random.Random(3)
    say = lambda: " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
    rows = spark.createDataFrame([(say(), say()) for _ in range(300)], "a string, b string")
    plain = titles.trigram_share(F.split("a", " "), F.split("b", " "))
    quick = titles.share_held(*(overlap.hashed(F.split(c, " "), 3) for c in "ab"))
    assert rows.where(plain != quick).count() == 0 and rows.where(plain > 0).count() > 0


def test_weighted_median_and_runs(spark):
    rows = spark.createDataFrame([("s", 1, 3), ("s", 5, 2), ("s", 9, 2), ("t", 4, 1), ("t", 6, 1)], "g string, n int, c long")
    plain = rows.select("g", "n", F.explode(F.sequence(F.lit(1), "c")))
    assert sorted(pair_plans.upper_median(rows, "g", "n", F.col("c")).collect()) == sorted(pair_plans.upper_median(plain, "g", "n").collect())
    texts = spark.createDataFrame([(t,) for t in [*made(50), "　a\xa0b﻿"]], "text string")
    assert texts.where(T.n_runs(F.col("text")) != F.size(T.runs(F.col("text")))).count() == 0
