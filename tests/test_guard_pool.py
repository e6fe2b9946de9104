"""The whole-text guard against a plain version, and that it does not deal the machine's grams over the cluster."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from inkmeter.functions.dialect import java
from inkmeter.operators import evidence


def grams(text):
    w = re.findall("[a-z0-9']+", (text or "").lower())
    return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}


def test_one_persons_words(spark):
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("ab") for _ in range(n))
    people = [(i, say(11)) for i in range(25)] + [(90, None)]
    given = [(say(10),) for _ in range(8)]
    machine = [(i, say(10)) for i in range(120)] + [(500, None), (501, "a b")]
    got = evidence.one_persons_words(*(spark.createDataFrame(r, s) for r, s in ((machine, "id long, text string"), (people, "id long, text string"), (given, "text string"))))
    held = Counter(g for _, t in people for g in grams(t))
    asked = {g for g, n in held.items() if n == 1} - {g for (t,) in given for g in grams(t)}
    want = {i for i, t in machine if grams(t) & asked}
    assert {r.id for r in got.collect()} == want and 0 < len(want) < len(machine)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_sensitive_words_begin_where_they_are_looked_for(spark):
    words = re.sub(r"\\b|\(\?:|\)|\\w\*|\(|\?", "|", evidence.SENSITIVE).split("|")
    texts = [x for w in words if w for x in (w, f"x{w}", f"é{w.upper()}", f"a {w}ed.", f"-{w}s")] + ["Drugs", "he was arrested", "RAPE", "drape", "meth", "method", "self harm", "end my own life", "eating disorder"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.col("text").rlike(java(evidence.SENSITIVE, "i"))
    assert rows.where(plain != evidence.is_sensitive(F.col("text"))).count() == 0 and rows.where(plain).count() > 20
