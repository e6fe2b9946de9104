"""Matching, guards, panels, work lists, placeholders and the older draws."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from inkmeter.functions import placeholders, titles
from inkmeter.operators import draws, evidence, matching, worklist


@pytest.mark.parametrize(
    "text, out, n",
    [
        ("Dear STUDENT_NAME, hello", "Dear , hello", 1),
        ("a TEACHER_NAMEif you", "a if you", 1),
        ("to SCHOOL_NAMEs  and on", "to and on", 1),
        ("the COMMUNITY_SERVICE and Distracted_Driving stay", "the COMMUNITY_SERVICE and Distracted_Driving stay", 0),
        ("andGeneric_Name too", "and too", 1),
        ("Generic_name, GENERIC_NAME and PROEPR_NAME", ", and", 3),
        ("X_STUDENT_NAME  two  blanks", "X_STUDENT_NAME  two  blanks", 0),
        ("one\n STREET_ADDRESS \ntwo", "one\n\ntwo", 1),
        ("id_Generic_Name x9A_B", "id_Generic_Name x9A_B", 0),
        ("", "", 0),
        (None, None, 0),
    ],
)
def test_placeholders(text, out, n):
    assert placeholders.stripped(text) == (out, n)


def test_placeholder_columns(spark):
    df = spark.createDataFrame([("Dear STUDENT_NAME of COMMUNITY_SERVICE",), (None,)], "t string")
    rows = df.select(placeholders.strip_placeholders("t").alias("s"), placeholders.scanned_tokens("t").alias("x")).collect()
    assert (rows[0].s.text, rows[0].s.removed) == ("Dear of COMMUNITY_SERVICE", 1)
    assert [(x.token, x.removed) for x in rows[0].x] == [("STUDENT_NAME", True), ("COMMUNITY_SERVICE", False)] and rows[1].x == []


def plain_numbers(seed):
    """The generator in whole numbers, cut to 32 bits after every step."""
    cut = lambda x: x % 2**32
    a = cut(seed)
    while True:
        a = cut(a + 0x6D2B79F5)
        t = cut((a ^ a >> 15) * (a | 1))
        t = cut(t ^ cut(t + cut((t ^ t >> 7) * (t | 61))))
        yield (t ^ t >> 14) / 2**32


@pytest.mark.parametrize("seed", [0, 1, 20260916, 2**32 - 1, 2**33 + 5])
def test_older_draws(seed):
    plain = plain_numbers(seed)
    assert draws.numbers(seed, 50).tolist() == [next(plain) for _ in range(50)]
    plain, items = plain_numbers(seed), list(range(40))
    for i in range(39, 0, -1):
        j = int(next(plain) * (i + 1))
        items[i], items[j] = items[j], items[i]
    assert draws.order(40, seed).tolist() == items and draws.order(0, seed).tolist() == [] and draws.order(1, seed).tolist() == [0]
    assert draws.bin_seed(seed, 2, 1) == (seed + 6 * 0x9E3779B1) % 2**32 and draws.placebo_seed(seed) == (seed + 9 * 0x9E3779B1) % 2**32


def test_group_seed_and_shuffle(spark):
    assert draws.group_seed(0, "") == 0x811C9DC5 and draws.group_seed(0, "a") == 0xE40C292C  # published values of the hash
    rows = spark.createDataFrame([(g, i) for g in "xy" for i in range(12)], "g string, i long").repartition(3)
    got = {(r.g, r["rank"]): r.i for r in draws.shuffled(rows, "g", "i", 7).collect()}
    for g in "xy":
        assert [got[g, k] for k in range(12)] == draws.order(12, draws.group_seed(7, g)).tolist()
    assert draws.sampled(rows, "g", "i", 3, 7).count() == 6


def test_echo_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        x, y = (" ".join(s.lower().split()) for s in (a, b))
        runs = [x[i:j] for i in range(len(x)) for j in range(i + 3, len(x) + 1) if x[i:j] in y]
        best = max(map(len, runs), default=0)
        got = worklist.longest_echo(a, b, 3)
        assert (got is None) if best < 3 else (got[0] == best and got[1] == next(r for r in runs if len(r) == best))
    assert worklist.longest_echo("X " * 200, "x " * 200)[0] == 399 and worklist.longest_echo(None, "x") is None


def test_work_list(spark):
    cells = spark.createDataFrame([("a", 8, 2), ("b", 11, 1), ("c", 9, 0)], "slug string, grade int, slots long")
    rows = worklist.slots(cells, ["m1", "m2"], F.md5(F.concat_ws("/", "slug", "n"))).collect()
    assert sorted(r.id for r in rows) == ["m1.a.g8.001", "m1.a.g8.002", "m1.b.g11.001", "m2.a.g8.001", "m2.a.g8.002", "m2.b.g11.001"]
    order = {arm: [r.slug + str(r.n) for r in sorted(rows, key=lambda r: r["index"]) if r.arm == arm] for arm in ("m1", "m2")}
    assert order["m1"] == order["m2"] and sorted(r["index"] for r in rows) == [0, 0, 1, 1, 2, 2]
    prompt = spark.range(1).select(worklist.prompt_for(F.lit("Grade {grade}: {assignment}"), F.lit(8), F.lit("costs $1 and $&"))).first()[0]
    assert prompt == "Grade 8: costs $1 and $&"


def test_problems(spark):
    text = "word " * 60
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assignment = "write a letter to the principal about " + "phones " * 60
    good = ("s1", "m", "model", "p", assignment, "s1", "m", "model", text, "p", sha("p"), sha(text.strip()), None, "t", "c")
    names = "id string, arm string, wanted_model string, wanted_prompt string, assignment string, slot string, file_arm string, model string, text string, prompt string, prompt_sha256 string, text_sha256 string, error string, generated_at string, context_id string"
    bad = ("s2", "m", "model", "p", assignment, "sX", "mX", "other", " ", "q", "z", "z", "oops", "", None)
    short = ("s3", "m", "model", "p", assignment, "s3", "m", None, "word " * 5, None, None, None, None, "t", "c")
    copied = ("s4", "m", "model", "p", assignment, "s4", "m", None, "So " + assignment, None, None, None, None, "t", "c")
    df = spark.createDataFrame([good, bad, short, copied], names)
    got = {r.id: r.problems for r in worklist.problems(df).collect()}
    assert got["s1"] == [] and got["s3"] == ["too short"] and got["s4"] == ["carries the assignment"]
    assert got["s2"] == ["another slot", "another arm", "an error was recorded", "another prompt", "another prompt's hash", "empty", "another text's hash", "another model", "no time", "no context"]
    kept = worklist.recorded(df.where("id = 's1'"))
    assert kept.first().text_sha256 == sha(text.strip()) and worklist.manifest(kept).first().digest == sha(sha(text.strip()))
    assert df.select(worklist.letter_asked(F.col("assignment"))).first()[0]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_titles(spark):
    words = lambda s: F.array(*map(F.lit, s.split()))
    assert one(spark, titles.trigram_share(words("a b c d"), words("x a b c"))) == 0.5
    assert one(spark, titles.trigram_share(words("a b"), words("a b c"))) == 0.0
    assert one(spark, titles.dice(words("a b b"), words("b c"))) == 0.5
    assert one(spark, titles.title_terms(F.lit("On the Self-Attention of (Deep) Networks: a naïve ViT 101"))) == ["attention", "networks", "deep", "self", "101", "vit"]
    text = "In this paper we propose a novel method. Quantised turbulence cascades through superfluid helium vortices near boundaries, and more."
    assert one(spark, titles.abstract_phrase(F.lit(text))) == "turbulence cascades through superfluid helium vortices near boundaries"
    assert one(spark, titles.abstract_phrase(F.lit("We show it is so. $x$ and y-z"))) is None


def test_pick_match(spark):
    text = " ".join(f"w{i}" for i in range(60))
    half = " ".join(f"w{i}" for i in range(25)) + " " + " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "A Title", text), (2, "Old name of it", text), (3, "Old name of it", text), (4, "B", None), (5, "C", text)], "doc long, title string, text string")
    entries = spark.createDataFrame([(10, "a  title!", "zzz"), (11, "Á title", text), (20, "New name of it", half), (30, "other words", half), (31, "other words", text), (40, "Nope", text), (50, "D", "w0 w1")], "entry long, title string, summary string")
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (3, 31), (4, 40), (5, 50)], "doc long, entry long")
    scored = matching.scored(docs, entries, pairs)
    got = {r.doc: (r.entry, r.how) for r in matching.pick_match(scored).collect()}
    assert got == {1: (11, "title"), 2: (20, "title+abstract"), 3: (31, "abstract")}
    versions = spark.createDataFrame([(40, 2), (50, 3), (30, 2)], "entry long, version int")
    assert matching.near_misses(scored, versions).collect() == []


def test_guard_and_panel(spark):
    run = "one two three four five six seven eight"
    people = spark.createDataFrame([(1, f"x {run} y"), (2, "nine ten eleven twelve a b c d"), (3, "nine ten eleven twelve a b c d too")], "id long, text string")
    machine = spark.createDataFrame([(10, f"so {run}"), (11, "nine ten eleven twelve a b c d"), (12, "given words that the teacher wrote for all of them"), (13, None)], "id long, text string")
    given = spark.createDataFrame([("given words that the teacher wrote for all",)], "text string")
    more = people.union(spark.createDataFrame([(4, "given words that the teacher wrote for all")], people.schema))
    assert [r.id for r in evidence.one_persons_words(machine, more, given).collect()] == [10]
    rows = [(a, d, "text") for a in ("m1", "m2") for d in range(9)] + [("m1", 20, "text"), ("m3", 3, "He was ARRESTED.")]
    df = spark.createDataFrame([(a, d, "an overdose" if (a, d) == ("m2", 4) else t) for a, d, t in rows], "arm string, doc long, text string")
    got = evidence.panel(df, ["m1", "m2"], spark.createDataFrame([(5,)], "doc long"), F.lpad(F.col("doc").cast("string"), 3, "0")).collect()
    assert [(r.doc, r["rank"]) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 4), (6, 5), (7, 6)]


def test_level_draw(spark):
    rows = [
        ("lead", 1, "a", 8, 0), ("lead", 2, "a", 8, 1), ("other", 3, "a", 8, 1), ("other", 4, "a", 8, 1),  # level 1: 2 with 3
        ("lead", 5, "b", 8, -1), ("other", 6, "b", 8, -1),  # no bin: by grade
        ("lead", 7, "c", 8, 0), ("other", 8, "c", 9, 0),  # assignment only
        ("lead", 9, "d", 8, 0),  # one writer alone
    ]
    df = spark.createDataFrame(rows, "arm string, id long, grp string, grade int, bin int")
    got = sorted((r.grp, r.matched, r.arm, r.id) for r in evidence.level_draw(df, "lead", ["other"], F.lpad(F.col("id").cast("string"), 3, "0")).collect())
    assert got == [("a", "grade and length", "lead", 2), ("a", "grade and length", "other", 3), ("b", "grade", "lead", 5), ("b", "grade", "other", 6), ("c", "assignment only", "lead", 7), ("c", "assignment only", "other", 8)]
    assert one(spark, evidence.grade_of(F.lit("arm.slug.g11.003"))) == 11 and one(spark, evidence.grade_of(F.lit("x"))) is None


def test_shown_spans(spark):
    from inkmeter.plans.evidence_plans import shown_spans

    df = spark.createDataFrame([("We delve, Moreover we delved.",)], "t string")
    got = df.select(shown_spans(F.col("t"), F.lower("t"), ["moreover", "delve"]).alias("s")).first().s
    assert [(x.start, x.end, x.marker) for x in got] == [(3, 8, "delve"), (10, 18, "moreover"), (22, 28, "delve")]
