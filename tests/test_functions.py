"""Golden strings through the column functions."""

import pytest
from pyspark.sql import functions as F

from inkmeter.functions import clean, normalize, stats, tokens
from inkmeter.functions.markers import BY_ID, MARKERS
from inkmeter.functions.sentences import sentences


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_catalogue():
    assert len(MARKERS) == 25 and sum(m.count is not None for m in MARKERS) == 17


@pytest.mark.parametrize(
    "marker, text, n",
    [
        ("delve", "We delve, delving deeper; they Delved.", 3),
        ("realm", "réalms realmé realms", 2),
        ("leverage", "We leverage it. They have leverage. Leveraging 10x leverage, leveraged trades.", 2),
        ("in_conclusion", "In conclusion we stop. To sum up, we stop. To sum up over all.", 2),
        ("em_dash", "a word - another one — and more\n- item\n---\nCalabi--Yau", 2),
        ("not_only_but_also", "It is not only fast, e.g. here, but it is also cheap.", 1),
        ("not_x_its_y", "It's not a bug, it's a feature. This isn't luck; this is skill.", 2),
        ("rule_of_three", "apples, pears and plums. However, forward and backward. In 1989, Smith and Lee.", 1),
        ("important_to_note", "it is also important to note; it's worth noting", 2),
    ],
)
def test_counts(spark, marker, text, n):
    assert one(spark, text, BY_ID[marker].count) == n


@pytest.mark.parametrize(
    "marker, text, hit",
    [
        ("no_contraction", "The model's van't Hoff law.", True),
        ("no_contraction", "dont go", False),
        ("no_contraction", 'He said "I can\'t".', True),
        ("no_first_person", "Type I and the $I$ index i.", True),
        ("no_first_person", "So I think.", False),
        ("bulleted_bold", "x\n- **lead** in", True),
        ("title_case_headings", "## Two Words\ntext", True),
        ("title_case_headings", "## One\nWord", False),
        ("no_typo_markers", "gonna", False),
    ],
)
def test_flags(spark, marker, text, hit):
    assert one(spark, text, BY_ID[marker].test) is hit


def test_sentences(spark):
    text = "We saw E. coli grow, e.g. here. No. 3 won. It ended\n\nNew part\n- one\n- two"
    assert one(spark, text, sentences) == ["We saw E. coli grow, e.g. here.", "No. 3 won.", "It ended", "New part", "- one", "- two"]


@pytest.mark.parametrize(
    "text, model, cut, ending",
    [
        ("All is well.", "gpt4", False, "stop"),
        ("and then,", "gpt4", True, None),
        ("Thanks for reading, Sam", "gpt4", False, "signature"),
        ("Done it. Best, Sam", "gpt4", False, "signature"),
        ("great #fun", "gpt4", False, "symbol"),
        ("one two " * 8, "gpt4", True, None),
        ("Mixed it. 2.", "gpt4", True, "stop"),
        ("", "gpt4", True, None),
    ],
)
def test_truncation(spark, text, model, cut, ending):
    row = spark.createDataFrame([(text, model)], "t string, m string").select(clean.is_truncated(F.col("t"), F.col("m")), clean.finished_ending(F.col("t"))).first()
    assert tuple(row) == (cut, ending)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("I cannot provide a response to that.", "refusal"),
        ("As an AI, I refuse.", "assistant"),
        ("Sure, here's a possible Reddit post:", "preamble"),
        ("Body: it began", "label"),
        ("Yours [Your Name]", "placeholder"),
        ("It rained all day.", None),
        ("Dear sir. Done.\nSincerely,\n[Your Name]", None),
    ],
)
def test_meta(spark, text, kind):
    assert one(spark, text, clean.meta_kind) == kind


def test_english(spark):
    assert one(spark, "the cat and the dog", clean.english_share) == pytest.approx(0.6)
    assert one(spark, "1 2 3", clean.english_share) == 0


def test_wraps(spark):
    for width in (20, 40, 60):
        words, lines, line = ("alpha beta, gamma delta and epsilon zeta " * 5).split(), [], ""
        for w in words:
            if len(line) + len(w) > width:
                lines.append(line.strip())
                line = ""
            line += w + " "
        assert one(spark, "\n".join([*lines, line.strip()]), normalize.join_wraps) == " ".join(words)
    assert one(spark, "List:\n- a\nb\n- c\n\nEnd", normalize.join_wraps) == "List:\n- a b\n- c\n\nEnd"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a <b>b</b>&mdash;c</p><ul><li>x</li><li><p>y</p></li></ul>", "a **b**—c\n\n- x\n- y"),
        ("<ol><li>x<li>y</ol><h2>T</h2>z", "1. x\n2. y\n\n## T\nz"),
        ("<blockquote>q<blockquote>r</blockquote></blockquote>own <pre>code</pre>him--he", "own\nhim—he"),
        ("&amp;lt; &#150; &#x2F; &zz;", "&lt; – / &zz;"),
    ],
)
def test_html(html, text):
    assert normalize.html_text(html) == text


def test_poisson():
    for k, lo, hi in ((0, 0, 3.688879), (1, 0.025318, 5.571643), (5, 1.623486, 11.668332), (10, 4.795389, 18.390356)):
        assert stats.poisson_interval(k) == (pytest.approx(lo, abs=1e-6), pytest.approx(hi, abs=1e-6))


def test_conditional():
    for x, wx, y, wy, p in ((1, 2000, 0, 270000, 7.35e-3), (2, 2000, 3, 270000, 5.33e-4), (3, 11000, 10, 270000, 1.28e-2), (5, 164000, 0, 270000, 7.70e-3)):
        assert stats.conditional_test([x], [x + y], [wx / (wx + wy)], 1)[0] == pytest.approx(p, rel=5e-3)


def test_bins(spark):
    rows = spark.createDataFrame([(x,) for x in (79, 80, 129, 130, 400, 800, 801)], "n long").select(tokens.length_bin(F.col("n"))).collect()
    assert [r[0] for r in rows] == [-1, 0, 0, 1, 3, 3, -1]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>&gt; they said so</p><p>I say no</p>", "I say no"),
        ("one<br>&gt; theirs\nmine", "one\nmine"),
        ("I do not agree.<p>&gt; typed by them\nBut I typed this.<p><i>&gt; also theirs</i><p>End.", "I do not agree.\n\nBut I typed this.\n\nEnd."),
        ("<p>&gt; Their line goes\n  on and\n  on.\nMine.", "Mine."),
        ("<p>From 3 to &gt;9 of them.", "From 3 to >9 of them."),
        ("<p>never <code>closed stays", "never closed stays"),
        ("<blockquote><pre>x</blockquote>after", "after"),
        ("<pre>a</pre>b<PRE>c</PRE >d", "b\nd"),
        ("<blockquote>a<blockquote>b</blockquote>c</blockquote>d", "d"),
        ("a<b> bold </b>c", "a **bold** c"),
        ("<b>x <i>y </i></b>z", "**x y **z"),
        ("<!-- <p>x --><p>y", "y"),
        ("&amp;lt; &#151; &#x41; &#0; &nope;", "&lt; — A � &nope;"),
        (None, None),
        ("", ""),
    ],
)
def test_html_of_others(html, text):
    assert normalize.html_text(html) == text


def test_sentences_around():
    import re

    from inkmeter.functions.sentences import matches_in_sentences

    near = lambda text, word: matches_in_sentences(text, re.compile(word, re.A | re.I))
    assert near("One. Two  words\there! Three", r"\bwords\b") == ["Two words here!"]
    assert near("words\nmore words", "words") == ["words", "more words"]
    long = "a" * 300 + " word " + "b" * 300 + ". End"
    got = near(long, r"\bword\b")
    assert len(got) == 1 and got[0][0] == got[0][-1] == "…" and " word " in got[0] and len(got[0]) == 242
    assert near("word " + "b" * 300, r"\bword\b") == ["word " + "b" * 235 + "…"]
    assert near("", "x") == []


@pytest.mark.parametrize("a, p, x", [(1.0, 0.025, 0.0253178), (10.0, 0.025, 4.795389), (11.0, 0.975, 18.39036), (0.5, 0.5, 0.2274682), (1000.0, 0.975, 1062.93)])
def test_gamma_quantile(a, p, x):
    got = stats.gamma_quantile(a, p)
    assert got == pytest.approx(x, rel=1e-5) and stats.gamma_p(a, got) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("p", [0.9, 0.5, 0.05, 0.04, 1e-3, 1e-9, 1e-40, 1e-250])
def test_deviate(p):
    assert stats.tail(stats.deviate(p)) == pytest.approx(p, rel=1e-9)
    assert stats.deviate(1.0) == 0 and 38 < stats.deviate(0.0) < 39


def test_words_that_matches_hold(spark):
    """The search for plain strings never hides a match."""
    from inkmeter.functions.markers import COUNTABLE, readable

    texts = [
        "It is (also) worth noting. It's IMPORTANT to note.", "IN TODAY’S world; in todays", "not only but also; NOT ONLY x but y also", "this isnt luck — this is; That's not only a b, it's", "let us explore; Dive into; let's take a look",
        "To sum things up, In sum: in summary to conclude, to summarise:", "a -- b --- c—d on - the  - x – y (ab) - \"x", "one, two and three. A, b c d, or e. x, y, and z", "Delving tapestries MOREOVER Furthermore crucially realms showcased underscoring leverage",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for m in COUNTABLE:
        got = df.select(m.count(F.col("t")), F.regexp_count(readable(F.col("t")), F.lit(m.pattern))).collect()
        assert [r[0] for r in got] == [r[1] for r in got], m.id


def test_cleaning_by_writer(spark):
    from inkmeter.plans.clean_plans import cleaned_by_writer

    fine = "this is a text of the kind that people write and it ends as it should end. " * 3
    rows = [
        ("person", 1, fine, None, None), ("person", 2, fine, None, None), ("gpt4", 1, fine, "gpt4", 0.1), ("gpt4", 2, fine, "gpt4", 0.1), ("gpt4", 3, "Sure, here's a possible post: " + fine, "gpt4", 0.1),
        ("gpt4", 4, fine, "gpt4", 0.6), ("gpt4", 5, fine, "gpt4", None), ("claude", 3, "Sure, here's a possible post: " + fine, "claude", 0.5), ("claude", 6, "ein Text in einer anderen Sprache ohne jedes Wort", "claude", 0.0), ("person", 6, fine, None, None),
    ]
    df = spark.createDataFrame(rows, "writer string, doc long, text string, model string, containment double")
    got = {r.writer: tuple(r)[1:] for r in cleaned_by_writer(df, spark.createDataFrame([(2,)], "doc long")).collect()}
    # texts, date, language, truncated, meta, remembered, unchecked, kept
    assert got == {"person": (3, 1, 1, 0, 0, 0, 0, 1), "gpt4": (5, 1, 0, 0, 1, 1, 1, 2), "claude": (2, 0, 1, 0, 0, 0, 0, 1)}


def test_empty_item_keeps_its_line():
    assert normalize.html_text("<ul><li></li></ul><p>x</p>") == "-\n\nx"
    assert normalize.html_text("<ol><li> <p><b>First</b> step</p></li><li><p>Second</p></li></ol>") == "1. **First** step\n\n2. Second"


def test_beginnings_hide_no_match(spark):
    import random

    from inkmeter.functions import markers
    from inkmeter.functions.dialect import java

    rnd = random.Random(1)
    words = ["apples", "However", "January", "12", "1999", "with", "one", "and", "or", "not", "we", "is", "x", "pears", "so", "then", "é", "more"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", ", ", ",", " ,", ". ", "\n"]) for _ in range(rnd.randint(3, 14))) for _ in range(8000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(BY_ID["rule_of_three"].count(F.col("t")).alias("a"), F.regexp_count("t", F.lit(java(markers.RULE_OF_THREE))).alias("b"))
    assert df.where("a <> b").count() == 0 and df.where("b > 0").count() > 20
