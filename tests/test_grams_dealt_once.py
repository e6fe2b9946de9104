"""Grams of one source are made and dealt once; unique grams are dealt before they are added up."""

from inkmeter.operators import overlap


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_among(spark):
    rows = spark.createDataFrame([(1, "s", "a b c d"), (2, "s", "b c d e"), (3, "t", "a b c d"), (4, None, "a b c d"), (5, None, "a b c d"), (6, "s", None), (7, "t", "a b c d")], "id long, source string, text string")
    got = overlap.among(rows, 3, "source")
    assert {r.id: (r.grams, r.shared) for r in got.collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 2), 4: (2, 0), 5: (2, 0), 6: (0, 0), 7: (2, 2)}
    assert plan(got).split("== Initial Plan ==")[-1].count("Generate") == 1


def test_unique_grams(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "b c d e"), (3, "b c d e"), (4, None)], "id long, text string")
    got = overlap.unique_grams(rows, 3)
    assert [r.id for r in got.collect()] == [1]
    before, _, _ = plan(got).split("== Initial Plan ==")[-1].rpartition("Exchange")
    assert before.count("HashAggregate") == 2  # both steps of the sum stand after the exchange
