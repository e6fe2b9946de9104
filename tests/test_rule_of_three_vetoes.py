"""Lists that the vetoes of the reference's pattern leave out or let begin later; RE2 cannot say them, so the SQL counts these otherwise."""

from pyspark.sql import functions as F

from inkmeter.functions import markers as M


def test_vetoes(spark):
    cases = {"one sees the, with or two.": 0, "ednd, and and onhethntston": 1, "apples, pears and plums": 1, "apples, pears or not": 0}
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r[0]: r[1] for r in rows.select("text", M.BY_ID["rule_of_three"].count(F.col("text"))).collect()} == cases
