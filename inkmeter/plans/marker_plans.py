"""Marker counts, shares, rates, tests and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import markers as M
from ..functions import stats as S
from ..session import cut
from .base import TEXTS_SQL, quoted, round6, texts

SIMPLE = [*M.WORDS, "important_to_note", "in_todays", "dive_into"]
HARD = ["leverage", "not_only_but_also", "not_x_its_y", "in_conclusion", "em_dash", "rule_of_three"]
WHOLE = ["em_dash_heavy", "bulleted_bold", "no_contraction", "no_first_person", "no_personal_detail", "no_typo_markers", "title_case_headings"]


def counted(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """keep, marker, n: a row per text and marker; all patterns run in one pass over the text."""
    rows = rows.select(*keep, M.readable(F.col("text")).alias("_rt")).withColumn("_low", F.lower("_rt"))
    each = F.array(*(F.struct(F.lit(x).alias("marker"), M.BY_ID[x].counted(F.col("_rt"), F.col("_low")).alias("n")) for x in names))
    return rows.select(*keep, F.explode(each).alias("m")).select(*keep, "m.marker", "m.n")


def flagged(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(x).alias("marker"), M.BY_ID[x].test(F.col("text")).alias("hit")) for x in names))
    return rows.select(*keep, F.explode(each).alias("m")).select(*keep, "m.marker", "m.hit")


def _rates(rows: DataFrame, names: list[str]) -> DataFrame:
    got = counted(rows, names, ["arm", "n_words"]).groupBy("arm", "marker")
    got = got.agg(F.sum("n").alias("occurrences"), F.sum("n_words").alias("words"), F.count_if(F.col("n") > 0).alias("texts_with"))
    return got.withColumn("per1000", round6(1000 * F.col("occurrences") / F.col("words")))


def rates_of(names: list[str]):
    return lambda spark, sf_dir: _rates(texts(spark, sf_dir), names)


#: Counts in SQL; RE2 has no look-around, so vetoed contexts are counted and taken off.
THREE = r"\b\w+, \w+,? (?:and|or) \w+\b|\b\w+, \w+(?: \w+){1,3}, (?:and|or) \w+\b"
THREE_WIDE = r"^\w+, \w+(?: \w+)+, (?:and|or) "
THREE_VETO = r"^\w+, (?:\w+ )*(?:we|I|it|they|you|he|she|there|is|are|was|were|has|have|had|will|would|can|could|may|might|should|but|namely|via|say)(?: \w+)*, "


def count_sql(name: str) -> str:
    def n(pattern: str) -> str:
        return f"len(regexp_extract_all(rt, {quoted(pattern)}))"

    veto = r"(?i)\b(?:have|has|had|gain|gains|gained|its|their|his|her|our|your|my|high|low|statistical|financial|political|operating|much|real|no|of|the|a|some|any|more|less|enough|\d+x)\sleverage\b"
    after = r"\s+(?:trades?|buyouts?|loans?|positions?|etfs?|ratios?)\b"
    return {
        "leverage": f"{n(r'(?i)\bleverag(?:e|es|ing|ed)\b')} - {n(veto)} - {n(r'(?i)\bleverag(?:e|es|ing|ed)' + after)} + {n(veto[:-2] + after)}",
        "not_only_but_also": n(r"(?i)\bnot only\b(?:[^.!?]|\b(?:e\.g|i\.e|et al|vs|cf)\.){0,160}?\bbut(?: \w+){0,3}? also\b"),
        "not_x_its_y": n(r"(?i)\b(?:it|this|that)(?:['’]?s not| is not| isn['’]?t) (?:just |only |merely |simply )?[^.!?,;:]{2,40}?(?:[,;:]|\s?[—–]|\s-{1,3}|-{1,3}\s|---)\s*(?:it|this|that)(?:['’]?s| is)\b"),
        "in_conclusion": n(r"(?i)\b(?:in conclusion|in summary)\b") + " + " + n(r"(?i)\b(?:in sum|to sum (?:it |this |things |everything )?up|to summari[sz]e|to conclude)\s*[,:]"),
        "em_dash": n("—") + " + " + n(r"""(?:[A-Za-z'’][A-Za-z]|[.\w][)"'”’])[^\S\n][-–]\s[A-Za-z"“(]"""),
        "rule_of_three": f"len(list_filter(regexp_extract_all(rt, {quoted(THREE)}), lambda x: NOT (regexp_matches(x, {quoted(THREE_WIDE)}) AND regexp_matches(x, {quoted(THREE_VETO)}))))",
    }.get(name) or n("(?i)" + ({**M.WORDS, **M.PHRASES}[name]))


def counts_sql(names: list[str]) -> str:
    return ", ".join([f"{TEXTS_SQL}"] + [f"c AS ({' UNION ALL '.join(f'SELECT doc_id, arm, grp, bin, n_words, {quoted(x)} AS marker, ({count_sql(x)})::BIGINT AS n FROM f' for x in names)})"])


def rates_sql(names: list[str]) -> str:
    return f"""WITH {counts_sql(names)}
SELECT arm, marker, sum(n)::BIGINT AS occurrences, sum(n_words)::BIGINT AS words, count(*) FILTER (n > 0) AS texts_with,
       round(1000.0::DOUBLE * sum(n) / sum(n_words), 6) AS per1000 FROM c GROUP BY ALL"""


def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text markers: n, k and the Wilson interval per arm."""
    got = flagged(texts(spark, sf_dir), WHOLE, ["arm"]).groupBy("arm", "marker").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return got.select("arm", "marker", "n", "k", round6(lo).alias("lo"), round6(hi).alias("hi"))


OWN_SQL = """regexp_replace(rt, '"[^"]{0,300}"|“[^”]{0,300}”', ' ', 'g')"""
CONTRACTION_SQL = "(?i)" + M.CONTRACTION.replace("(?!van['’]t\\b)", "")
BARE_SQL = r"""(?i)(?:^|[^\pL\pN_\\"'’])(?:(?:do|does|did|is|are|was|were|has|have|had|could|would|should|must|need)nt|cant|youre|theyre|thats|whats|theres|(?:you|they|we)ve|(?:would|could|should|must)ve)(?:$|[^\pL\pN_'’])"""
BARE_I_SQL = r"""(?:^|[^\pL\pN_\\"'’])(?:(?:im|ive) [a-z]|(?:Im|Ive) (?:""" + M.AFTER_I + r""")(?:$|[^\pL\pN_]))"""
FLAG_SQL = {
    "em_dash_heavy": f"({count_sql('em_dash')}) >= 2",
    "bulleted_bold": r"regexp_matches(text, '(?m)^\s*[-*•]\s+\*\*')",
    "no_contraction": f"NOT (regexp_matches({OWN_SQL}, {quoted(CONTRACTION_SQL)}) OR regexp_matches({OWN_SQL}, {quoted(BARE_SQL)}) OR regexp_matches({OWN_SQL}, {quoted(BARE_I_SQL)}))",
    "no_first_person": rf"NOT (regexp_matches({OWN_SQL}, '(?:^|[^$\\{{/&\w-])I(?:[''’](?:m|ve|d|ll)|\s+(?:don|th|am|was))') OR regexp_matches({OWN_SQL}, '(?:^|\PL)(?:[Mm]y|[Mm]e|[Mm]yself|MY)(?:\PL|$)'))",
    "no_personal_detail": f"NOT regexp_matches({OWN_SQL}, {quoted('(?i)' + M.PERSONAL)})",
    "no_typo_markers": f"NOT regexp_matches(rt, {quoted('(?i)' + M.INFORMAL)})",
    "title_case_headings": f"regexp_matches(rt, {quoted('(?m)' + M.TITLE_HEADING)})",
}


def flags_sql(names: list[str]) -> str:
    return f"{TEXTS_SQL}, h AS ({' UNION ALL '.join(f'SELECT doc_id, arm, bin, {quoted(x)} AS marker, {FLAG_SQL[x]} AS hit FROM f' for x in names)})"


WILSON_SQL = """round(100 * (p + 1.96*1.96/(2*n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6) AS lo,
       round(100 * (p + 1.96*1.96/(2*n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6) AS hi"""
WHOLE_SQL = f"""WITH {flags_sql(WHOLE)}, g AS (SELECT arm, marker, count(*)::DOUBLE AS n, count(*) FILTER (hit)::DOUBLE AS k FROM h GROUP BY ALL), w AS (SELECT *, k / n AS p FROM g)
SELECT arm, marker, n::BIGINT AS n, k::BIGINT AS k, {WILSON_SQL} FROM w"""


def share_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts with each countable marker, with its interval, per arm."""
    got = counted(texts(spark, sf_dir), SIMPLE, ["arm"]).groupBy("arm", "marker").agg(F.count("*").alias("n"), F.count_if(F.col("n") > 0).alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return got.select("arm", "marker", "n", "k", round6(100 * F.col("k") / F.col("n")).alias("pct"), round6(lo).alias("lo"), round6(hi).alias("hi"))


SHARE_SQL = f"""WITH {counts_sql(SIMPLE)}, g AS (SELECT arm, marker, count(*)::DOUBLE AS n, count(*) FILTER (n > 0)::DOUBLE AS k FROM c GROUP BY ALL), w AS (SELECT *, k / n AS p FROM g)
SELECT arm, marker, n::BIGINT AS n, k::BIGINT AS k, round(100 * p, 6) AS pct, {WILSON_SQL} FROM w"""


def tallied(rows: DataFrame, names: list[str]) -> DataFrame:
    """arm, marker, stratum and sums over texts: all that rates, dispersions and tests need, from one pass.

    ``some`` and ``held`` are the texts with words and their occurrences,
    ``squares`` the sum of n * n / words. At most a row per arm, marker and
    length stratum, of which there are some hundred.
    """
    return summed(counted(rows, names, ["arm", "stratum", "n_words"]))


def summed(counts: DataFrame) -> DataFrame:
    """``tallied`` of counts that are there already (arm, marker, stratum, n_words, n)."""
    some, n, w = F.col("n_words") > 0, F.col("n"), F.col("n_words")
    got = counts.groupBy("arm", "marker", "stratum")
    square = n.cast("double") * n / F.nullif(w, F.lit(0))
    return got.agg(F.count("*").alias("texts"), F.count_if(some).alias("some"), F.sum(w).alias("words"), F.sum(n).alias("occurrences"), F.sum(F.when(some, n).otherwise(0)).alias("held"), F.coalesce(F.sum(square), F.lit(0.0)).alias("squares"))


def arm_rates(tallies: DataFrame) -> DataFrame:
    """arm, marker, texts, words, occurrences, dispersion: the whole arm's rate."""
    got = tallies.groupBy("arm", "marker").agg(*(F.sum(c).alias(c) for c in ("texts", "some", "words", "occurrences", "held", "squares")))
    return got.select("arm", "marker", "texts", "words", "occurrences", S.dispersion_of(*map(F.col, ("some", "words", "occurrences", "held", "squares"))).alias("dispersion"))


def rate_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = arm_rates(tallied(texts(spark, sf_dir), SIMPLE))
    return got.select("arm", "marker", "texts", "words", "occurrences", round6(F.col("dispersion")).alias("dispersion"))


DISPERSION_SQL = """CASE WHEN sum(n) > 0 AND sum(n_words) > 0 AND count(*) FILTER (n_words > 0) > 1 THEN greatest(1.0::DOUBLE,
  (sum(n::DOUBLE * n / nullif(n_words, 0)) * sum(n_words) / sum(n) - 2 * sum(n) FILTER (n_words > 0) + sum(n)::DOUBLE / sum(n_words) * sum(n_words)) / (count(*) FILTER (n_words > 0) - 1)) ELSE 1.0::DOUBLE END"""
RATE_SQL = f"""WITH {counts_sql(SIMPLE)} SELECT arm, marker, count(*) AS texts, sum(n_words)::BIGINT AS words, sum(n)::BIGINT AS occurrences, round({DISPERSION_SQL}, 6) AS dispersion FROM c GROUP BY ALL"""


def _two(rows: DataFrame, value: Column) -> DataFrame:
    """person against machine, per marker: k1 of n1 and k2 of n2."""
    side = lambda arm, c: F.sum(F.when(F.col("arm") == arm, c).otherwise(0))
    return rows.where("arm <> 'casual'").groupBy("marker").agg(
        side("person", value).alias("k1"), side("person", F.lit(1)).alias("n1"), side("machine", value).alias("k2"), side("machine", F.lit(1)).alias("n2")
    )


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two(counted(texts(spark, sf_dir), SIMPLE + HARD, ["arm"]), (F.col("n") > 0).cast("long"))
    return rows.withColumn("p", S.two_proportion_p(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2")))


def two_proportion_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions(spark, sf_dir).withColumn("p", round6(F.col("p")))


def benjamini_hochberg(rows: DataFrame, p: str, q: str, *family: str) -> DataFrame:
    """Adds ``q``: p adjusted within each family; null p stay null and do not count.

    Windows run over the rows of a table of tests, one per marker.
    """
    some = F.col(p).isNotNull()
    up = W.partitionBy(*family, some).orderBy(p, "marker")
    rows = rows.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count("*").over(W.partitionBy(*family, some)))
    down = W.partitionBy(*family, some).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(q, F.when(some, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down)))).drop("_r", "_m")


def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benjamini_hochberg(proportions(spark, sf_dir), "p", "q")
    return rows.select("marker", round6(F.col("p")).alias("p"), round6(F.col("q")).alias("q"))


TWO_SQL = f"""{counts_sql(SIMPLE + HARD)}, k AS (SELECT marker, count(*) FILTER (arm = 'person' AND n > 0) AS k1, count(*) FILTER (arm = 'person') AS n1,
  count(*) FILTER (arm = 'machine' AND n > 0) AS k2, count(*) FILTER (arm = 'machine') AS n2 FROM c GROUP BY marker),
z AS (SELECT *, (k1 + k2)::DOUBLE / (n1 + n2) AS p0, abs(k1::DOUBLE / n1 - k2::DOUBLE / n2) AS d FROM k),
s AS (SELECT *, sqrt(p0 * (1 - p0) * (1::DOUBLE / n1 + 1::DOUBLE / n2)) AS se FROM z),
x AS (SELECT *, d / nullif(se, 0) AS x, 1 / (1 + 0.2316419 * (d / nullif(se, 0))) AS t FROM s),
t AS (SELECT marker, k1, n1, k2, n2, CASE WHEN se = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * 0.3989423 * exp(-x * x / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))) END AS p FROM x)"""
TWO_PROPORTION_SQL = f"WITH {TWO_SQL} SELECT marker, k1, n1, k2, n2, round(p, 6) AS p FROM t"
BH_SQL = f"""WITH {TWO_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p, marker) AS r, count(*) OVER () AS m FROM t)
SELECT marker, round(p, 6) AS p, round(least(1.0::DOUBLE, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r"""


def strata(tallies: DataFrame, first: str = "person", second: str = "machine") -> DataFrame:
    """marker, stratum, x, n, p0: shared strata with words on both sides and an occurrence."""
    side = lambda arm, c: F.sum(F.when(F.col("arm") == arm, F.col(c)).otherwise(0))
    got = tallies.where(F.col("stratum").isNotNull() & F.col("arm").isin(first, second)).groupBy("marker", "stratum")
    got = got.agg(side(first, "occurrences").alias("ox"), side(first, "words").alias("wx"), side(second, "occurrences").alias("oy"), side(second, "words").alias("wy"))
    return got.where("wx > 0 and wy > 0 and ox + oy > 0").select("marker", "stratum", F.col("ox").alias("x"), (F.col("ox") + F.col("oy")).alias("n"), (F.col("wx") / (F.col("wx") + F.col("wy"))).alias("p0"))


def strata_observed_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = strata(tallied(texts(spark, sf_dir), SIMPLE)).groupBy("marker")
    return got.agg(F.count("*").alias("strata"), F.sum("x").alias("observed"), round6(F.sum(F.col("n") * F.col("p0"))).alias("expected"))


STRATA_SQL = f"""WITH {counts_sql(SIMPLE)}, g AS (SELECT marker, floor(ln(n_words) / ln(1.1))::BIGINT AS stratum, sum(n) FILTER (arm = 'person') AS ox, sum(n_words) FILTER (arm = 'person') AS wx,
  sum(n) FILTER (arm = 'machine') AS oy, sum(n_words) FILTER (arm = 'machine') AS wy FROM c WHERE n_words > 0 AND arm <> 'casual' GROUP BY ALL)
SELECT marker, count(*) AS strata, sum(ox)::BIGINT AS observed, round(sum((ox + oy) * (wx::DOUBLE / (wx + wy))), 6) AS expected FROM g WHERE wx > 0 AND wy > 0 AND ox + oy > 0 GROUP BY marker"""


def rate_tests(tallies: DataFrame, first: str = "person", second: str = "machine") -> DataFrame:
    """marker, p, observed, expected: the length-matched exact test of two arms' rates.

    p is null where an arm has no words. ``observed`` and ``expected`` are of the first arm.
    """
    both = arm_rates(tallies.where(F.col("arm").isin(first, second)))
    side = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    phi = S.pooled_dispersion(side(first, "dispersion"), side(first, "texts"), side(second, "dispersion"), side(second, "texts"))
    phi = both.groupBy("marker").agg(phi.alias("phi"), (F.coalesce(side(first, "words"), F.lit(0)) * F.coalesce(side(second, "words"), F.lit(0)) > 0).alias("any"))
    ordered = F.array_sort(F.collect_list(F.struct("stratum", "x", "n", "p0")))  # at most one row a stratum
    cells = strata(tallies, first, second).groupBy("marker").agg(ordered.alias("s"))
    got = phi.join(cells, "marker", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<stratum:bigint,x:bigint,n:bigint,p0:double>>")))
    got = got.withColumn("t", S.conditional_p(F.col("s.x"), F.col("s.n"), F.col("s.p0"), F.col("phi")))
    return got.select("marker", F.when(F.col("any"), F.col("t.p")).alias("p"), F.col("t.observed").alias("observed"), F.col("t.expected").alias("expected"))


def conditional_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rate_tests(cut(tallied(texts(spark, sf_dir), SIMPLE + HARD)))
    return got.select("marker", round6(F.col("p")).alias("p"), F.col("observed").cast("long").alias("observed"), round6(F.col("expected")).alias("expected"))


def tail_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * ({z})))"
    return f"least(1.0::DOUBLE, 2 * 0.3989423 * exp(-({z}) * ({z}) / 2) * {t} * (0.3193815 + {t} * (-0.3565638 + {t} * (1.781478 + {t} * (-1.821256 + {t} * 1.330274)))))"


#: The exact test in SQL: one stratum's distribution after the other is folded in, and the tail is inverted by halving.
TESTS_SQL = f"""dp AS MATERIALIZED (SELECT arm, marker, count(*) AS texts, sum(n_words)::DOUBLE AS words, sum(n)::DOUBLE AS occurrences, {DISPERSION_SQL} AS phi FROM c GROUP BY ALL),
ph AS (SELECT a.marker, greatest(1.0::DOUBLE, (a.phi * (a.texts - 1) + b.phi * (b.texts - 1)) / (a.texts + b.texts - 2)) AS phi, a.words * b.words > 0 AS any_ FROM dp a JOIN dp b ON a.marker = b.marker AND a.arm = 'person' AND b.arm = 'machine'),
st AS (SELECT marker, floor(ln(n_words) / ln(1.1))::BIGINT AS stratum, sum(n) FILTER (arm = 'person') AS ox, sum(n_words) FILTER (arm = 'person') AS wx, sum(n) FILTER (arm = 'machine') AS oy, sum(n_words) FILTER (arm = 'machine') AS wy
  FROM c WHERE n_words > 0 AND arm <> 'casual' GROUP BY ALL),
ce AS MATERIALIZED (SELECT marker, row_number() OVER (PARTITION BY marker ORDER BY stratum) AS k, ox::INT AS x, (ox + oy)::INT AS n, wx::DOUBLE / (wx + wy) AS p0 FROM st WHERE wx > 0 AND wy > 0 AND ox + oy > 0),
pm AS MATERIALIZED (SELECT marker, k, list_transform(range(0, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p0) + (n - j) * ln(1 - p0))) AS pmf FROM ce),
cv AS (SELECT marker, 0::BIGINT AS k, [1.0::DOUBLE] AS dist FROM ph UNION ALL
  SELECT cv.marker, cv.k + 1, list_transform(range(1, len(dist) + len(pmf)), lambda i: list_sum(list_transform(range(greatest(1, i - len(pmf) + 1), least(i, len(dist)) + 1), lambda j: dist[j] * pmf[i - j + 1]))) FROM cv JOIN pm ON pm.marker = cv.marker AND pm.k = cv.k + 1),
sm AS (SELECT ph.marker, ph.phi, ph.any_, coalesce(sum(x), 0)::BIGINT AS observed, coalesce(sum(n * p0), 0.0) AS expected, coalesce(sum(n), 0) AS total, coalesce(sum(n * p0 * (1 - p0)), 0.0) AS v FROM ph LEFT JOIN ce USING (marker) GROUP BY ALL),
ex AS (SELECT marker, least(1.0::DOUBLE, list_sum(list_filter(dist, lambda d: d <= dist[(observed + 1)::INT] * (1 + 1e-7)))) AS p FROM cv JOIN sm USING (marker) QUALIFY row_number() OVER (PARTITION BY marker ORDER BY k DESC) = 1),
iv AS (SELECT marker, p, 0.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, 0 AS i FROM ex WHERE p < 1 UNION ALL
  SELECT marker, p, CASE WHEN {tail_sql('(lo + hi) / 2')} > p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {tail_sql('(lo + hi) / 2')} > p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM iv WHERE i < 80),
ts AS MATERIALIZED (SELECT marker, observed, expected, CASE WHEN NOT any_ THEN NULL WHEN total = 0 THEN 1.0::DOUBLE WHEN total > {S.EXACT_LIMIT} THEN {tail_sql('greatest(0.0, abs(observed - expected) - 0.5) / sqrt(phi * v)')}
  WHEN phi > 1 THEN {tail_sql('coalesce(lo, 0.0) / sqrt(phi)')} ELSE ex.p END AS p FROM sm JOIN ex USING (marker) LEFT JOIN (SELECT marker, lo FROM iv WHERE i = 80) USING (marker))"""
CONDITIONAL_SQL = f"WITH RECURSIVE {counts_sql(SIMPLE + HARD)}, {TESTS_SQL} SELECT marker, round(p, 6) AS p, observed, round(expected, 6) AS expected FROM ts"


def bounded_rates(tallies: DataFrame) -> DataFrame:
    got = arm_rates(tallies).withColumn("b", S.poisson_bounds(F.col("occurrences") / F.col("dispersion")))
    scale = 1000 * F.col("dispersion") / F.nullif("words", F.lit(0))
    return got.select("arm", "marker", "texts", "words", "occurrences", "dispersion", (1000 * F.col("occurrences") / F.nullif("words", F.lit(0))).alias("per1000"), (scale * F.col("b.lo")).alias("lo"), (scale * F.col("b.hi")).alias("hi"))


def poisson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bounded_rates(tallied(texts(spark, sf_dir), SIMPLE))
    return got.select("arm", "marker", "texts", "words", "occurrences", *(round6(F.col(c)).alias(c) for c in ("dispersion", "per1000", "lo", "hi")))


#: Poisson bounds in SQL: the gamma function's lower part as a series, inverted by halving.
BOUNDS_SQL = """bt AS (SELECT arm, marker, a, target, side FROM (SELECT arm, marker, occurrences / phi AS k FROM dp), LATERAL (SELECT unnest([k, k + 1]) AS a, unnest([0.025, 0.975]) AS target, unnest(['lo', 'hi']) AS side)),
bq AS (SELECT *, 0.0::DOUBLE AS lo, 2 * a + 40 AS hi, 0 AS i FROM bt WHERE a > 0 UNION ALL
  SELECT arm, marker, a, target, side, CASE WHEN p < target THEN mid ELSE lo END, CASE WHEN p < target THEN hi ELSE mid END, i + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, (200 + 2 * hi)::INT), lambda n: exp((a + n) * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(a + n + 1)))) AS p FROM bq WHERE i < 60)),
bd AS MATERIALIZED (SELECT arm, marker, coalesce(max(lo) FILTER (side = 'lo'), 0.0) AS klo, max(lo) FILTER (side = 'hi') AS khi FROM bq WHERE i = 60 GROUP BY ALL),
rt_ AS MATERIALIZED (SELECT arm, marker, texts, words, occurrences, phi, 1000 * phi * klo / nullif(words, 0) AS lo, 1000 * phi * khi / nullif(words, 0) AS hi FROM dp LEFT JOIN bd USING (arm, marker))"""
POISSON_SQL = f"""WITH RECURSIVE {counts_sql(SIMPLE)}, dp AS MATERIALIZED (SELECT arm, marker, count(*) AS texts, sum(n_words)::DOUBLE AS words, sum(n)::DOUBLE AS occurrences, {DISPERSION_SQL} AS phi FROM c GROUP BY ALL), {BOUNDS_SQL}
SELECT arm, marker, texts, words::BIGINT AS words, occurrences::BIGINT AS occurrences, round(phi, 6) AS dispersion, round(1000 * occurrences / nullif(words, 0), 6) AS per1000, round(lo, 6) AS lo, round(hi, 6) AS hi FROM rt_"""


def rate_verdicts(tallies: DataFrame, tests: DataFrame) -> DataFrame:
    """marker, q, verdict of the countable markers of the machine arm, from tests with p adjusted to q."""
    rates = bounded_rates(tallies)
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    wide = rates.groupBy("marker").agg(pick("person", "lo").alias("plo"), pick("machine", "lo").alias("mlo"), pick("machine", "words").alias("mw"), pick("casual", "hi").alias("chi"), pick("casual", "words").alias("cw"))
    verdict = (
        F.when(F.coalesce("mw", F.lit(0)) == 0, "not recorded")
        .when((F.col("q") < S.SIGNIFICANCE) & (F.col("observed") < F.col("expected")), "machine marker")
        .when((F.col("q") < S.SIGNIFICANCE) & (F.col("observed") > F.col("expected")), "points the other way")
        .when((F.col("cw") > 0) & (F.col("plo") > F.col("chi")) & (F.col("mlo") > F.col("chi")), "register marker")
        .otherwise("no signal")
    )
    return tests.join(wide, "marker").select("marker", "q", verdict.alias("verdict"))


def verdict_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = cut(tallied(texts(spark, sf_dir), SIMPLE + HARD))
    return rate_verdicts(tallies, benjamini_hochberg(rate_tests(tallies), "p", "q")).withColumn("q", round6(F.col("q")))


VERDICT_RATE_SQL = f"""WITH RECURSIVE {counts_sql(SIMPLE + HARD)}, {TESTS_SQL}, {BOUNDS_SQL},
rk AS (SELECT *, row_number() OVER (ORDER BY p, marker) AS r, count(*) OVER () AS m FROM ts WHERE p IS NOT NULL),
qs AS (SELECT marker, least(1.0::DOUBLE, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM rk),
wd AS (SELECT marker, max(lo) FILTER (arm = 'person') AS plo, max(lo) FILTER (arm = 'machine') AS mlo, max(words) FILTER (arm = 'machine') AS mw, max(hi) FILTER (arm = 'casual') AS chi, max(words) FILTER (arm = 'casual') AS cw FROM rt_ GROUP BY marker)
SELECT marker, round(q, 6) AS q, CASE WHEN coalesce(mw, 0) = 0 THEN 'not recorded' WHEN q < 0.05 AND observed < expected THEN 'machine marker' WHEN q < 0.05 AND observed > expected THEN 'points the other way'
  WHEN cw > 0 AND plo > chi AND mlo > chi THEN 'register marker' ELSE 'no signal' END AS verdict FROM ts LEFT JOIN qs USING (marker) JOIN wd USING (marker)"""


def share_verdicts(shares: DataFrame) -> DataFrame:
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    wide = shares.groupBy("marker").agg(*(pick(a, c).alias(a[0] + c) for a in ("person", "machine", "casual") for c in ("n", "lo", "hi")))
    verdict = (
        F.when(F.coalesce("mn", F.lit(0)) == 0, "not recorded")
        .when(F.col("mlo") > F.col("phi"), "machine marker")
        .when(F.col("plo") > F.col("mhi"), "points the other way")
        .when((F.col("cn") > 0) & (F.col("plo") > F.col("chi")) & (F.col("mlo") > F.col("chi")), "register marker")
        .otherwise("no signal")
    )
    return wide.select("marker", verdict.alias("verdict"))


def verdict_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_verdicts(whole_text(spark, sf_dir))


VERDICT_CASE = """CASE WHEN mlo > phi THEN 'machine marker' WHEN plo > mhi THEN 'points the other way' WHEN cn > 0 AND plo > chi AND mlo > chi THEN 'register marker' ELSE 'no signal' END"""
VERDICT_SHARE_SQL = f"""WITH v AS ({WHOLE_SQL}), w AS (SELECT marker, max(lo) FILTER (arm = 'person') AS plo, max(hi) FILTER (arm = 'person') AS phi, max(lo) FILTER (arm = 'machine') AS mlo,
  max(hi) FILTER (arm = 'machine') AS mhi, max(hi) FILTER (arm = 'casual') AS chi, max(n) FILTER (arm = 'casual') AS cn FROM v GROUP BY marker)
SELECT marker, {VERDICT_CASE} AS verdict FROM w"""


def summary_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per verdict, how many whole-text markers have it."""
    return verdict_share(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("markers"))


SUMMARY_SQL = f"WITH s AS ({VERDICT_SHARE_SQL}) SELECT verdict, count(*) AS markers FROM s GROUP BY verdict"


def uniform_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per arm: texts with five sentences or more, and those of even sentence length."""
    from ..functions.sentences import sentence_length_cv

    rows = texts(spark, sf_dir).select("arm", sentence_length_cv(M.readable(F.col("text"))).alias("cv"))
    return rows.groupBy("arm").agg(F.count("cv").alias("n"), F.count_if(F.col("cv") < M.UNIFORM_BELOW).alias("k"))


def analyse(text_rows: DataFrame) -> DataFrame:
    """doc_id, marker, n: all countable markers of given texts (doc_id, text)."""
    return counted(text_rows, [m.id for m in M.COUNTABLE], ["doc_id"]).where("n > 0")


def analyse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(texts(spark, sf_dir))


ANALYSE_SQL = f"WITH {counts_sql(SIMPLE + HARD)} SELECT doc_id, marker, n FROM c WHERE n > 0"

QUERIES = {
    "marker_counts_words": rates_of(list(M.WORDS)),
    "marker_counts_phrases": rates_of(["important_to_note", "in_todays", "dive_into"]),
    "marker_counts_lookaround": rates_of(HARD),
    "marker_flags_whole_text": whole_text,
    "uniform_sentences": uniform_sentences,
    "analyse_text": analyse_text,
    "share_wilson": share_wilson,
    "rate_dispersion": rate_dispersion,
    "two_proportion_p": two_proportion_p,
    "bh_adjust": bh_adjust,
    "strata_observed_expected": strata_observed_expected,
    "conditional_test": conditional_test,
    "poisson_interval": poisson_interval,
    "verdict_rate": verdict_rate,
    "verdict_share": verdict_share,
    "summary_k_of_n": summary_k_of_n,
}
SQL = {
    "marker_counts_words": rates_sql(list(M.WORDS)),
    "marker_counts_phrases": rates_sql(["important_to_note", "in_todays", "dive_into"]),
    "marker_counts_lookaround": rates_sql(HARD),
    "marker_flags_whole_text": WHOLE_SQL,
    "analyse_text": ANALYSE_SQL,
    "share_wilson": SHARE_SQL,
    "rate_dispersion": RATE_SQL,
    "two_proportion_p": TWO_PROPORTION_SQL,
    "bh_adjust": BH_SQL,
    "strata_observed_expected": STRATA_SQL,
    "conditional_test": CONDITIONAL_SQL,
    "poisson_interval": POISSON_SQL,
    "verdict_rate": VERDICT_RATE_SQL,
    "verdict_share": VERDICT_SHARE_SQL,
    "summary_k_of_n": SUMMARY_SQL,
}
