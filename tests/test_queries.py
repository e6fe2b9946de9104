"""Queries against their SQL, and independence of partitioning."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "marker_counts_words", "share_wilson", "rate_dispersion", "bh_adjust", "strata_observed_expected", "english_share", "cleaning_report", "pair_by_document", "pair_by_length",
    "placebo_halves", "upper_median", "containment_pool", "text_guard", "evidence_forms", "allocate_slots", "merge_records", "frame_diff", "dated_exclusions", "dedup_keep_first",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(f"{float(x):.5f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert rows(got.astype(want.dtypes.to_dict())) == rows(want)
    assert len(got)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_partitioning_does_not_matter(spark, sf_dir):
    from inkmeter.plans import marker_plans
    from inkmeter.plans.base import texts

    base = texts(spark, sf_dir)
    one, many = (rows(marker_plans._rates(base.repartition(n), marker_plans.SIMPLE).toPandas()) for n in (1, 17))
    assert one == many


@pytest.mark.parametrize("common, wide", [(50, 12), (3, 12), (3, 1), (0, 12)])
def test_title_match_equals_brute_force(spark, common, wide):
    from inkmeter.plans import text_plans

    hot = [["the", "report"] for _ in range(60)] + [["a%d" % (i % 40), "the", "on%d" % (i % 7), "for%d" % (i % 3)] for i in range(70)]
    titles = [(i, sorted(set(w))) for i, w in enumerate([*hot, ["alone"], [], ["the"], ["the", "report", "for1", "x1", "x2"]])]
    want = {}
    for i, w in titles:
        found = [(-len({*w} & {*v}), len(v), j) for j, v in titles if j != i and w and 4 * len({*w} & {*v}) >= len(w)]
        if found:
            k, m, j = min(found)
            want[i] = (j, -k, round(-k / len(w), 6), round(-2 * k / (len(w) + m), 6))
    got = text_plans.best_matches(spark.createDataFrame(titles, "page_id long, w array<string>"), common, wide)
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == want
    assert want[0] == (1, 2, 1.0, 1.0)


def test_guard_has_all_three_rules(spark):
    from inkmeter.operators import overlap

    people = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "red green blue black white"), (3, "x")], "doc long, text string")
    titles = spark.createDataFrame([(1, "Need advice"), (2, "My old cat"), (3, "a b c d e f g h")], "doc long, title string")
    texts = [
        (10, 1, "so two three four five six it is"), (11, 2, "so two three four five six it is"), (12, 2, "here is my old, cat again"), (13, 1, "here is my old cat again"),
        (14, 1, "need advice"), (15, 2, "two three four five six seven eight nine"), (16, None, "A b c d e f g h"), (17, 2, "my old cats"), (18, None, None),
    ]
    got = overlap.guarded(spark.createDataFrame(texts, "id long, doc long, text string"), people, titles)
    assert sorted(r.id for r in got.collect()) == [10, 12, 15, 16]


def test_containment_scores_every_document(spark, tmp_path):
    texts = [(2, "s", "a b c d e f"), (5, "s", "a b c d e"), (8, "s", "u v w x y z"), (3, "t", "a b c d e"), (9, "t", "a b")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.grams, r.shared, r.containment) for r in entry.queries()["containment_pairs"](spark, str(tmp_path)).collect()}
    assert got == {2: (2, 1, 0.5), 5: (1, 1, 1.0), 8: (2, 0, 0.0), 3: (1, 0, 0.0), 9: (0, 0, 0.0)}
