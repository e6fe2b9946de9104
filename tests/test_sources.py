"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from inkmeter.sources import readers, registry, sinks
from inkmeter.streaming import counts


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"two ""quoted""\nlines"\n2,\n', encoding="utf-8")
    rows = readers.strict_csv(spark, str(path), ["id", "text"]).orderBy("id").collect()
    assert [r.text for r in rows] == ['two "quoted"\nlines', ""]
    with pytest.raises(ValueError):
        readers.strict_csv(spark, str(path), ["id", "body"])
    path.write_text("id,text\n1,a,b\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict_csv(spark, str(path), ["id", "text"]).collect()


def test_arms(spark, tmp_path):
    rows = [{"id": "b", "text": "x"}, {"id": "a", "text": "y", "at": 5}]
    (tmp_path / "human-clean.json").write_text(json.dumps(rows))
    (tmp_path / "raw.json").write_text("[]")
    got = readers.arm(spark, str(tmp_path), "human").orderBy("pos").collect()
    assert [(r.pos, r.id, r.at) for r in got] == [(0, "b", None), (1, "a", 5)]
    assert readers.arm(spark, str(tmp_path), "absent") is None
    with pytest.raises(FileNotFoundError):
        readers.arm(spark, str(tmp_path), "raw")


def test_generated(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"slug": "cars", "essays": [{"slot": "s1", "arm": "m", "text": "t"}, {"slot": "s2", "arm": "m", "text": " "}, {"slot": "s3", "arm": "n", "text": "u"}]}, indent=1))
    (tmp_path / "manifest.json").write_text("{}")
    assert [tuple(r) for r in readers.generated(spark, str(tmp_path), "m").collect()] == [("s1", "t", "cars")]


def test_feed_and_days(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n b</title><summary>s</summary><published>2021-01-02T00:00:00Z</published><updated>2021-02-03T00:00:00Z</updated></entry></feed>'
    row = readers.feed(spark, spark.createDataFrame([(xml,)], "xml string")).first()
    assert (row.id, row.version, row.title, row.published) == ("2101.00001", 2, "A b", "2021-01-02")
    days = spark.createDataFrame([("Mon, 4 Jan 2021 10:00:00 GMT",), ("2021-01-05",), ("x",)], "d string").select(readers.day(F.col("d"))).collect()
    assert [d[0] for d in days] == ["2021-01-04", "2021-01-05", None]


def test_measured(spark):
    rows = spark.createDataFrame([("human", None, "", "none", "a"), ("gpt4", "greedy", "no", "none", "a"), ("gpt4", "sampling", "no", "none", "a"), ("mpt", "greedy", "no", "none", "a")], "model string, decoding string, repetition_penalty string, attack string, domain string")
    assert rows.where(readers.is_measured("a", ["human", "gpt4"])).count() == 2


def test_registry(spark):
    arms = registry.writers(spark)
    assert arms.count() == arms.select("arm").distinct().count() == 18
    assert all(g.decider in g.tested for g in registry.GENRES)
    run, missing = registry.genres_to_run(None, {"posts"})
    assert [g.id for g in run] == ["posts"] and missing == ["abstracts"]


def test_document(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string")
    assert json.loads(sinks.document(rows, "i")) == [{"i": 1, "s": "a"}, {"i": 2, "s": "b"}]
    with pytest.raises(ValueError):
        sinks.document(rows, "i", budget=5)


def test_stream(spark, sf_dir):
    out = counts.event_windows(counts.read_events(spark, sf_dir))
    query = out.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = counts.event_windows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert spark.table("windows").count() == batch.count() > 0


def test_oai(spark):
    from inkmeter.sources import readers

    record = "<?xml version='1.0'?><OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'>{}</OAI-PMH>"
    raw = "<GetRecord><record><metadata><arXivRaw><id>1202.3670</id>{}<title>A  title &amp;\n more</title></arXivRaw></metadata></record></GetRecord>"
    versions = "<version version='v2'><date>Tue, 03 Mar 2020 10:00:00 GMT</date></version><version version='v1'><date>Sun, 01 Mar 2020 23:59:00 GMT</date></version>"
    got = readers.oai(spark.createDataFrame([(record.format(raw.format(versions)),), (record.format("<error code='idDoesNotExist'>no</error>"),)], "xml string")).collect()
    assert [(r.id, r.title, [tuple(v) for v in r.versions]) for r in got] == [("1202.3670", "A title & more", [(1, "2020-03-01"), (2, "2020-03-03")])]
    for bad in (record.format("<error code='badVerb'>x</error>"), record.format(raw.format("")), "<html/>"):
        with pytest.raises(Exception, match="badVerb|versions|OAI-PMH|record"):
            readers.oai(spark.createDataFrame([(bad,)], "xml string")).collect()
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/api/errors#x</id><summary>wrong id</summary></entry></feed>"
    with pytest.raises(Exception, match="wrong id"):
        readers.feed(spark, spark.createDataFrame([(feed,)], "xml string")).collect()


def test_urls(spark):
    from inkmeter.sources import readers

    row = spark.range(1).select(readers.search_url(F.lit('ti:a AND ti:"b"')), readers.first_version_url(F.lit("math/0211159")), readers.record_url(F.lit("1202.3670"))).first()
    assert row[0] == "https://export.arxiv.org/api/query?search_query=ti%3Aa%20AND%20ti%3A%22b%22&start=0&max_results=10"
    assert row[1].endswith("id_list=math%2F0211159v1&max_results=1") and row[2].endswith("identifier=oai%3AarXiv.org%3A1202.3670&metadataPrefix=arXivRaw")


def test_small_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 0.5), (1, "a", None)], "i int, s string, x double")
    made = sinks.lines_document('{"about": 1}', "rows", rows.select("i", "s"), "i")
    assert json.loads(made) == {"about": 1, "rows": [{"i": 1, "s": "a"}, {"i": 2, "s": "b"}]} and '\n  {"i":2' in made
    path = f"file://{tmp_path}/out.json"
    assert [sinks.write_if_changed(spark, path, x) for x in (made, made, "{}")] == [True, False, True]
    assert (tmp_path / "out.json").read_text() == "{}" and not list(tmp_path.glob("*.tmp"))
    assert sinks.without_text(rows, "s").columns == ["i", "x"]
    assert sinks.table_text(rows, "i").split("\n") == ["i  s  x", "1  a", "2  b  0.5"]
    with pytest.raises(ValueError):
        sinks.table_text(rows, "i", most=1)
