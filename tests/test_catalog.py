"""Files of a run, and reports on what texts share."""

import csv
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from inkmeter.functions import clean, stats
from inkmeter.operators import memory
from inkmeter.sources import catalog


def write(path, value):
    path.write_text(json.dumps(value))
    return f"file://{path}"


def test_load_arms(spark, tmp_path):
    write(tmp_path / "a-clean.json", [{"id": "1", "text": "x"}, {"id": "2", "text": "y"}])
    write(tmp_path / "b.json", [{"id": "1", "text": "x"}])
    write(tmp_path / "c-clean.json", [])
    got = catalog.load_arms(spark, f"file://{tmp_path}", {"one": "a"}, {"none": "c", "absent": "d"})
    assert sorted((r.arm, r.pos, r.id) for r in got.collect()) == [("one", 0, "1"), ("one", 1, "2")]
    assert catalog.load_arms(spark, f"file://{tmp_path}", {"absent": "d"}) is None
    with pytest.raises(FileNotFoundError):
        catalog.load_arms(spark, f"file://{tmp_path}", {"two": "b"})


def test_essays_and_their_steps(spark, tmp_path):
    fine = "this is a text that people in the school wrote for it and of the kind " * 8
    rows = [("1", fine, "Independent", "P", "8"), ("2", fine, "Independent", "P", "8"), ("3", fine, "Text dependent", "P", "8"), ("4", fine, "Independent", catalog.EXCLUDED_PROMPT, "8")]
    rows += [("5", fine, "Independent", "P", " "), ("6", "short", "Independent", "P", "8"), ("7", "xyz " * 100, "Independent", "P", "8"), ("8", fine + " more", "Independent", "P", "9")]
    with open(tmp_path / "e.csv", "w", newline="") as f:
        out = csv.DictWriter(f, catalog.ESSAY_COLUMNS, restval="")
        out.writeheader()
        out.writerows({"essay_id_comp": i, "full_text": t, "task": k, "prompt_name": p, "grade_level": g} for i, t, k, p, g in rows)
    essays = catalog.essays(spark, f"file://{tmp_path}/e.csv").withColumn("pos", F.col("essay_id_comp").cast("long"))
    assert essays.columns == [*catalog.ESSAY_WANTED, "pos"]
    key = hashlib.sha256(fine.encode()).hexdigest()[:16]
    path = write(tmp_path / "list.json", {"note": "", "key": "", "count": 2, "providers": {"p": 2}, "essays": {key: "p", "0" * 16: "p"}})
    kept, steps = catalog.eligible_essays(essays, catalog.released_list(spark, path), clean.is_english(F.col("full_text")))
    assert [(r.essay_id_comp, r.provider) for r in kept.collect()] == [("1", "p")]
    assert [(r.step, r.kept, r.dropped) for r in sorted(steps.collect())] == [("independent", 7, 1), ("prompt", 6, 1), ("grade", 5, 1), ("length", 4, 1), ("english", 3, 1), ("unique", 2, 1), ("released", 1, 1)]
    with pytest.raises(ValueError, match="says 3"):
        catalog.released_list(spark, write(tmp_path / "bad.json", {"count": 3, "essays": {"a": "p"}}))
    with pytest.raises(ValueError, match="from p"):
        catalog.released_list(spark, write(tmp_path / "bad2.json", {"count": 1, "providers": {"p": 2}, "essays": {"a": "p"}}))
    assert spark.createDataFrame([(fine,)], "t string").select(catalog.text_key(F.col("t"))).first()[0] == key


def test_frame_and_assignments(spark, tmp_path):
    path = write(tmp_path / "frame.json", {"essays": [{"id": "essays:my-task:1", "grade": 8}, {"id": "x", "prompt": "My Task", "grade": 9, "words": 90, "bin": 0}]})
    rows = catalog.frame(spark, path)
    assert [(r.prompt, r.grade, r.bin) for r in rows.collect()] == [("my-task", 8, -1), ("My Task", 9, 0)]
    known = catalog.assignments(spark, write(tmp_path / "a.json", {"prompts": [{"name": "My Task", "assignment": " do it "}]}))
    assert {(r.slug, r.name, r.assignment) for r in catalog.with_assignments(rows, known).collect()} == {("my-task", "My Task", " do it ")}
    with pytest.raises(Exception, match="no assignment for other"):
        catalog.with_assignments(rows.withColumn("prompt", F.lit("other")), known).collect()
    for bad, match in (({"rows": [{"id": "a:b:c", "grade": 8, "text": "words"}]}, "carry text"), ({"rows": [{"id": "a", "grade": 8}]}, "no assignment"), ({"rows": [{"id": "a:b:c"}]}, "no grade"), ({"rows": []}, "no rows")):
        with pytest.raises(ValueError, match=match):
            catalog.frame(spark, write(tmp_path / "bad.json", bad))
    with pytest.raises(ValueError, match="needs a name"):
        catalog.assignments(spark, write(tmp_path / "bad.json", {"prompts": [{"name": "x"}]}))


def test_titles_and_dates(spark, tmp_path):
    a = write(tmp_path / "a.json", [{"source_id": "1", "title": "first"}, {"source_id": "2"}])
    b = write(tmp_path / "b.json", [{"source_id": "1", "title": "second"}, {"source_id": "2", "title": "two"}])
    assert {(r.source_id, r.title) for r in catalog.first_titles(spark, [a, f"file://{tmp_path}/none.json", b]).collect()} == {("1", "first"), ("2", "two")}
    with pytest.raises(FileNotFoundError):
        catalog.first_titles(spark, [f"file://{tmp_path}/none.json"], required=True)
    docs = [{"source_id": "1", "arxiv_id": "x", "versions": [{"v": 1, "date": "2020-01-01"}], "excluded": True}, {"source_id": "2", "arxiv_id": "y", "versions": []}, {"source_id": "3", "arxiv_id": None, "versions": []}]
    rows = catalog.dates(spark, write(tmp_path / "d.json", {"documents": docs}))
    assert tuple(catalog.date_counts(rows).first()) == (3, 1, 2, 1, 1) and catalog.dates(spark, f"file://{tmp_path}/none.json") is None
    rows = [(False, False, None, None, None), (True, False, None, None, None), (True, True, None, None, None), (True, True, 1, False, 0), (True, True, 1, True, 2), (True, True, 1, None, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c int, d boolean, e int")
    assert [r[0] for r in df.select(catalog.dating_status(*map(F.col, "abcde"))).collect()] == ["none", "unchecked", "not applied", "partial", "partial", "applied"]


def test_named_row_and_slots(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    assert df.select(catalog.named_row(F.col("v"), ["x", "y"]).alias("r")).first().r.asDict() == {"x": "a", "y": "b"}
    with pytest.raises(Exception, match="2 fields, not 3"):
        df.select(catalog.named_row(F.col("v"), ["x", "y", "z"]).alias("r")).collect()
    write(tmp_path / "s1.json", {"arm": "m", "text": "t"})
    write(tmp_path / "s2.json", {"slot": "own", "arm": "m"})
    assert sorted(r.slot for r in catalog.generated_slots(spark, f"file://{tmp_path}").collect()) == ["own", "s1"]


def test_memory(spark):
    people = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e x y z"), (3, "k l m n o p"), (4, None)], "id long, text string")
    machine = spark.createDataFrame([("m", 1, "a b c d e f"), ("m", 2, "k l m n q"), ("n", 3, "a b c d e q r s t u")], "arm string, id long, text string")
    got = {r.arm: r for r in memory.memorisation(machine, people.select("text")).collect()}
    assert (got["m"].texts, got["m"].mean, got["m"].most, got["m"].above, got["m"].worst) == (2, 0.5, 1.0, 1, "1,2")
    assert got["n"].mean == pytest.approx(1 / 6) and got["n"].above == 0
    base = memory.baseline(people, F.lpad(F.col("id").cast("string"), 3, "0")).first()  # 1 and 2 held out against 3 and 4
    assert tuple(base) == (2, 0.0, 0.0, 0)
    one, two = (spark.createDataFrame([(i,) for i in x], "id long") for x in ([1, 2], [2, 3]))
    assert {(r.id, r.only) for r in memory.flags_agree(one, two).collect()} == {(1, "flagged"), (3, "found")} and memory.flags_agree(one, one).count() == 0


def test_two_rates_and_tint(spark):
    assert stats.two_rate_p(1, 0, 2, 5) is None and stats.two_rate_p(5, 164000, 0, 270000) == pytest.approx(7.70e-3, rel=5e-3)
    df = spark.createDataFrame([(4.0, 3.0, 5.0, 1.0, 0.5, 2.0), (1.0, 0.5, 2.0, 4.0, 3.0, 5.0), (1.0, 0.0, 2.0, 1.5, 1.0, 3.0)], "v double, lo double, hi double, p double, plo double, phi double")
    way, strength = stats.tint(*map(F.col, ("v", "lo", "hi", "p", "plo", "phi")), 0.0)
    assert [tuple(r) for r in df.select(way, strength).collect()] == [("up", 0.5), ("down", 0.5), (None, None)]
