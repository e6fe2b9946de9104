"""Files of a run: arms of a kind of writing, frames, lists and assignments, each checked against itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.tokens import runs
from .readers import arm, exists, strict_csv

#: The columns of the pinned essay files, in order, and those that are read.
ESSAY_COLUMNS = (
    "essay_id_comp full_text holistic_essay_score word_count prompt_name task assignment source_text gender grade_level ell_status race_ethnicity economically_disadvantaged student_disability_status prompt_url gpt4_summary scoring_rubric_url"
).split()
ESSAY_WANTED = "essay_id_comp full_text word_count prompt_name task assignment grade_level".split()
EXCLUDED_PROMPT, LEAST, MOST = "Phones and driving", 80, 800
#: A field of a frame longer than this is taken for text, which a frame must not hold.
LONGEST_FIELD = 200


def load_arms(spark: SparkSession, folder: str, names: dict[str, str], shared: dict[str, str] | None = None) -> DataFrame | None:
    """The arms of a kind of writing and the shared ones that are there, as one table with their ids.

    ``names`` maps an arm's id to its file; a collected arm that was not cleaned is an error.
    """
    found = []
    for id_, file in {**names, **(shared or {})}.items():
        rows = arm(spark, folder, file)
        if rows is not None:
            found.append(rows.withColumn("arm", F.lit(id_)))
    return reduce(DataFrame.unionByName, found) if found else None


def essays(spark: SparkSession, path: str) -> DataFrame:
    """The wanted columns of a pinned essay file."""
    return strict_csv(spark, path, ESSAY_COLUMNS, ESSAY_WANTED)


def named_row(values: Column, columns: list[str]) -> Column:
    """A row of values by position as a struct by name; rows of another width fail."""
    fits = F.size(values) == len(columns)
    wrong = F.raise_error(F.concat(F.lit("a row has "), F.size(values).cast("string"), F.lit(f" fields, not {len(columns)}"))).cast("string")
    return F.struct(*(F.when(fits, F.get(values, i)).otherwise(wrong).alias(c) for i, c in enumerate(columns)))


def text_key(text: Column) -> Column:
    """The first 16 hexadecimal digits of a text's digest."""
    return F.substring(F.sha2(text, 256), 1, 16)


def released_list(spark: SparkSession, path: str) -> DataFrame:
    """key, provider of a release list, after its stated count and tallies were held against its entries."""
    schema = "note string, key string, count long, providers map<string, long>, essays map<string, string>"
    one = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = one.select(F.explode("essays").alias("key", "provider"))
    told = one.select("count", "providers").first()
    got = {r.provider: r.n for r in rows.groupBy("provider").agg(F.count("*").alias("n")).collect()}  # a row per provider
    if not got or told["count"] != sum(got.values()):
        raise ValueError(f"{path}: says {told['count']} essays and holds {sum(got.values())}")
    for provider, n in (told["providers"] or {}).items():
        if got.get(provider, 0) != n:
            raise ValueError(f"{path}: says {n} essays from {provider} and holds {got.get(provider, 0)}")
    return rows


def eligible_essays(rows: DataFrame, released: DataFrame, is_english: Column) -> tuple[DataFrame, DataFrame]:
    """The essays that pass seven ordered steps, with their provider, and what each step kept and dropped.

    ``rows`` hold the wanted columns and ``pos``, their order over all files; of
    equal texts the first that got so far stays. ``released`` is (key, provider).
    """
    text = F.col("full_text")
    words = F.size(F.filter(runs(text), lambda x: x != ""))
    early = [
        ("independent", F.col("task") == "Independent"), ("prompt", F.col("prompt_name") != EXCLUDED_PROMPT), ("grade", F.trim(F.coalesce("grade_level", F.lit(""))) != ""),
        ("length", words.between(LEAST, MOST)), ("english", is_english),
    ]
    out = F.lit(None).cast("string")
    for name, test in reversed(early):
        out = F.when(~F.coalesce(test, F.lit(False)), name).otherwise(out)
    rows = rows.withColumn("_step", out).withColumn("_digest", F.sha2(text, 256))
    firsts = rows.where("_step is null").groupBy("_digest").agg(F.min("pos").alias("_first"))
    rows = rows.join(firsts, "_digest", "left").join(released.select(F.col("key").alias("_key"), "provider"), F.substring("_digest", 1, 16) == F.col("_key"), "left")
    late = F.when(F.col("pos") != F.col("_first"), "unique").when(F.col("_key").isNull(), "released")
    rows = rows.withColumn("_step", F.coalesce("_step", late))
    names = [n for n, _ in early] + ["unique", "released"]
    n = rows.groupBy("_step").agg(F.count("*").alias("n"))
    steps = rows.sparkSession.createDataFrame(list(enumerate(names)), "i int, step string")
    dropped = steps.join(n.withColumnRenamed("_step", "step"), "step", "left").select("i", "step", F.coalesce("n", F.lit(0)).alias("dropped"))
    total = n.agg(F.sum("n").alias("total"))
    gone = F.sum("dropped").over(W.partitionBy(F.lit(0)).orderBy("i"))  # seven rows
    report = dropped.join(F.broadcast(total), F.lit(True)).select("i", "step", (F.col("total") - gone).alias("kept"), "dropped")
    return rows.where("_step is null").drop("_step", "_digest", "_first", "_key"), report


def frame(spark: SparkSession, path: str) -> DataFrame:
    """id, prompt, grade, words, bin, sha256 of a frame; one that carries text, or a row without prompt or grade, is an error.

    Rows stand under "essays" or "rows"; the prompt is a field or the middle of the id.
    """
    row = "array<struct<id: string, prompt: string, grade: int, words: int, bin: int, sha256: string, text: string, full_text: string>>"
    one = spark.read.schema(f"essays {row}, rows {row}").option("multiLine", True).json(path)
    rows = one.select(F.explode(F.coalesce("essays", "rows")).alias("r")).select("r.*")
    prompt = F.coalesce(F.nullif("prompt", F.lit("")), F.nullif(F.get(F.split("id", ":"), 1), F.lit("")))
    long = reduce(Column.__or__, (F.coalesce(F.length(c) > LONGEST_FIELD, F.lit(False)) for c in ("id", "prompt", "sha256")))
    bad = rows.select(F.count_if(F.col("text").isNotNull() | F.col("full_text").isNotNull() | long).alias("texts"), F.count_if(prompt.isNull() | F.col("grade").isNull()).alias("bare"), F.count("*").alias("n")).first()
    if not bad.n:
        raise ValueError(f"{path}: no rows")
    if bad.texts:
        raise ValueError(f"{path}: {bad.texts} rows carry text")
    if bad.bare:
        raise ValueError(f"{path}: {bad.bare} rows name no assignment or no grade")
    return rows.select("id", prompt.alias("prompt"), "grade", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("bin", F.lit(-1)).alias("bin"), F.coalesce("sha256", F.lit("")).alias("sha256"))


def slugified(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """alias, slug, name, assignment: every assignment under its slug, its name and its slugified name."""
    one = spark.read.schema("prompts array<struct<slug: string, name: string, assignment: string>>").option("multiLine", True).json(path)
    rows = one.select(F.explode("prompts").alias("p")).select("p.name", "p.assignment", F.coalesce(F.nullif("p.slug", F.lit("")), slugified(F.col("p.name"))).alias("slug"))
    if rows.where("name is null or coalesce(assignment, '') = ''").limit(1).count() or not rows.limit(1).count():
        raise ValueError(f"{path}: every entry needs a name and an assignment")
    return rows.select(F.explode(F.array_distinct(F.array("slug", "name", slugified(F.col("name"))))).alias("alias"), "slug", "name", "assignment")


def with_assignments(rows: DataFrame, known: DataFrame, column: str = "prompt") -> DataFrame:
    """``rows`` with slug, name and assignment; a prompt that none of the aliases names is an error."""
    first = known.groupBy("alias").agg(F.min(F.struct("slug", "name", "assignment")).alias("_a"))
    got = rows.join(F.broadcast(first), F.col(column) == F.col("alias"), "left").drop("alias")
    unknown = F.raise_error(F.concat(F.lit("no assignment for "), F.col(column)))
    return got.select(*rows.columns, *(F.when(F.col("_a").isNull(), unknown.cast("string")).otherwise(F.col(f"_a.{c}")).alias(c) for c in ("slug", "name", "assignment")))


def first_titles(spark: SparkSession, paths: list[str], required: bool = False) -> DataFrame:
    """source_id, title: of several files of titles the first that names an id; a missing file is passed over unless required."""
    parts = []
    for place, path in enumerate(paths):
        if exists(spark, path):
            parts.append(spark.read.schema("source_id string, title string").option("multiLine", True).json(path).where("source_id is not null and title is not null").withColumn("_p", F.lit(place)))
        elif required:
            raise FileNotFoundError(path)
    if not parts:
        return spark.createDataFrame([], "source_id string, title string")
    return reduce(DataFrame.unionByName, parts).groupBy("source_id").agg(F.min_by("title", F.struct("_p", "title")).alias("title"))


def dates(spark: SparkSession, path: str) -> DataFrame | None:
    """source_id, dated, excluded of a dates file; None where there is none."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema("documents array<struct<source_id: string, title: string, arxiv_id: string, versions: array<struct<v: int, date: string>>, excluded: boolean>>").option("multiLine", True).json(path)
    d = rows.select(F.explode("documents").alias("d")).select("d.*")
    return d.select("source_id", is_dated(F.col("arxiv_id"), F.col("versions")).alias("dated"), F.coalesce("excluded", F.lit(False)).alias("excluded"), (F.col("arxiv_id").isNotNull() & (F.coalesce(F.size("versions"), F.lit(0)) <= 0)).alias("no_history"))


def is_dated(paper: Column, versions: Column) -> Column:
    return (F.coalesce(paper, F.lit("")) != "") & (F.coalesce(F.size(versions), F.lit(0)) > 0)


def date_counts(rows: DataFrame) -> DataFrame:
    """documents, matched, unmatched, excluded, no_history of ``dates`` rows."""
    return rows.agg(F.count("*").alias("documents"), F.count_if("dated").alias("matched"), F.count_if(~F.col("dated")).alias("unmatched"), F.count_if("excluded").alias("excluded"), F.count_if("no_history").alias("no_history"))


def dating_status(asked: Column, checked: Column, excluded: Column, complete: Column, not_looked_up: Column) -> Column:
    """none, unchecked, not applied, partial or applied: where the dating of a kind of writing stands."""
    return F.when(~asked, "none").when(~checked, "unchecked").when(excluded.isNull(), "not applied").when(~F.coalesce(complete, F.lit(True)) | (F.coalesce(not_looked_up, F.lit(0)) > 0), "partial").otherwise("applied")


def generated_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The slot files of a folder, one row each, with the file's name where it names no slot."""
    schema = "slot string, arm string, text string, model string, harness string, generated_at string, context_id string, prompt string, prompt_sha256 string, text_sha256 string, error string"
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("slot", F.coalesce("slot", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))
