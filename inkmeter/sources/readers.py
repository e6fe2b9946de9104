"""Readers. Every schema is stated; a file that does not fit fails the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import java

#: The columns of the pinned sources.
RAID_COLUMNS = ["id", "adv_source_id", "source_id", "model", "decoding", "repetition_penalty", "attack", "domain", "title", "prompt", "generation"]
TEXT_SCHEMA = "id string, text string, at bigint"
RECORD_SCHEMA = "slug string, essays array<struct<slot: string, arm: string, text: string, model: string>>"
DATE_SCHEMA = "source_id string, title string, arxiv_id string, versions array<struct<v: int, date: string>>, excluded boolean"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def arm(spark: SparkSession, folder: str, name: str, clean: bool = True) -> DataFrame | None:
    """One arm's JSON array as rows with their file order.

    A missing clean file beside a raw one is an error; where neither is there,
    or the arm is empty, there is no arm.
    """
    path = f"{folder}/{name}{'-clean' if clean else ''}.json"
    if not exists(spark, path):
        if clean and exists(spark, f"{folder}/{name}.json"):
            raise FileNotFoundError(f"{name} was collected but not cleaned")
        return None
    rows = spark.read.schema("text string").option("wholetext", True).text(path)
    parsed = rows.select(F.posexplode(F.from_json("value" if "value" in rows.columns else "text", f"array<struct<{TEXT_SCHEMA.replace(' string', ': string').replace(' bigint', ': bigint')}>>", {"mode": "FAILFAST"})).alias("pos", "t"))
    out = parsed.select(F.lit(name).alias("arm"), F.col("pos").cast("long").alias("pos"), "t.*")
    return out if out.limit(1).count() else None


def strict_csv(spark: SparkSession, path: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """RFC 4180 CSV whose header must be exactly ``columns``; all strings; fails on a bad row.

    Quoted fields may hold line breaks and doubled quotes. Only ``keep`` is parsed into columns.
    """
    head = spark.read.text(path).limit(1).collect()
    found = head[0][0].rstrip("\r").split(",") if head else []
    if found != columns:
        raise ValueError(f"the header of {path} is {found}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, multiLine=True, quote='"', escape='"', mode="FAILFAST", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in (keep or columns)))


def is_measured(domain: str, wanted: list[str]) -> Column:
    """The main setting of a wanted writer: no attack, greedy, no penalty; people have no settings."""
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    person = (F.col("model") == "human") & (value("decoding") == "") & (value("repetition_penalty") == "")
    machine = (F.col("model") != "human") & (value("decoding") == "greedy") & (value("repetition_penalty") == "no")
    return (F.col("attack") == "none") & (F.col("domain") == domain) & F.col("model").isin(wanted) & (person | machine)


def shared_by_all(rows: DataFrame, writers: list[str], prose: Column) -> DataFrame:
    """Rows of the documents that every writer has with enough prose (400 characters)."""
    enough = rows.where(F.col("model").isin(writers)).where(prose >= 400)
    have = enough.groupBy("source_id").agg(F.countDistinct("model").alias("n")).where(F.col("n") == len(writers)).select("source_id")
    return enough.join(have, "source_id", "left_semi")


def generated(spark: SparkSession, folder: str, arm_id: str) -> DataFrame:
    """Generated records of a folder: slot, text and group of one arm's texts that are not empty."""
    files = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).where("slug is not null")
    rows = files.select(F.col("slug").alias("group"), F.explode("essays").alias("e"))
    return rows.where((F.col("e.arm") == arm_id) & (F.trim("e.text") != "")).select(F.col("e.slot").alias("id"), F.col("e.text").alias("text"), "group")


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """``path``, if its content has the stated digest; fails otherwise."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if got is None or got[0] != sha256:
        raise ValueError(f"{path} is not the pinned file")
    return path


def feed(spark: SparkSession, rows: DataFrame, column: str = "xml") -> DataFrame:
    """Atom entries of a column of feeds: id, version, title, summary, published, updated.

    A feed that reports an error fails; entries that name no version of a paper are left out.
    """
    entry = "struct<id: string, title: string, summary: string, published: string, updated: string>"
    parsed = rows.select(F.from_xml(F.col(column), f"struct<entry: array<{entry}>>", {"rowTag": "feed", "ignoreNamespace": "true"}).alias("f"))
    failed = F.raise_error(F.concat(F.lit("the feed reports an error: "), F.coalesce("e.summary", F.lit(""))))
    e = parsed.select(F.explode("f.entry").alias("e")).where(F.when(F.contains("e.id", F.lit("/api/errors")), failed.cast("boolean")).otherwise(F.col("e.id").rlike(r"/abs/.+v[0-9]+\s*\z")))
    return e.select(
        F.nullif(F.regexp_extract("e.id", r"/abs/(.+?)(?:v\d+)?$", 1), F.lit("")).alias("id"), F.expr("try_cast(regexp_extract(e.id, 'v([0-9]+)$', 1) as int)").alias("version"),
        one_line(F.col("e.title")).alias("title"), one_line(F.col("e.summary")).alias("summary"), day(F.col("e.published")).alias("published"), day(F.col("e.updated")).alias("updated"),
    )


def oai(rows: DataFrame, column: str = "xml") -> DataFrame:
    """id, title, versions (array of v, date, by v) of a column of OAI-PMH answers in the raw format.

    An answer that the id does not exist gives no row; any other error, no
    record, or a record without versions fails.
    """
    record = "struct<record: struct<metadata: struct<arXivRaw: struct<id: string, title: string, version: array<struct<_version: string, date: string>>>>>>"
    answer = F.from_xml(F.col(column), f"struct<error: struct<_code: string, _VALUE: string>, GetRecord: {record}>", {"rowTag": "OAI-PMH", "ignoreNamespace": "true"})
    rows = rows.select(F.col(column).alias("x"), answer.alias("a")).select("x", F.col("a.error").alias("error"), F.col("a.GetRecord.record.metadata.arXivRaw").alias("r"))
    rows = rows.where(F.coalesce(F.col("error._code") != "idDoesNotExist", F.lit(True)))
    versions = F.array_sort(F.transform("r.version", lambda v: F.struct(F.regexp_extract(v["_version"], "([0-9]+)", 1).cast("int").alias("v"), day(v["date"]).alias("date"))))
    wrong = (
        F.when(~F.col("x").rlike(r"<OAI-PMH[\s>]"), F.lit("the answer is not OAI-PMH"))
        .when(F.col("error").isNotNull(), F.concat_ws(" ", F.lit("error"), "error._code", "error._VALUE"))
        .when(F.col("r").isNull(), F.lit("the answer has no record"))
        .when(F.coalesce(F.size("r.version"), F.lit(0)) <= 0, F.lit("the record lists no versions"))
    )
    checked = lambda c, kind: F.when(wrong.isNotNull(), F.raise_error(wrong).cast(kind)).otherwise(c)
    return rows.select(checked(one_line(F.col("r.id")), "string").alias("id"), one_line(F.col("r.title")).alias("title"), versions.alias("versions"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, java(r"\s+"), " "))


def day(text: Column) -> Column:
    """The UTC day of an ISO or RFC 2822 date; null for another form."""
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    mail = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.coalesce(F.nullif(iso, F.lit("")), F.date_format(mail, "yyyy-MM-dd"))


def query_url(base: str, text: Column) -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")))


#: Addresses of the paper archive.
API, OAI = "https://export.arxiv.org/api/query", "https://oaipmh.arxiv.org/oai"


def search_url(query: Column, most: int = 10) -> Column:
    return F.concat(query_url(f"{API}?search_query=", query), F.lit(f"&start=0&max_results={most}"))


def first_version_url(id_: Column) -> Column:
    return F.concat(query_url(f"{API}?id_list=", F.concat(id_, F.lit("v1"))), F.lit("&max_results=1"))


def record_url(id_: Column) -> Column:
    return F.concat(query_url(f"{OAI}?verb=GetRecord&identifier=", F.concat(F.lit("oai:arXiv.org:"), id_)), F.lit("&metadataPrefix=arXivRaw"))


def slot_id(arm_: Column, group: Column, grade: Column, number: Column) -> Column:
    return F.concat_ws(".", arm_, group, F.concat(F.lit("g"), F.lpad(grade.cast("string"), 2, "0")), F.lpad(number.cast("string"), 3, "0"))
