"""Sinks: Parquet by arm, JSON lines in order, one JSON document with a size budget."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def by_arm(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm").parquet(path)


def json_lines(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).write.mode("overwrite").json(path)


def _lines(rows: DataFrame, order: tuple[str, ...], budget: int) -> list[str]:
    """The rows as JSON in order; refused above ``budget`` bytes, which are summed before anything comes to the driver."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"), *order)
    size = lines.agg(F.sum(F.octet_length("j") + 1)).first()[0] or 0
    if size > budget:
        raise ValueError(f"the report has {size} bytes; the budget is {budget}")
    return [r.j for r in lines.orderBy(*order).collect()]


def document(rows: DataFrame, *order: str, budget: int = 250_000) -> str:
    """The rows of a report as one JSON array; a report above ``budget`` bytes is refused."""
    return "[" + ",".join(_lines(rows, order, budget)) + "]"


def lines_document(meta: str, key: str, rows: DataFrame, *order: str, budget: int = 250_000) -> str:
    """A JSON object with ``meta`` (its other fields, as JSON) and the rows under ``key``, one to a line, so that a diff shows rows."""
    body = ",\n  ".join(_lines(rows, order, budget))
    head = meta.rstrip()[:-1].rstrip()
    return f'{head}{"," if head != "{" else ""}\n "{key}": [\n  {body}\n ]\n}}\n'


def write_if_changed(spark: SparkSession, path: str, content: str) -> bool:
    """Put a small file in place whole, by a new file and a rename; one with the same content is left alone."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if exists(spark, path):
        got = spark.read.format("binaryFile").load(path).select("content").first()[0]
        if bytes(got) == content.encode():
            return False
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(new, True)
    out.write(bytearray(content.encode()))
    out.close()
    store.delete(at, False)
    store.rename(new, at)
    return True


def without_text(rows: DataFrame, *texts: str) -> DataFrame:
    """The committed copy of a list: its rows without the columns that hold texts."""
    return rows.drop(*(texts or ("text", "assignment", "prompt")))


def table_text(rows: DataFrame, *order: str, most: int = 200) -> str:
    """A small report as aligned text; larger ones are refused."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the report has more than {most} rows")
    cells = [rows.columns, *([f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in found)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in cells)
