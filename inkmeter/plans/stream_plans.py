"""Windowed event counts (an extension); the batch form of the streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.counts import event_windows
from .base import table


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = event_windows(table(spark, sf_dir, "events"))
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"event_windows": windows}
SQL = {"event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"}
