"""Event-time counts with late data, and marker counts of arriving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markers import BY_ID


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total: counts per window; works on streams and tables alike."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    got = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def marker_counts(arriving: DataFrame, names: list[str]) -> DataFrame:
    """Marker counts of a stream of texts (arm, text): stateless columns, then running sums."""
    each = F.array(*(F.struct(F.lit(x).alias("marker"), BY_ID[x].count(F.col("text")).alias("n")) for x in names))
    return arriving.select("arm", F.explode(each).alias("m")).groupBy("arm", "m.marker").agg(F.sum("m.n").alias("n"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
