"""BED intervals (0-based, half-open) with an optional mut_rate attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """contig, start, end, mut_rate; rows with negative places are skipped, an empty interval raises."""
    f = F.split(F.trim("value"), r"\s+")
    x = lines.where((F.length(F.trim("value")) > 0) & ~F.col("value").rlike(r"^\s*(#|track|browser)")).select(
        F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"),
        F.nullif(F.regexp_extract("value", r"(?i)mut_rate=([^\s;,|]+)", 1), F.lit("")).try_cast("double").alias("mut_rate"),
    )
    x = x.where("start >= 0 and end >= 0")
    return x.withColumn("end", F.when(F.col("start") < F.col("end"), F.col("end")).otherwise(F.raise_error(F.concat(F.lit("empty interval on "), "contig")).cast("long")))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
