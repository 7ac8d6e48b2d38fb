"""An extension: case tables as streams. The library this one follows has no streams; these are for continuous delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deliveries(spark: SparkSession, folder: str, schema, per_trigger: int = 50) -> DataFrame:
    """New Parquet files of a table as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_deliveries(stream: DataFrame, key: str, arrival: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """Each record once: one that comes again within `late` of its first arrival is dropped; the state older than that is let go."""
    return stream.withWatermark(arrival, late).dropDuplicatesWithinWatermark([key])


def arrivals_by_day(stream: DataFrame, arrival: str = "ingested_at", late: str = "30 days") -> DataFrame:
    return stream.withWatermark(arrival, late).groupBy(F.window(arrival, "1 day").alias("day"), "casefile_id").agg(F.count("*").alias("n_records")).select(F.col("day.start").alias("day"), "casefile_id", "n_records")
