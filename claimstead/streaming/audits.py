"""Audits of arriving subjects: the batch projection on a stream, and windowed counts of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.plans.audit import audit, summary

ARRIVAL = "subject_id long, subject_name string, text string, arrived timestamp"


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of subjects, file by file."""
    return spark.readStream.schema(ARRIVAL).json(path)


def audited(stream: DataFrame, now_year: int) -> DataFrame:
    """Append-only; a subject delivered again within a day is dropped."""
    once = stream.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["subject_id"])
    return audit(once, now_year)


def level_counts(stream: DataFrame, now_year: int, width: str = "1 day") -> DataFrame:
    rows = audit(stream.withWatermark("arrived", "1 day"), now_year)
    return rows.groupBy(F.window("arrived", width), F.col("verdict.level").alias("level")).count()


__all__ = ["ARRIVAL", "arrivals", "audited", "level_counts", "summary"]
