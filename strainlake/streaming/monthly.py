"""Monthly counts of each strain, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_counts(rows: DataFrame, time: str, strain: str) -> DataFrame:
    """month, Master, n."""
    return rows.groupBy(F.trunc(F.to_date(time), "MM").alias("month"), F.col(strain).alias("Master")).agg(F.count("*").alias("n"))


def daily_counts(rows: DataFrame, time: str, strain: str, late: str = "2 days") -> DataFrame:
    """day, Master, n of a stream; a day is final once the watermark has passed it, and months add up days."""
    windowed = rows.withWatermark(time, late).groupBy(F.window(time, "1 day"), F.col(strain).alias("Master"))
    return windowed.agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), "Master", "n")
