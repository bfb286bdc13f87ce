"""Scoring of every strain, country and month; the best of each month, and shifts of the dominant one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.functions.text import changed

#: A scorer adds Probability to rows of Country, Month and Accession.
Scorer = Callable[[DataFrame], DataFrame]
#: Rows of (country, month) up to which they are sent to the accessions instead of shuffled with them.
BROADCAST_ROWS = 100_000


def scan(accessions: DataFrame, countries: DataFrame, years: Sequence[int], scorer: Scorer, top_n: int = 3) -> DataFrame:
    """Year, Month, Country, Accession, Probability: the top_n accessions of each country and month, ties by accession.

    Scores don't depend on the year, so each (country, month, accession) is scored and ranked once; years join the few that are left.
    """
    months = countries.select("Country").distinct().withColumn("Month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    small = months.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    pairs = accessions.select("Accession").distinct().join(F.broadcast(months) if small else months)
    scored = scorer(pairs)
    best = F.row_number().over(W.partitionBy("Country", "Month").orderBy(F.desc("Probability"), "Accession"))
    kept = scored.withColumn("__n", best).where(F.col("__n") <= top_n)
    return kept.select(F.explode(F.array(*map(F.lit, years))).alias("Year"), "Month", "Country", "Accession", "Probability")


def with_titles(forecast: DataFrame, metadata: DataFrame, order: str = "Title_Order") -> DataFrame:
    """GenBank_Title of the accession's first metadata row."""
    first = F.row_number().over(W.partitionBy("Accession").orderBy(order))
    titles = metadata.withColumn("__n", first).where("__n = 1").select("Accession", "GenBank_Title")
    return forecast.join(titles, "Accession", "left")


def annotate_dominant(forecast: DataFrame, title: str | None = None) -> DataFrame:
    """Dominant accession of each country and month, the one before, and whether it is new; null-safe, false off the top row."""
    own = W.partitionBy("Country", "Year", "Month").orderBy(F.desc("Probability"), "Accession")
    top = forecast.withColumn("__n", F.row_number().over(own)).where("__n = 1")
    before = W.partitionBy("Country").orderBy("Year", "Month")
    notes = top.select(
        "Country", "Year", "Month",
        F.col("Accession").alias("Dominant_Accession"),
        F.lag("Accession").over(before).alias("Previous_Dominant_Accession"),
        *([F.lag(title).over(before).alias("Previous_Dominant_Title")] if title else []),
    )
    out = forecast.join(notes, ["Country", "Year", "Month"], "left")
    dominant = F.col("Accession") == F.col("Dominant_Accession")
    return out.withColumns(
        {
            "Is_Dominant_Prediction": F.coalesce(dominant, F.lit(False)),
            "New_DNA_From_Previous_Dominant": F.coalesce(dominant & changed(F.col("Previous_Dominant_Accession"), F.col("Dominant_Accession")), F.lit(False)),
        }
    )


def hashed_score(a: Column, month: Column, b: Column) -> Column:
    """A deterministic score in [0, 1) from numbers, for tests and cross-checks."""
    return ((a * 7919 + month * 104729 + b * 1299709) % 100003).cast("double") / F.lit(100003.0)
