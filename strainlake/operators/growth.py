"""Rising and falling strains of a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.functions.text import number

COLUMNS = ("Year", "Month", "Country", "Accession", "Probability")


def prepared(df: DataFrame, country: str | None = None) -> DataFrame:
    """Numbers of Year, Month and Probability, rows without them removed, Time_Index; country matches in any case."""
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    d = df.withColumns({"Year": number(F.col("Year").cast("string")).cast("int"), "Month": number(F.col("Month").cast("string")).cast("int"), "Probability": number(F.col("Probability").cast("string"))})
    d = d.na.drop(subset=list(COLUMNS))
    if country and country.strip():
        d = d.where(F.lower("Country") == country.strip().lower())
    return d.withColumn("Time_Index", F.col("Year") * 12 + F.col("Month"))


def trends(df: DataFrame, title: str | None = None, width: int = 120) -> DataFrame:
    """First, last and highest probability of each country and accession seen at least twice; the first of equal peaks counts."""
    own = W.partitionBy("Country", "Accession")
    ranked = df.withColumns(
        {
            "__first": F.row_number().over(own.orderBy("Time_Index", "Probability")),
            "__last": F.row_number().over(own.orderBy(F.desc("Time_Index"), F.desc("Probability"))),
            "__peak": F.row_number().over(own.orderBy(F.desc("Probability"), "Time_Index")),
        }
    )
    at = lambda rank, value: F.max(F.when(F.col(rank) == 1, value))
    label = F.format_string("%d-%02d", "Year", "Month")
    out = ranked.groupBy("Country", "Accession").agg(
        F.count("*").alias("__n"), at("__first", F.col("Probability")).alias("Start_Prob"), at("__last", F.col("Probability")).alias("End_Prob"),
        at("__peak", F.col("Probability")).alias("Peak_Prob"), at("__peak", label).alias("Peak_Label"),
        *([F.substring(F.coalesce(at("__last", F.col(title)), at("__first", F.col(title))), 1, width).alias("Title")] if title else []),
    )
    return out.where("__n >= 2").drop("__n").withColumn("Delta", F.col("End_Prob") - F.col("Start_Prob"))


def rising(trend: DataFrame, n: int = 10) -> DataFrame:
    return trend.orderBy(F.desc("Delta"), "Country", "Accession").limit(n)


def falling(trend: DataFrame, n: int = 10) -> DataFrame:
    return trend.orderBy("Delta", "Country", "Accession").limit(n)


def dominant_by_month(df: DataFrame) -> DataFrame:
    """Most probable accession of each country and month; ties go to the smallest accession."""
    first = F.row_number().over(W.partitionBy("Country", "Year", "Month").orderBy(F.desc("Probability"), "Accession"))
    return df.withColumn("__n", first).where("__n = 1").select("Country", "Year", "Month", "Accession", "Probability")


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("Country").alias("countries"), F.countDistinct("Accession").alias("accessions"), F.count("*").alias("n"), F.min("Time_Index").alias("first_month"), F.max("Time_Index").alias("last_month"))


def report(trend: DataFrame, limit: int = 250) -> DataFrame:
    """Fixed-width lines of the rising strains, and how many are left out."""
    number_ = F.row_number().over(W.orderBy(F.desc("Delta"), "Country", "Accession"))
    top = trend.orderBy(F.desc("Delta"), "Country", "Accession").limit(limit).withColumn("line_no", number_)
    lines = top.select("line_no", F.format_string("%-20s %-20s %8.4f %8.4f %+8.4f", F.substring("Country", 1, 20), F.substring("Accession", 1, 20), "Start_Prob", "End_Prob", "Delta").alias("line"))
    rest = trend.agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return lines.unionByName(rest.select(F.lit(limit + 1).alias("line_no"), F.format_string("... %d more", F.col("n") - limit).alias("line")))


def trend_line(title_width: int = 72) -> Column:
    """A trend row as a line of fixed width."""
    return F.concat(
        F.rpad(F.substring("Country", 1, 20), 20, " "), F.lit("  "), F.rpad(F.substring("Accession", 1, 18), 18, " "),
        F.format_string("  %7.4f  %7.4f  %+8.4f  %.4f@%s  %s", "Start_Prob", "End_Prob", "Delta", "Peak_Prob", "Peak_Label", F.substring("Title", 1, title_width)),
    )


# Headings of the report's parts, and widths of the rules under them.
RISING, FALLING = "FASTEST RISING STRAINS", "FASTEST FALLING STRAINS"
TREND_HEAD, TREND_RULE = "Country              Accession           Start    End      Delta    Peak", 82
DOMINANT_HEAD, DOMINANT_RULE = "Country              Date      Accession           Probability  Title", 100


def _lines(spark, part: int, lines: list[str]) -> DataFrame:
    rows = [(part, k, x) for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, "part int, line_no int, line string")


def full_report(df: DataFrame, country: str | None = None, top_n: int = 10, title: str | None = None, dominant_rows: int = 250) -> DataFrame:
    """part, line_no, line of the whole report on a forecast: rows and filter, rising and falling strains, the dominant strain of
    each month (dominant_rows lines and how many are left out), a summary; ordered by part, then line_no.

    ValueError if no row is left, or no strain has two.
    """
    spark, rows = df.sparkSession, prepared(df, country)
    found = summary(rows).first()
    if not found.n:
        raise ValueError("no rows of a forecast are left")
    trend = trends(rows, title)
    if not title:
        trend = trend.withColumn("Title", F.lit(""))
    trend = trend.withColumn("Title", F.coalesce("Title", F.lit("")))
    if trend.isEmpty():
        raise ValueError("no strain has two rows")

    def numbered(part: int, first: DataFrame, order: list[Column]) -> DataFrame:
        return first.withColumn("line_no", F.row_number().over(W.orderBy(*order)) - 1).select(F.lit(part).alias("part"), "line_no", trend_line().alias("line"))

    names = [F.col("Country"), F.col("Accession")]
    parts = [
        _lines(spark, 0, [f"Rows analyzed: {found.n:,}", f"Country filter: {country or 'All Countries'}", "", RISING, TREND_HEAD, "-" * TREND_RULE]),
        numbered(1, rising(trend, top_n), [F.desc("Delta"), *names]),
        _lines(spark, 2, ["", FALLING, TREND_HEAD, "-" * TREND_RULE]),
        numbered(3, falling(trend, top_n), [F.asc("Delta"), *names]),
        _lines(spark, 4, [DOMINANT_HEAD, "-" * DOMINANT_RULE]),
    ]
    months = ["Country", "Year", "Month"]
    best = F.row_number().over(W.partitionBy(*months).orderBy(F.desc("Probability"), "Accession"))
    dominant = rows.withColumn("__n", best).where("__n = 1")
    shown = F.substring(F.coalesce(F.col(title), F.lit("")), 1, 42) if title else F.lit("")
    line = F.concat(
        F.rpad(F.substring("Country", 1, 20), 20, " "), F.format_string("  %d-%02d  ", "Year", "Month"), F.rpad(F.substring("Accession", 1, 18), 18, " "),
        F.format_string("  %10.4f  ", "Probability"), shown,
    )
    top = dominant.orderBy(*months).limit(dominant_rows).withColumn("line_no", F.row_number().over(W.orderBy(*months)) - 1)
    left_out = dominant.agg(F.count("*").alias("n")).where(F.col("n") > dominant_rows)
    parts += [
        top.select(F.lit(5).alias("part"), "line_no", line.alias("line")),
        left_out.select(F.lit(6).alias("part"), F.lit(0).alias("line_no"), F.concat(F.lit("... "), F.format_number(F.col("n") - dominant_rows, 0), F.lit(" more rows not shown")).alias("line")),
        _lines(spark, 7, [f"Analyzed {found.n:,} forecast rows across {found.countries:,} countries and {found.accessions:,} strains."]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
