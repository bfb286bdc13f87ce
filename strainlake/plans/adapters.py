"""The shared test tables in the roles of surveillance data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surveillance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country, YearMonth, Year, Month, Master, Accession of each line item: its supplier's nation, month and brand."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("d"))
    rows = rows.join(t("supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.expr("s_nationkey = n_nationkey"))
    rows = rows.join(t("part").select("p_partkey", "p_brand", "p_name"), F.expr("l_partkey = p_partkey"))
    return rows.select(
        F.col("n_name").alias("Country"), F.trunc("d", "MM").alias("YearMonth"), F.year("d").alias("Year"), F.month("d").alias("Month"), F.col("p_brand").alias("Master"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("Accession"), F.col("p_name").alias("Title"), "l_orderkey", "l_linenumber",
    )


SURVEILLANCE = """surveillance AS (
  SELECT n_name AS Country, CAST(date_trunc('month', l_shipdate) AS DATE) AS YearMonth, CAST(year(l_shipdate) AS INT) AS Year, CAST(month(l_shipdate) AS INT) AS Month,
    p_brand AS Master, l_orderkey || '-' || l_linenumber AS Accession, p_name AS Title, l_orderkey, l_linenumber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, seq of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.col("text").alias("seq"))


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country, Accession, Year, Month, Probability of each event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("Country"), F.col("event_type").alias("Accession"), F.year("ts").alias("Year"), F.month("ts").alias("Month"), F.dayofmonth("ts").alias("Day"), F.col("value").alias("Probability"), "event_id")
