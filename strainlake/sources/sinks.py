"""Tables and texts to files. Spark writes a folder of part files; each overwrites what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.functions import dna


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nulls are empty, dates ISO."""
    df.write.mode("overwrite").option("header", True).csv(path)


def run_length_lines(records: DataFrame) -> DataFrame:
    """ord, value: header line and run-length text of each record (ord, header, seq)."""
    return records.where("header is not null").select("ord", F.concat_ws("\n", "header", dna.run_length(F.coalesce("seq", F.lit("")))).alias("value"))


def write_run_length(records: DataFrame, path: str) -> None:
    """Text of two lines a record, in order of ord across the part files."""
    run_length_lines(records).orderBy("ord").select("value").write.mode("overwrite").text(path)


def write_fasta(records: DataFrame, path: str, width: int = 70) -> None:
    """FASTA text with lines of at most width bases, in order of ord across the part files."""
    body = F.rtrim(F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    records.orderBy("ord").select(F.concat_ws("\n", F.coalesce("header", F.concat(F.lit(">"), F.col("id"))), F.nullif(body, F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def write_training_set(rows: DataFrame, path: str) -> None:
    """text, labels of labels.training_set as Parquet."""
    rows.select("text", "labels").write.mode("overwrite").parquet(path)
