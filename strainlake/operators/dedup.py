"""Groups of identical sequences, their summary, and their join with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.functions import dna


def group_sequences(records: DataFrame, ord: str = "ord", id: str = "id", seq: str = "seq") -> DataFrame:
    """seq_hash, seq_length, count, identifiers (in file order), first_ord of each cleaned sequence; empty ones are left out.

    Grouped by hash, so genomes are no shuffle keys; ``sequences`` joins them back.
    """
    cleaned = records.select(F.col(ord).alias("ord"), F.col(id).alias("id"), dna.clean(F.col(seq)).alias("seq")).where("seq <> ''")
    keyed = cleaned.select("ord", "id", F.sha2("seq", 256).alias("seq_hash"), F.length("seq").cast("long").alias("seq_length"))
    return keyed.groupBy("seq_hash", "seq_length").agg(
        F.count("*").alias("count"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("identifiers"),
        F.min("ord").alias("first_ord"),
    )


def members(records: DataFrame, ord: str = "ord", id: str = "id", seq: str = "seq") -> DataFrame:
    """seq_hash, ord, id, Master (the group's first identifier in file order) of each record with a sequence.

    The long form of groups: no row holds a group, however large it is.
    """
    keyed = records.select(F.sha2(dna.clean(F.col(seq)), 256).alias("seq_hash"), F.col(ord).alias("ord"), F.col(id).alias("id")).where(F.col("seq_hash") != F.sha2(F.lit(""), 256))
    first = keyed.groupBy("seq_hash").agg(F.min_by("id", F.struct("ord", "id")).alias("Master"))
    return keyed.join(first, "seq_hash")


def ranked(groups: DataFrame) -> DataFrame:
    """Groups, largest count first, then the longest, then in file order."""
    return groups.orderBy(F.desc("count"), F.desc("seq_length"), "first_ord")


def summary(records: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: total, unique, duplicates and their percentage (0 for none); sequences that clean to nothing don't count."""
    keyed = records.select(F.sha2(dna.clean(F.col(seq)), 256).alias("h")).where(F.col("h") != F.sha2(F.lit(""), 256))
    counts = keyed.groupBy("h").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("unique_n"))
    rest = F.col("total") - F.col("unique_n")
    return counts.select("total", "unique_n", rest.alias("duplicates"), F.coalesce(F.try_divide(100.0 * rest, F.col("total")), F.lit(0.0)).alias("duplicate_percent"))


def uniqueness(records: DataFrame, top: int = 10, ord: str = "ord", seq: str = "seq") -> DataFrame:
    """The most repeated sequences: count descending, ties in file order."""
    groups = group_sequences(records, ord, ord, seq).where("count > 1")
    return groups.orderBy(F.desc("count"), "first_ord").limit(top)


def last_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def enrich(groups: DataFrame, metadata: DataFrame, key: str = "Accession", ord: str = "ord") -> DataFrame:
    """groups with metadata_by_accession (map of structs); of repeated accessions the last row counts."""
    rows = last_by(metadata.where(F.col(key).isNotNull()), key, F.desc(ord))
    values = [c for c in metadata.columns if c not in (key, ord)]
    members = groups.select("seq_hash", F.explode("identifiers").alias("__id")).distinct()
    found = members.join(rows, F.col("__id") == F.col(key)).groupBy("seq_hash").agg(F.map_from_entries(F.collect_list(F.struct(F.col("__id"), F.struct(*values)))).alias("metadata_by_accession"))
    return groups.join(found, "seq_hash", "left")


def enrichment_summary(groups: DataFrame, metadata: DataFrame, key: str = "Accession") -> DataFrame:
    """One row: groups, enriched groups, distinct matched and missing identifiers."""
    members = groups.select("seq_hash", F.explode("identifiers").alias("__id"))
    known = metadata.select(F.col(key).alias("__id"), F.lit(True).alias("__known")).where("__id is not null").distinct()
    j = members.join(known, "__id", "left")
    by_id = j.groupBy("__id").agg(F.max("__known").alias("known")).agg(F.count_if("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("missing"))
    by_group = j.groupBy("seq_hash").agg(F.max("__known").alias("known")).agg(F.count("*").alias("entries"), F.count_if("known").alias("enriched"))
    return by_group.crossJoin(by_id)  # one row each
