"""Monthly strain frequencies and the labels that models learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Kinds of virus that have variants.
VIRUS_A, VIRUS_B = "Influenza A", "Influenza B"


def strain_counts(rows: DataFrame) -> DataFrame:
    """Country, YearMonth, Master, Count, Total, Freq; rows with a null key don't count.

    Counted first, then summed over the counts: no row passes through a window.
    """
    counted = rows.na.drop(subset=["Country", "YearMonth", "Master"]).groupBy("Country", "YearMonth", "Master").agg(F.count("*").alias("Count"))
    total = F.sum("Count").over(W.partitionBy("Country", "YearMonth"))
    return counted.withColumn("Total", total).withColumn("Freq", F.col("Count").cast("double") / F.col("Total").cast("double"))


def outbreak(rows: DataFrame, threshold: float = 0.05, calendar_adjacent: bool = False, drop_unlabeled: bool = False) -> DataFrame:
    """strain_counts with Next_Month_Freq (of the next month seen) and Outbreak (whether that reaches the threshold).

    A strain's last month has no next one and label 0; drop_unlabeled removes it, calendar_adjacent lets only the month right after count.
    """
    freq = strain_counts(rows)
    own = W.partitionBy("Country", "Master").orderBy("YearMonth")
    following = F.lead("Freq").over(own)
    if calendar_adjacent:
        following = F.when(F.lead("YearMonth").over(own) == F.add_months("YearMonth", 1), following)
    out = freq.withColumn("Next_Month_Freq", following).withColumn("Outbreak", F.when(F.col("Next_Month_Freq") >= threshold, 1).otherwise(0))
    return out.where("Next_Month_Freq is not null") if drop_unlabeled else out


def master_rows(metadata: DataFrame, masters: DataFrame) -> DataFrame:
    """Metadata rows with their group's Master (Accession, Master); rows without one are left out."""
    return metadata.join(masters, "Accession")


def masters(groups: DataFrame) -> DataFrame:
    """Accession, Master (first identifier of the group); an accession in several groups belongs to the last of the document.

    The document's order is that of group_ord where the groups have it, else largest count first, then the longest, then file order.
    """
    if "group_ord" in groups.columns:
        place = F.struct(F.col("group_ord").cast("bigint").alias("a"))
    elif {"count", "seq_length"} <= set(groups.columns):
        place = F.struct((-F.col("count")).alias("a"), (-F.col("seq_length")).alias("b"), F.col("first_ord").alias("c"))
    else:
        place = F.struct(F.col("first_ord").alias("a"))
    rows = groups.where(F.size("identifiers") > 0).select(place.alias("place"), F.get("identifiers", 0).alias("Master"), F.explode("identifiers").alias("Accession"))
    return rows.groupBy("Accession").agg(F.max_by("Master", "place").alias("Master"))


def with_sequences(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows whose Master has a sequence (Master, sequence) that cleans to something."""
    from strainlake.functions.dna import clean

    known = sequences.where(clean(F.col("sequence")) != "").select("Master").distinct()
    return rows.join(known, "Master", "left_semi")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the label of their country, month and strain."""
    return rows.join(labels.select("Country", "YearMonth", "Master", "Outbreak"), ["Country", "YearMonth", "Master"])


def encode(rows: DataFrame, column: str, to: str) -> DataFrame:
    """value, id: the sorted distinct values numbered from 0. The dictionary is numbered, not the rows."""
    values = rows.select(F.col(column).alias(column)).where(F.col(column).isNotNull()).distinct()
    return values.withColumn(to, F.row_number().over(W.orderBy(column)) - 1)


def with_codes(rows: DataFrame, column: str, to: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Rows with the number of their value in the dictionary (that of ``encode`` by default); values not in it are left out."""
    return rows.join(encode(rows, column, to) if dictionary is None else dictionary, column)


def _cells(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=["Country", "YearMonth", "Variant"]).groupBy("Country", "YearMonth", "Variant").agg(F.count("*").alias("n"))


def dpgr_observed(rows: DataFrame) -> DataFrame:
    """Country, YearMonth, Variant, f (share of the month's rows), labels of each cell that has rows.

    labels: change of the variant's share to the country's next month, in which an absent variant has share 0; 0 in its last
    month.  Work and result are in proportion to the cells seen.
    """
    cells = _cells(rows).withColumn("f", F.col("n").cast("double") / F.sum("n").over(W.partitionBy("Country", "YearMonth")).cast("double"))
    months = cells.select("Country", "YearMonth").distinct().withColumn("Next", F.lead("YearMonth").over(W.partitionBy("Country").orderBy("YearMonth")))
    ahead = cells.select("Country", F.col("YearMonth").alias("Next"), "Variant", F.col("f").alias("f_next"))
    j = cells.join(months, ["Country", "YearMonth"]).join(ahead, ["Country", "Next", "Variant"], "left")
    change = F.when(F.col("Next").isNull(), 0.0).otherwise(F.coalesce("f_next", F.lit(0.0)) - F.col("f"))
    return j.select("Country", "YearMonth", "Variant", "f", change.alias("labels"))


def dpgr_changes(rows: DataFrame) -> DataFrame:
    """Country, YearMonth, Variant, labels of the cells in which a share can change: those seen and those of the month before one seen.

    All other cells of the grid have label 0.  Work and result are in proportion to the cells seen.
    """
    cells = _cells(rows).withColumn("f", F.col("n").cast("double") / F.sum("n").over(W.partitionBy("Country", "YearMonth")).cast("double"))
    own = W.partitionBy("Country").orderBy("YearMonth")
    months = cells.select("Country", "YearMonth").distinct().withColumns({"before": F.lag("YearMonth").over(own), "last": F.lead("YearMonth").over(own).isNull()})
    # a share counts against its month, unless that is the country's last, and for the month before
    j = cells.join(months, ["Country", "YearMonth"])
    parts = F.array(F.struct("YearMonth", F.when(F.col("last"), 0.0).otherwise(-F.col("f")).alias("x")), F.struct(F.col("before").alias("YearMonth"), F.col("f").alias("x")))
    each = j.select("Country", "Variant", F.explode(parts).alias("p")).select("Country", "p.YearMonth", "Variant", "p.x").where("YearMonth is not null")
    return each.groupBy("Country", "YearMonth", "Variant").agg(F.sum("x").alias("labels"))


def dpgr(rows: DataFrame) -> DataFrame:
    """Country, YearMonth, Variant, labels: change of a variant's share to the country's next month, 0 at its end.

    Dense: every month seen in a country, with every variant seen anywhere; an absent one has share 0.  Its size is that of the
    grid, which only receives the labels of dpgr_changes; ``training_set`` needs only the cells of dpgr_observed.
    """
    changes, seen = dpgr_changes(rows), _cells(rows)
    grid = seen.select("Country", "YearMonth").distinct().crossJoin(seen.select("Variant").distinct())
    return grid.join(changes, ["Country", "YearMonth", "Variant"], "left").select("Country", "YearMonth", "Variant", F.coalesce("labels", F.lit(0.0)).alias("labels"))


def training_set(rows: DataFrame) -> DataFrame:
    """text, labels of rows of Virus_Type, Organism_Name, GenBank_Title, Country, Collection_Date, sequence.

    Rows without date, country or sequence are left out; a row has the label of its country, month and variant, 0 without one.
    """
    from strainlake.functions import text

    dated = rows.withColumn("YearMonth", F.trunc(text.date(F.col("Collection_Date").cast("string")), "MM")).na.drop(subset=["YearMonth", "sequence", "Country"])
    kind = F.col("Virus_Type")
    short = F.when(kind == VIRUS_B, "B").when(kind == VIRUS_A, "A").otherwise("")
    dated = dated.withColumn("Variant", text.lineage(short, F.col("Organism_Name"), F.col("GenBank_Title")))
    found = dated.join(dpgr_observed(dated).drop("f"), ["Country", "YearMonth", "Variant"], "left")
    line = text.training_text(kind, F.col("Country"), F.col("Variant"), F.col("sequence"))
    return found.select(line.alias("text"), F.coalesce("labels", F.lit(0.0)).alias("labels"))


def split_by_time(rows: DataFrame, target: int, training: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from (the training years, else all years before target) and rows of the target year."""
    learn = rows.where(F.col("Year").isin(training)) if training else rows.where(F.col("Year") < target)
    return learn, rows.where(F.col("Year") == target)


def split_by_month(rows: DataFrame, cutoff: str = "2025-01") -> tuple[DataFrame, DataFrame]:
    """Rows of months before the cutoff (yyyy-MM), to learn from, and of that month and later."""
    first = F.lit(f"{cutoff}-01").cast("date")
    return rows.where(F.col("YearMonth") < first), rows.where(F.col("YearMonth") >= first)


def split_by_key(rows: DataFrame, key: str, share: float = 0.98, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from (about that share) and to test on, by a hash of seed and key, so that reruns agree; a null key is a key."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    return rows.where(at < share * (1 << 30)), rows.where(at >= share * (1 << 30))
