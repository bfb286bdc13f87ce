"""Predicted against observed dominant strains, and the measures of a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.functions.text import changed


#: Ranges of the probability, each sorted on its own, that the area under a curve is summed over.
AUC_RANGES = 10_000


def actual_dominant(rows: DataFrame) -> DataFrame:
    """Country, Month, Actual_Accession, Actual_Count and the one before; ties go to the smallest accession."""
    counted = rows.groupBy("Country", "Month", "Master").agg(F.count("*").alias("Actual_Count"))
    first = F.row_number().over(W.partitionBy("Country", "Month").orderBy(F.desc("Actual_Count"), "Master"))
    top = counted.withColumn("__n", first).where("__n = 1").select("Country", "Month", F.col("Master").alias("Actual_Accession"), "Actual_Count")
    return top.withColumn("Previous_Actual_Dominant_Accession", F.lag("Actual_Accession").over(W.partitionBy("Country").orderBy("Month")))


def dominant(rows: DataFrame, scored: DataFrame, year: int, countries: list[str] | None = None) -> DataFrame:
    """One row for each country and month of the year with observations: predicted and actual dominant strain.

    rows: Country, Year, Month, Master; scored: Country, Month, Accession, Probability.
    """
    rows = rows.where(F.col("Year") == year)
    if countries:
        rows = rows.where(F.col("Country").isin(countries))
    actual = actual_dominant(rows)
    first = F.row_number().over(W.partitionBy("Country", "Month").orderBy(F.desc("Probability"), "Accession"))
    best = scored.withColumn("__n", first).where("__n = 1").select("Country", "Month", F.col("Accession").alias("Predicted_Accession"), F.col("Probability").alias("Predicted_Probability"))
    j = actual.join(best, ["Country", "Month"]).withColumn("Year", F.lit(year))
    j = j.withColumn("Previous_Predicted_Dominant_Accession", F.lag("Predicted_Accession").over(W.partitionBy("Country").orderBy("Month")))
    return j.withColumns(
        {
            "Match": F.col("Predicted_Accession") == F.col("Actual_Accession"),
            "Actual_New_DNA_From_Previous_Dominant": changed(F.col("Previous_Actual_Dominant_Accession"), F.col("Actual_Accession")),
            "Predicted_New_DNA_From_Previous_Dominant": changed(F.col("Previous_Predicted_Dominant_Accession"), F.col("Predicted_Accession")),
        }
    )


def with_both_titles(backtest: DataFrame, titles: DataFrame) -> DataFrame:
    """Predicted_Title and Actual_Title; titles: Accession, GenBank_Title, one row each."""
    for side in ("Predicted", "Actual"):
        backtest = backtest.join(titles.select(F.col("Accession").alias(f"{side}_Accession"), F.col("GenBank_Title").alias(f"{side}_Title")), f"{side}_Accession", "left")
    return backtest


def accuracy(backtest: DataFrame) -> DataFrame:
    """One row: compared, matches, accuracy (0 for none)."""
    return backtest.agg(F.count("*").alias("compared"), F.count_if("Match").alias("matches"), F.coalesce(F.avg(F.col("Match").cast("int")), F.lit(0.0)).alias("accuracy"))


def _rate(top: Column, under: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), under.cast("double")), F.lit(0.0))


def classification(scored: DataFrame, label: str, probability: str, cut: float = 0.5) -> DataFrame:
    """class, precision, recall, f1, support of both classes and of accuracy, macro and weighted averages, r2; 0 where undefined."""
    y, p = F.col(label), (F.col(probability) > cut).cast("int")
    count = lambda a, b: F.count_if((y == a) & (p == b))
    c = scored.agg(
        count(0, 0).alias("n00"), count(0, 1).alias("n01"), count(1, 0).alias("n10"), count(1, 1).alias("n11"),
        F.sum((y - F.col(probability)) ** 2).alias("rest"), (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)).alias("spread"),
    )

    def of(k: int) -> Column:
        hit, wrong, missed = f"n{k}{k}", f"n{1 - k}{k}", f"n{k}{1 - k}"
        pr, re = _rate(F.col(hit), F.col(hit) + F.col(wrong)), _rate(F.col(hit), F.col(hit) + F.col(missed))
        return F.struct(F.lit(str(k)).alias("class"), pr.alias("precision"), re.alias("recall"), _rate(2 * pr * re, pr + re).alias("f1"), (F.col(hit) + F.col(missed)).alias("support"))

    both = c.withColumns({"k0": of(0), "k1": of(1), "n": F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")})
    mean = lambda f: ((F.col(f"k0.{f}") + F.col(f"k1.{f}")) / 2).alias(f)
    share = lambda f: _rate(F.col(f"k0.{f}") * F.col("k0.support") + F.col(f"k1.{f}") * F.col("k1.support"), F.col("n")).alias(f)
    exact, r2 = _rate(F.col("n00") + F.col("n11"), F.col("n")), F.lit(1.0) - F.try_divide(F.col("rest"), F.col("spread").cast("double"))
    line = lambda name, cols: F.struct(F.lit(name).alias("class"), *cols, F.col("n").alias("support"))
    same = lambda x: [x.alias(f) for f in ("precision", "recall", "f1")]
    lines = [F.col("k0"), F.col("k1"), line("accuracy", same(exact)), line("macro", [mean(f) for f in ("precision", "recall", "f1")]), line("weighted", [share(f) for f in ("precision", "recall", "f1")]), line("r2", same(r2))]
    return both.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def log_loss(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """One row: mean binary cross-entropy, probabilities kept 1e-7 away from 0 and 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-7)), F.lit(1 - 1e-7))
    return scored.agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def auc(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """One row: area under the ROC curve, equal probabilities counting half; null unless both classes are there.

    Counted by probability first: over distinct values, sorted by range, each adds its positives times the negatives below.
    """
    by_value = scored.where(F.col(label).isNotNull() & F.col(probability).isNotNull()).groupBy(F.col(probability).alias("p")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("pos"), F.count_if(F.col(label) != 1).cast("double").alias("neg")
    )
    # ranges of values, as many as fit a task each, and the negatives of the ranges before
    ranges = by_value.withColumn("range", F.floor(F.col("p") * AUC_RANGES))
    below = ranges.groupBy("range").agg(F.sum("neg").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("own")
    inside = F.coalesce(F.sum("neg").over(W.partitionBy("range").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    each = ranges.join(F.broadcast(below), "range").withColumn("won", F.col("pos") * (F.col("before") + inside + F.col("neg") / 2))
    total = each.agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(F.try_divide("won", F.col("pos") * F.col("neg")).alias("auc"))
