"""From metadata and duplicate groups to forecast and backtest files: labels, a scorer, measures, forecast.

A progress callback gets (message, percent).  Tables that several steps read are cached on memory and disk, which Spark
rebuilds from the input where an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.functions import text
from strainlake.operators import backtest, forecast, labels, model
from strainlake.sources import sinks

FEATURES = ("Country", "Master", "Month")
# Countries and years that are forecast where none are named.
COUNTRIES = ("USA", "Canada", "France", "Mexico", "United Kingdom")
YEARS = (2020, 2021, 2022, 2023, 2024, 2025)


def master_dataset(metadata: DataFrame, groups: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Accession, GenBank_Title, Collection_Date, Country, YearMonth, Year, Month, Master, Outbreak of dated rows that belong to a group.

    groups: identifiers and first_ord (or group_ord).  An ``ord`` column of the metadata (file order) is kept.  ValueError if
    metadata lacks a required column.
    """
    order = [F.col("ord")] if "ord" in metadata.columns else []
    rows = text.normalize_metadata(metadata, *order).withColumn("Collection_Date", text.date(F.col("Collection_Date")))
    rows = rows.select("Accession", "GenBank_Title", "Collection_Date", "Country", *order).na.drop(subset=["Accession", "Collection_Date", "Country"])
    rows = rows.withColumns({"YearMonth": F.trunc("Collection_Date", "MM"), "Year": F.year("Collection_Date"), "Month": F.month("Collection_Date")})
    rows = labels.master_rows(rows, labels.masters(groups))
    return labels.labelled(rows, labels.outbreak(rows, threshold))


def learned(rows: DataFrame) -> model.Model:
    """Model of Outbreak from country, strain and month."""
    return model.fit(rows.withColumn("Month", F.col("Month").cast("string")), features=FEATURES)


def report_text(measures: list) -> str:
    """Lines of backtest.classification as a table of fixed width."""
    line = "{:<12}{:>10}{:>10}{:>10}{:>10}".format
    rows = [line(r["class"], *(f"{r[k]:.4f}" for k in ("precision", "recall", "f1")), r["support"]) for r in measures if r["class"] != "r2"]
    return "\n".join([line("class", "precision", "recall", "f1", "support"), *rows])


def run(
    metadata: DataFrame, groups: DataFrame, output: str, countries: Sequence[str] | None = None, years: Sequence[int] | None = None,
    training_years: Sequence[int] | None = None, backtest_year: int = 2025, dominant_year: int | None = None, top_n: int = 3, scorer: forecast.Scorer | None = None,
    progress: Callable[[str, float], None] = lambda message, percent: None,
) -> dict:
    """Writes the forecast (and, where the year has rows, the backtest) as CSV and returns what was found.

    Where none are named, COUNTRIES and YEARS are forecast and all countries backtested; countries without rows are left out.
    Training years count only before the backtest year; dominant_year, if named, takes that year's place.  ValueError if nothing
    is left to learn from.  The scorer defaults to a model learned here, from the sequences as well where the groups have them;
    another one must not need learning.
    """
    backtest_year = dominant_year or backtest_year
    full = master_dataset(metadata, groups).cache()
    learn, test = labels.split_by_time(full, backtest_year, list(training_years) if training_years else None)
    learn = learn.where(F.col("Year") < backtest_year)
    train_rows, test_rows = learn.count(), test.count()
    if not train_rows:
        raise ValueError(f"no rows to learn from before {backtest_year}")
    progress(f"{train_rows} rows to learn from", 15)
    sequences = groups.where(F.size("identifiers") > 0).select(F.get("identifiers", 0).alias("Master"), "sequence") if "sequence" in groups.columns else None
    if scorer:
        score = scorer
    elif sequences is None:
        score = model.scorer(learned(learn))
    else:
        score = model.sequence_scorer(model.fit_sequences(learn.withColumn("Month", F.col("Month").cast("string")), sequences))
    progress("scorer ready", 70)

    report, r2 = "no backtest rows", None
    if test_rows:
        scored = score(test.select("Country", "Month", F.col("Master").alias("Accession"), "Outbreak"))
        measures = backtest.classification(scored, "Outbreak", "Probability").collect()  # six lines
        report, r2 = report_text(measures), next(r["precision"] for r in measures if r["class"] == "r2")
    progress(report, 74)

    chosen = full.where(F.col("Country").isin(list(countries or COUNTRIES)))
    strains = full.select(F.col("Master").alias("Accession")).distinct()
    titles = full.select("Accession", "GenBank_Title", F.struct(*(["ord"] if "ord" in full.columns else ["Collection_Date", "GenBank_Title"])).alias("Title_Order"))
    out = {"output_csv": output, "train_rows": train_rows, "test_rows": test_rows, "backtest_report": report, "r2": r2, "target_year": backtest_year, "training_years": training_years}

    tested = test.where(F.col("Country").isin(list(countries))) if countries else test
    best = forecast.scan(strains, tested.select("Country"), [backtest_year], score, 1)
    compared = backtest.dominant(tested, best, backtest_year)
    one_title = forecast.with_titles(strains, titles)
    compared = backtest.with_both_titles(compared, one_title).cache()
    found = backtest.accuracy(compared).first()
    path = PurePosixPath(output)
    dominant_path = output.removesuffix(path.name) + f"{path.stem}_dominant_backtest_{backtest_year}{path.suffix}"
    if found.compared:
        sinks.write_csv(compared, dominant_path)
    out |= {
        "dominant_summary": f"{found.matches} of {found.compared} dominant strains of {backtest_year} found ({found.accuracy:.1%})",
        "dominant_backtest_csv": dominant_path if found.compared else None,
        "new_backtest_dna_count": compared.agg(F.count_if("Predicted_New_DNA_From_Previous_Dominant")).first()[0],
    }

    best = forecast.scan(strains, chosen.select("Country"), list(years or YEARS), score, top_n)
    shown = forecast.annotate_dominant(forecast.with_titles(best, titles), "GenBank_Title").cache()
    sinks.write_csv(shown, output)
    out |= {"rows": shown.count(), "new_forecast_dna_count": shown.agg(F.count_if("New_DNA_From_Previous_Dominant")).first()[0]}
    progress(f"forecast saved to {output}", 100)
    for df in (shown, compared, full):
        df.unpersist()
    return out
