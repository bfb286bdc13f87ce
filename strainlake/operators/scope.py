"""Countries and years that metadata and duplicate groups cover, and the parameters that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainlake.functions.text import country, loosely, year_of

# Loose names of the metadata's columns, and keys of a group's metadata, in order of preference.
RELEASE_NAMES = ("releasedate",)
DATE_NAMES = ("isolatecollectiondate", "collectiondate", "year")
COUNTRY_NAMES = ("geolocation", "geographiclocation", "country")
DATE_KEYS = ("isolate-collection-date", "collection_date", "year")
COUNTRY_KEYS = ("geo-location", "geo_location", "country")


def _years(value: Column) -> Column:
    return F.collect_set(year_of(value.cast("string")))


def _sorted(countries: Column) -> Column:
    """Countries in the order of their lower-case form."""
    return F.transform(F.array_sort(F.transform(countries, lambda c: F.struct(F.lower(c), c.alias("c")))), lambda x: x["c"])


def infer(metadata: DataFrame, date: str | None, place: str | None, release: str | None = None) -> DataFrame:
    """One row: sorted years (of release dates if there are any, else of collection dates) and countries."""
    of = lambda name: F.lit(None).cast("string") if name is None else F.col(f"`{name}`")
    both = metadata.agg(_years(of(release or date)).alias("released"), _years(of(date)).alias("collected"), F.collect_set(country(of(place))).alias("countries"))
    years = F.when(F.size("released") > 0, F.col("released")).otherwise(F.col("collected"))
    return both.select(F.array_sort(years).alias("years"), _sorted(F.col("countries")).alias("countries"))


def infer_from_groups(groups: DataFrame) -> DataFrame:
    """One row: years and countries of the metadata in duplicate groups (metadata_by_accession: map of maps)."""
    one = groups.select(F.explode(F.map_values("metadata_by_accession")).alias("m"))
    first = lambda keys: F.coalesce(*[F.nullif(F.trim(F.col("m")[k]), F.lit("")) for k in keys])
    both = one.agg(_years(first(DATE_KEYS)).alias("years"), F.collect_set(country(first(COUNTRY_KEYS))).alias("countries"))
    return both.select(F.array_sort("years").alias("years"), _sorted(F.col("countries")).alias("countries"))


def infer_all(metadata: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row: years and countries of metadata, whose columns are found by loose names; where either is empty, those of the
    groups' metadata are added to both."""
    names = [loosely(metadata.columns, x) for x in (DATE_NAMES, COUNTRY_NAMES, RELEASE_NAMES)]
    own = infer(metadata, *names)
    if groups is None:
        return own
    both = own.alias("a").crossJoin(infer_from_groups(groups).alias("b"))  # one row each
    lacks = (F.size("a.years") == 0) | (F.size("a.countries") == 0)
    with_both = lambda c: F.when(lacks, F.array_union(f"a.{c}", f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return both.select(F.array_sort(with_both("years")).alias("years"), _sorted(with_both("countries")).alias("countries"))


def parameters(scope: DataFrame) -> DataFrame:
    """Forecast span, training span and the year that is tested, as text."""
    first, last = F.array_min("years"), F.array_max("years")
    before = F.get("years", F.size("years") - 2)
    return scope.select(
        F.concat_ws("-", first.cast("string"), last.cast("string")).alias("forecast_years"),
        F.when(F.size("years") > 1, F.concat_ws("-", first.cast("string"), before.cast("string"))).alias("training_years"),
        last.cast("string").alias("backtest_year"),
        F.array_join("countries", ",").alias("countries"),
    )
