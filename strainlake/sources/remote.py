"""Predicates of a remote catalog as filters that reach the scan."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.functions.text import ANY_DATE, RELATIVE_DAYS, relative_date

# Viruses with their taxa, and places; the first place adds no filter.
TAXA = {
    "Influenza A virus": "11320",
    "Influenza A H3N2": "41857",
    "Influenza A H1N1": "114727",
    "Influenza A H5N1": "102793",
    "Influenza A H7N9": "1332244",
    "Influenza B virus": "11520",
    "SARS-CoV-2": "sars-cov-2",
    "MERS-CoV": "1335626",
    "RSV (Respiratory Syncytial Virus)": "12814",
    "Ebola virus": "186536",
    "Zika virus": "64320",
    "Dengue virus": "12637",
    "Mpox (Monkeypox)": "10244",
    "HIV-1": "11676",
    "Hepatitis B virus": "10407",
    "Hepatitis C virus": "11103",
}
LOCATIONS = (
    "Any Location", "USA", "United Kingdom", "China", "Japan", "India", "Brazil", "Australia", "Germany", "France", "South Africa", "Canada",
    "Mexico", "South Korea", "Italy", "Spain", "Africa", "Asia", "Europe", "North America", "South America", "Oceania",
)
ANYWHERE = LOCATIONS[0]
#: Columns that are compared in lower case, and the suffix of their stored keys.
KEYED, KEY = ("Taxon", "Country", "Completeness"), "_Key"


def keyed(metadata: DataFrame) -> DataFrame:
    """Metadata with a lower-case key for each column of KEYED that it has; stored so, a selection's filters reach the scan."""
    return metadata.withColumns({c + KEY: F.lower(c) for c in KEYED if c in metadata.columns})


@dataclass(frozen=True)
class Selection:
    """What is asked of the catalog; released_after is a date or one of the relative labels."""

    taxon: str | None = None
    location: str = ANYWHERE
    released_after: str | None = None
    complete_only: bool = False

    def apply(self, metadata: DataFrame) -> DataFrame:
        """Rows of canonical metadata that the selection takes; the day itself counts as after.

        Compares the keys of ``keyed`` where the metadata has them; else it lowers the columns, which no scan takes over.
        """
        key = lambda c: F.col(c + KEY) if c + KEY in metadata.columns else F.lower(c)
        wanted = {"Taxon": self.taxon, "Country": None if self.location == ANYWHERE else self.location, "Completeness": "complete" if self.complete_only else None}
        for column, value in wanted.items():
            if value:
                metadata = metadata.where(key(column) == value.lower())
        if self.released_after and self.released_after != ANY_DATE:
            label = self.released_after in RELATIVE_DAYS or not self.released_after[:1].isdigit()
            day = relative_date(self.released_after) if label else F.lit(self.released_after).cast("date")
            metadata = metadata.where(F.col("Release_Date") >= day)
        return metadata


def catalog() -> Iterator[Selection]:
    """Every combination of taxon, place, relative date and completeness that the catalog offers."""
    for taxon, place, label, complete in itertools.product(TAXA.values(), LOCATIONS, (ANY_DATE, *RELATIVE_DAYS), (False, True)):
        yield Selection(taxon, place, label, complete)
