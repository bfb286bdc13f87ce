"""Metadata functions as Spark columns, and the few that resolve names and parameters before a plan exists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which metadata columns come, in order of preference.
ALIASES = {
    "Accession": ("Accession", "accession"),
    "Collection_Date": ("Collection_Date", "isolate-collection-date", "Isolate Collection date", "collection-date", "Isolate Collection Date"),
    "Country": ("Country", "geo-location", "Geo_Location", "Geo Location", "Geographic Location"),
    "GenBank_Title": ("GenBank_Title", "virus-name", "Virus Name", "title"),
    "Host_Name": ("host-name", "Host Name", "host"),
    "Length": ("length", "Length"),
    "Completeness": ("completeness", "Completeness"),
    "Release_Date": ("release-date", "Release date", "Release Date"),
    "Source_Database": ("sourcedb", "Source database", "Source Database"),
}
#: Names that are taken besides, where none of those is there.
MORE_ALIASES = {
    "Collection_Date": ("Collection Date",),
    "GenBank_Title": ("GenBank Title",),
    "Host_Name": ("Host_Name",),
    "Completeness": ("Nuc_Completeness",),
    "Release_Date": ("Release_Date",),
    "Source_Database": ("Source_Database", "GenBank_RefSeq"),
}
REQUIRED = ("Accession", "Collection_Date", "Country")
# Days that the labels of relative dates stand for, and the label that adds no filter.
RELATIVE_DAYS = {"Last 30 days": 30, "Last 90 days": 90, "Last 6 months": 180, "Last 1 year": 365, "Last 2 years": 730, "Last 5 years": 1825}
ANY_DATE = "Any Date"
# Fixed value: pattern of a terminal's control sequence.
TERMINAL = r"\x1b\[[0-?]*[ -/]*[@-~]"


def resolve(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """First of names that is among columns, name by name: exactly, else without blanks, byte order mark and case."""
    plain = lambda c: c.strip().lstrip("\ufeff").casefold()
    columns = list(columns)
    by_plain = {plain(c): c for c in columns}
    return next((n if n in columns else by_plain[plain(n)] for n in names if n in columns or plain(n) in by_plain), None)


def loose(name: str) -> str:
    """Header without anything but letters and digits, lower case."""
    return re.sub(r"[^a-z0-9]", "", name.casefold())


def loosely(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """First of names (in loose form) that a column has; of columns alike, the last."""
    found = {loose(c): c for c in columns if c}
    return next((found[n] for n in names if n in found), None)


def normalize_metadata(df: DataFrame, *more: Column) -> DataFrame:
    """Canonical columns, and more; ValueError at plan time lists what is missing. A missing title column falls back to Accession."""
    found = {to: resolve(df.columns, names + MORE_ALIASES.get(to, ())) for to, names in ALIASES.items()}
    missing = [c for c in REQUIRED if not found[c]]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    out = []
    for to, name in found.items():
        if name:
            value = F.col(f"`{name}`").cast("string")
            out.append((country(value) if to == "Country" else value).alias(to))
        elif to == "GenBank_Title":
            out.append(F.col(f"`{found['Accession']}`").cast("string").alias(to))
    return df.select(*out, *more)


def country(value: Column) -> Column:
    """Text before the first colon, trimmed; empty is null."""
    return F.nullif(F.trim(F.substring_index(value, ":", 1)), F.lit(""))


def date(value: Column, lenient: bool = True) -> Column:
    """Date of yyyy-MM-dd; lenient also takes yyyy-MM and yyyy, as their first day; anything else is null."""
    full = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))
    if not lenient:
        return full
    return F.coalesce(full, F.when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01")).try_cast("date")), F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01")).try_cast("date")))


def month(value: Column) -> Column:
    """First day of a date's month."""
    return F.trunc(value, "MM")


def year_of(value: Column) -> Column:
    """First year from 1900 to 2100 that stands on its own in the text."""
    return F.nullif(F.regexp_extract(value, r"\b(19\d{2}|20\d{2}|2100)\b", 1), F.lit("")).try_cast("int")


def number(value: Column) -> Column:
    """Number of a text, null if it is none (never NaN)."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d), d)


def lineage(virus: Column, organism: Column, title: Column) -> Column:
    """B lineage from the title, A subtype of one-digit numbers from the organism, or Unknown."""
    b = F.coalesce(F.nullif(F.regexp_extract(title, "(Victoria|Yamagata)", 1), F.lit("")), F.lit("B/Other"))
    a = F.coalesce(F.nullif(F.regexp_extract(organism, r"\((H\dN\d)\)", 1), F.lit("")), F.lit("A/Other"))
    return F.when(virus == "B", b).when(virus == "A", a).otherwise("Unknown")


def training_text(virus: Column, place: Column, variant: Column, seq: Column) -> Column:
    part = lambda c: F.concat(F.lit("["), F.coalesce(c, F.lit("nan")), F.lit("]"))
    return F.concat(part(virus), part(place), part(variant), F.lit(" "), seq)


def relative_date(label: str, today: Column | None = None) -> Column:
    """Date that a label stands for; null (no filter) for ANY_DATE; ValueError for a label that stands for none."""
    if label == ANY_DATE:
        return F.lit(None).cast("date")
    if label not in RELATIVE_DAYS:
        raise ValueError(f"unknown label {label!r}; there are {[ANY_DATE, *RELATIVE_DAYS]}")
    return F.date_sub(F.current_date() if today is None else today, RELATIVE_DAYS[label])


def plain_console(text: Column) -> Column:
    """Text without terminal sequences, control characters other than tabs, and blanks at its ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TERMINAL, ""), r"[\x00-\x08\x0A-\x1F]", ""), r"^\s+|\s+$", "")


def percent(text: Column) -> Column:
    """First whole percentage in the text, at most 100."""
    return F.least(F.nullif(F.regexp_extract(text, r"(\d{1,3})%", 1), F.lit("")).try_cast("int"), F.lit(100))


def parse_list(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


def years(value: Column) -> Column:
    """Sorted distinct years of a text such as 2020-2022,2025; a range that falls is empty."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")

    def span(x: Column) -> Column:
        ends = F.transform(F.split(x, "-"), lambda y: F.trim(y).cast("int"))
        first, last = F.get(ends, 0), F.get(ends, F.size(ends) - 1)
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def changed(previous: Column, current: Column) -> Column:
    """Whether there is a previous value and it differs."""
    return F.coalesce(previous.isNotNull() & (current != previous), F.lit(False))
