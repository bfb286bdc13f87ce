"""Commands over files: duplicates, uniqueness, run-length text, containers, forecast and growth report."""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from strainlake.functions import dna, text
from strainlake.operators import codec, dedup, growth
from strainlake.plans import forecast_run
from strainlake.session import session
from strainlake.sources import fasta, sinks


def _duplicates(spark, a) -> None:
    records = fasta.read(spark, a.fasta, a.max_seqs).select("ord", "id", dna.clean(F.col("seq")).alias("seq")).cache()
    groups = dedup.group_sequences(records)
    first = records.select(F.col("ord").alias("first_ord"), F.col("seq").alias("sequence"))
    groups = groups.join(first, "first_ord")
    about = {}
    if a.metadata_csv:
        metadata = fasta.read_csv_ordered(spark, a.metadata_csv)
        key = text.resolve(metadata.columns, text.ALIASES["Accession"])
        metadata = metadata.withColumnRenamed(key, "Accession")
        values = [c for c in metadata.columns if c not in ("Accession", "ord")]
        enriched = dedup.enrich(groups, metadata)
        as_map = lambda _, v: F.create_map(*[x for c in values for x in (F.lit(c), v[c])])
        groups = enriched.withColumn("metadata_by_accession", F.coalesce(F.transform_values("metadata_by_accession", as_map), F.create_map().cast("map<string,map<string,string>>")))
        s = dedup.enrichment_summary(dedup.group_sequences(records), metadata).first()
        known = metadata.where("Accession is not null").select("Accession").distinct().count()
        summary = {"metadata_rows": known, "duplicate_sequence_entries": s.entries, "enriched_sequence_entries": s.enriched, "matched_accessions": s.matched, "missing_accessions": s.missing}
        about = {"metadata_source_file": PurePosixPath(a.metadata_csv).name, "metadata_key": "Accession", "metadata_summary": summary}
    for name, value in fasta.write_document(groups, a.out, PurePosixPath(a.fasta).name, a.max_seqs, **about).items():
        print(f"{name}: {value}")


def _uniqueness(spark, a) -> None:
    records = fasta.read(spark, a.fasta, preamble=True)
    for name, value in dedup.summary(records).first().asDict().items():
        print(f"{name}: {value}")
    for r in dedup.uniqueness(records, a.top).collect():
        print(r["count"], r.seq_length, r.seq_hash)


def _run_length(spark, a) -> None:
    sinks.write_run_length(fasta.read(spark, a.fasta, empty=True), a.out)


def _pack(spark, a) -> None:
    files = spark.read.format("binaryFile").load(a.file).select("path", "content")
    print(*codec.write_files(codec.pack_files(files, a.order, buckets=a.buckets), "packed"), sep="\n")


def _unpack(spark, a) -> None:
    files = spark.read.format("binaryFile").load(a.file).select("path", F.col("content").alias("packed"))
    print(*codec.write_files(codec.unpack_files(files), "content"), sep="\n")


def _forecast(spark, a) -> None:
    years = lambda value: [int(y) for y in spark.range(1).select(text.years(F.lit(value))).first()[0]] if value else None
    out = forecast_run.run(
        fasta.read_csv_ordered(spark, a.metadata_csv), fasta.read_groups(spark, a.duplicates), a.out, text.parse_list(a.countries or "") or None, years(a.years),
        years(a.training_years), a.backtest_year, top_n=a.top, progress=lambda message, percent: print(f"{percent:5.1f}% {message}"),
    )
    for name, value in out.items():
        print(f"{name}: {value}")


def _growth(spark, a) -> None:
    rows = spark.read.option("header", True).csv(a.csv)
    title = "GenBank_Title" if "GenBank_Title" in rows.columns else None
    for r in growth.full_report(rows, a.country, a.top, title).orderBy("part", "line_no").collect():
        print(r.line)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strainlake")
    commands = out.add_subparsers(required=True)

    def command(name: str, run, *arguments: str, **options) -> None:
        p = commands.add_parser(name)
        for x in arguments:
            p.add_argument(x)
        for x, default in options.items():
            p.add_argument("--" + x.replace("_", "-"), default=default, type=int if x in ("max_seqs", "top", "order", "buckets", "backtest_year") else str)
        p.set_defaults(run=run)

    command("duplicates", _duplicates, "fasta", out="sequences_duplicates.json", metadata_csv=None, max_seqs=None)
    command("uniqueness", _uniqueness, "fasta", top=10)
    command("run-length", _run_length, "fasta", "out")
    command("pack", _pack, "file", order=4, buckets=8)
    command("unpack", _unpack, "file")
    command("forecast", _forecast, "metadata_csv", "duplicates", "out", countries=None, years=None, training_years=None, backtest_year=2025, top=3)
    command("growth", _growth, "csv", country=None, top=10)
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(session(), a)


if __name__ == "__main__":
    main()
