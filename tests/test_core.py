"""Fixtures of the operators: values worked out by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strainlake.functions import dna, text
from strainlake.operators import codec, dedup, forecast, growth, labels, model, signal
from strainlake.plans import forecast_run
from strainlake.sources import fasta, generators, sinks
from strainlake.sources.remote import Selection


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("value,want", [("Acgtnx-", "ACGT"), ("", ""), ("NNN", "")])
def test_clean(spark, value, want):
    assert one(spark, dna.clean(F.col("s")), s=value) == want


@pytest.mark.parametrize("value,want", [("A" * 14 + "C", "maA"), ("AA-AA", "bb"), ("N", "!"), ("", "")])
def test_run_length(spark, value, want):
    assert one(spark, dna.run_length(F.col("s")), s=value) == want
    kept = "".join(c for c in value if c in "ACGTN")
    assert one(spark, dna.run_length_decoded(dna.run_length(F.col("s"))), s=value) == kept


def test_strands(spark):
    assert one(spark, dna.reverse_complement(F.col("s")), s="AACG") == "CGTT"
    least, flag = dna.canonical(F.col("s"))
    assert one(spark, least, s="TTTT") == "AAAA" and one(spark, flag, s="TTTT")


def test_bytes(spark):
    assert one(spark, dna.byte_ids(F.array(F.lit(0x1B)))) == [0, 1, 2, 3]
    assert one(spark, dna.ids_to_bytes(F.array(*map(F.lit, [0, 1, 2, 3])))) == [0x1B]
    assert one(spark, dna.ids_to_bytes(F.array(*map(F.lit, [0, 1, 2])))) is None


@pytest.mark.parametrize("value,want", [("released 2024-05-01", 2024), ("1899", None), ("x2024", None), (None, None)])
def test_year(spark, value, want):
    assert one(spark, text.year_of(F.col("s").cast("string")), s=value) == want


def test_metadata_scalars(spark):
    assert one(spark, text.country(F.col("s")), s="USA: California") == "USA"
    assert one(spark, text.years(F.col("s")), s="2020-2022,2021,2025") == [2020, 2021, 2022, 2025]
    assert one(spark, text.years(F.col("s")), s="2022-2020") == []
    for organism, want in (("(H3N2)", "H3N2"), ("(H10N8)", "A/Other"), (None, "A/Other")):
        assert one(spark, text.lineage(F.lit("A"), F.col("o").cast("string"), F.lit("t")), o=organism) == want
    assert one(spark, text.date(F.col("s")), s="2024-03") == datetime.date(2024, 3, 1)
    assert one(spark, text.date(F.col("s"), lenient=False), s="2024-03") is None
    assert one(spark, text.percent(F.col("s")), s="at 250% now") == 100
    assert one(spark, text.number(F.col("s")), s="nan") is None
    assert text.relative_date("Any Date") is not None and text.resolve(["﻿Accession "], ["accession"]) == "﻿Accession "


def test_normalize_metadata(spark):
    df = spark.createDataFrame([("A1", "2024-01-02", "France: Paris")], "accession string, `isolate-collection-date` string, `geo-location` string")
    row = text.normalize_metadata(df).first()
    assert (row.Accession, row.Country, row.GenBank_Title) == ("A1", "France", "A1")
    with pytest.raises(ValueError, match="Country"):
        text.normalize_metadata(df.drop("geo-location"))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fna").write_text("before\n>a\nACTGNN\n>b foo\nac\r\n\ngt\n>e\n>\nTT\n")
    rows = fasta.read(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.id, r.seq) for r in rows] == [("a", "ACTGNN"), ("b", "acgt"), ("unknown_id", "TT")]


def test_fastq(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("x.fastq", "@r1\nACGTACGTA\n+\nIIIIIIIII\n@r2\nAC\n+\nII\n")
    rows = fasta.read_fastq_zip(spark, str(tmp_path / "r.zip")).orderBy("ord").collect()
    assert [(r.read_id, r.seq, r.quality) for r in rows] == [("r1", "ACGTACGTA", "I" * 9), ("r2", "AC", "II")]
    w = fasta.read_fastq_zip(spark, str(tmp_path / "r.zip")).select(F.size(signal.read_windows(F.col("seq"), F.col("quality"))).alias("n")).collect()
    assert sorted(r.n or -1 for r in w) == [-1, 2]


def test_duplicates(spark):
    records = spark.createDataFrame([(0, "a", "ACGT"), (1, "b", "acgt"), (2, "c", "TTTT"), (3, "d", "NN")], "ord long, id string, seq string")
    row = dedup.summary(records).first()
    assert (row.total, row.unique_n, row.duplicates) == (3, 2, 1)
    assert dedup.summary(records.limit(0)).first().duplicate_percent == 0.0
    groups = dedup.ranked(dedup.group_sequences(records)).collect()
    assert [g.identifiers for g in groups] == [["a", "b"], ["c"]]
    meta = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("zz", 3, "x")], "Accession string, ord int, host string")
    s = dedup.enrichment_summary(dedup.group_sequences(records), meta).first()
    assert (s.entries, s.enriched, s.matched, s.missing) == (2, 1, 1, 2)
    got = dedup.enrich(dedup.group_sequences(records), meta).where("metadata_by_accession is not null").first()
    assert got.metadata_by_accession["a"].host == "new"


def surveillance(spark, rows):
    return spark.createDataFrame([(c, datetime.date.fromisoformat(m + "-01"), s) for c, m, s, n in rows for _ in range(n)], "Country string, YearMonth date, Master string")


def test_outbreak(spark):
    rows = surveillance(spark, [("X", "2024-01", "A", 3), ("X", "2024-01", "B", 1), ("X", "2024-03", "A", 1), ("X", "2024-03", "B", 19), ("Y", "2024-01", "A", 1)])
    got = {(r.Country, str(r.YearMonth)[:7], r.Master): (r.Freq, r.Next_Month_Freq, r.Outbreak) for r in labels.outbreak(rows).collect()}
    assert got == {("X", "2024-01", "A"): (0.75, 0.05, 1), ("X", "2024-03", "A"): (0.05, None, 0), ("X", "2024-01", "B"): (0.25, 0.95, 1), ("X", "2024-03", "B"): (0.95, None, 0), ("Y", "2024-01", "A"): (1.0, None, 0)}
    assert labels.outbreak(rows, calendar_adjacent=True, drop_unlabeled=True).count() == 0


def test_dpgr(spark):
    rows = surveillance(spark, [("X", "2024-01", "V1", 1), ("X", "2024-02", "V1", 1), ("X", "2024-02", "V2", 1), ("Y", "2024-01", "V2", 1)]).withColumnRenamed("Master", "Variant")
    got = {(r.Country, str(r.YearMonth)[:7], r.Variant): r.labels for r in labels.dpgr(rows).collect()}
    assert got == {("X", "2024-01", "V1"): -0.5, ("X", "2024-01", "V2"): 0.5, ("X", "2024-02", "V1"): 0, ("X", "2024-02", "V2"): 0, ("Y", "2024-01", "V1"): 0, ("Y", "2024-01", "V2"): 0}


def test_dominant_shift(spark):
    rows = [(2024, 1, "X", "A", 0.9), (2024, 1, "X", "B", 0.9), (2024, 2, "X", "B", 0.8), (2024, 2, "X", "A", 0.7), (2025, 1, "X", "B", 0.5)]
    df = spark.createDataFrame(rows, "Year int, Month int, Country string, Accession string, Probability double")
    got = {(r.Year, r.Month, r.Accession): (r.Dominant_Accession, r.Previous_Dominant_Accession, r.New_DNA_From_Previous_Dominant) for r in forecast.annotate_dominant(df).collect()}
    assert got[2024, 1, "A"] == ("A", None, False) and got[2024, 2, "B"] == ("B", "A", True) and got[2024, 2, "A"] == ("B", "A", False) and got[2025, 1, "B"] == ("B", "B", False)


def test_growth(spark):
    rows = [("2024.0", "1", "X", "A", "0.1"), ("2024", "3", "X", "A", "0.4"), ("2024", "2", "X", "A", "0.4"), ("2024", "1", "X", "B", "0.9"), ("2024", "1", "X", "A", "abc")]
    df = spark.createDataFrame(rows, "Year string, Month string, Country string, Accession string, Probability string")
    got = growth.trends(growth.prepared(df, " x ")).collect()
    assert len(got) == 1 and (got[0].Start_Prob, got[0].End_Prob, round(got[0].Delta, 9), got[0].Peak_Label) == (0.1, 0.4, 0.3, "2024-02")
    with pytest.raises(ValueError):
        growth.prepared(df.drop("Month"))


def test_codec():
    rng = random.Random(5)
    for n in (0, 1, 5, 3000):
        symbols = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        head, back = codec.unpack(codec.pack(symbols, 3))
        assert back == symbols and head["n_ids"] == n
        assert codec.unpack(codec.pack(symbols, 2, buckets=8, window=16))[1] == symbols and codec.unpack(codec.pack(symbols, 0))[1] == symbols
    with pytest.raises(ValueError):
        codec.unpack(b"nope")


def test_code_length_is_what_the_coder_takes(spark):
    seq = "ACGT" * 300 + "AAAA" * 50
    df = spark.createDataFrame([(1, seq)], "k long, s string")
    bits = signal.code_length(signal.symbols(df, "k", "s")).first().bits
    packed = len(codec.encode_symbols(["ACGT".index(c) for c in seq], 4))
    assert bits / 8 <= packed <= bits / 8 * 1.02 + 8


def test_polar_code_length_is_what_the_coder_takes(spark):
    seq = "ACGT" * 200 + "AAAA" * 50 + "GGTC" * 90
    rows = signal.buckets(signal.symbols(spark.createDataFrame([(1, seq)], "k long, s string"), "k", "s"))
    bits = signal.code_length(rows, 3, by=("bucket",)).first().bits
    packed = len(codec.encode_symbols(["ACGT".index(c) for c in seq], 3, buckets=8))
    assert bits / 8 <= packed <= bits / 8 * 1.02 + 8


def test_packed_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 2)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    files = files.unionByName(spark.createDataFrame([("x/b", b"")], "path string, content binary"))  # Spark's reader skips empty files
    for buckets in (0, 8):
        packed = codec.pack_files(files, buckets=buckets)
        back = {r.path.rpartition("/")[2]: bytes(r.content) for r in codec.unpack_files(packed).collect()}
        assert back == {"a.bin": bytes(range(256)) * 2, "b": b""}
    with pytest.raises(Exception, match="no such container"):
        codec.unpack_files(files, "content").collect()
    got = {r.method: r for r in codec.sizes(spark.createDataFrame([(1, "ACGT" * 100)], "k long, s string"), "k", "s").collect()}
    assert got["two_bit"].bytes == 100 and got["two_bit"].times_smaller == 1 and got["plain_4"].bytes < 40 and set(got) == {"two_bit", "bz2", "lzma", "plain_4", "plain_6", "polar_4_4", "polar_4_8", "polar_4_16"}


def test_motif_and_selection(spark):
    with pytest.raises(ValueError):
        signal.motif_hits(None, "ACG")
    rows = spark.createDataFrame([("flu", "France", datetime.date(2024, 1, 1), "complete"), ("flu", "Peru", datetime.date(2023, 1, 1), "partial")], "Taxon string, Country string, Release_Date date, Completeness string")
    assert Selection().apply(rows).count() == 2
    assert Selection("FLU", "france", "2024-01-01", True).apply(rows).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from strainlake.streaming.monthly import daily_counts, monthly_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = daily_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("daily").groupBy(F.trunc("day", "MM").alias("month"), "Master").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, monthly_counts(events, "ts", "event_type").collect()))


def test_fastq_limits(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("x.fastq", "@r1\nAC\n+\nII\n@r2 lane\nACGTACGTNN\n+\nIIIIIIIIII\n@r3\nACGTACGA\n+\nIIIIIIII\n@cut\nAC\n")
        z.writestr("a.fastq", "@s1\nACGTACGTA\n+\nIIIIIIIII\n")
    ids = lambda **k: [r.read_id for r in fasta.read_fastq_zip(spark, str(tmp_path / "r.zip"), **k).orderBy("ord").collect()]
    assert ids() == ["s1", "r1", "r2", "r3"]
    assert ids(max_reads=1, first_member=True) == ["r2"] and ids(max_reads=5, first_member=True) == ["r2", "r3"] and ids(max_reads=0) == []


def test_report(spark, tmp_path):
    import json
    import zipfile

    line = {"accession": "A1", "virus": {"organismName": "flu", "taxId": 11320}, "location": {"geographicLocation": "France: Paris"}, "isolate": {"collectionDate": "2024-01"}, "length": 1700}
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("data/data_report.jsonl", json.dumps(line) + "\n\n")
    row = fasta.read_report(spark, str(tmp_path / "p.zip")).collect()
    assert len(row) == 1 and len(row[0]) == 10 and (row[0]["virus-tax-id"], row[0]["length"], row[0]["host-name"]) == (11320, 1700, None)
    assert text.normalize_metadata(fasta.read_report(spark, str(tmp_path / "p.zip"))).first().Country == "France"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", ">b x", "GGT"), (0, "a", ">a", "A" * 14), (2, "c", ">c", "")], "ord long, id string, header string, seq string")
    sinks.write_run_length(rows, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == [">a", "ma", ">b x", "oN", ">c", ""]
    sinks.write_fasta(rows.where("seq <> ''"), str(tmp_path / "f"), 5)
    back = fasta.read(spark, str(tmp_path / "f"), pattern="part-*").orderBy("ord").collect()
    assert [(r.id, r.seq) for r in back] == [("a", "A" * 14), ("b", "GGT")]
    assert max(len(r.value) for r in spark.read.text(str(tmp_path / "f")).collect()) == 5


def test_generators(spark):
    one = generators.drawn(spark, 4, 5000, generators.SKEWED, 7).orderBy("id").collect()
    assert one == generators.drawn(spark, 4, 5000, generators.SKEWED, 7).repartition(3).orderBy("id").collect()
    assert len({r.seq for r in one}) == 4 and all(abs(r.seq.count(b) / 5000 - w) < 0.03 for r in one for b, w in zip("ACGT", generators.SKEWED))
    assert generators.drawn(spark, 1, 0).first().seq == ""
    df = spark.createDataFrame([("GATTACA",), ("",), (None,)], "f string")
    assert [r[0] for r in df.select(generators.tiled(F.col("f"), 10)).collect()] == ["GATTACAGAT", None, None]


def test_split_by_key(spark):
    learn, test = labels.split_by_key(spark.range(5000), "id")
    assert learn.count() + test.count() == 5000 and 50 < test.count() < 150


def test_forecast_run(spark, tmp_path):
    rows = [(f"A{i}", f"{y}-{m:02d}-0{1 + i % 9}", c + ": x", f"t{i % 3}") for i, (y, m, c, _) in enumerate((y, m, c, k) for y in (2023, 2024, 2025) for m in (1, 2, 3) for c in ("France", "USA", "Peru") for k in range(4))]
    meta = spark.createDataFrame([*rows, ("A0", None, "France", "undated"), ("zz", "2025-01-01", "USA", "in no group")], "Accession string, `Collection Date` string, Country string, title string")
    groups = spark.createDataFrame([(k, [r[0] for i, r in enumerate(rows) if i % 3 == k]) for k in range(3)], "group_ord int, identifiers array<string>")
    said = []
    out = forecast_run.run(meta, groups, str(tmp_path / "f.csv"), top_n=2, progress=lambda m, p: said.append(p))
    assert (out["train_rows"], out["test_rows"], out["rows"], out["target_year"]) == (72, 36, 2 * 6 * 12 * 2, 2025) and said[-1] == 100
    shown = spark.read.option("header", True).csv(str(tmp_path / "f.csv"))
    assert shown.count() == out["rows"] and {r.Country for r in shown.collect()} == {"France", "USA"}
    compared = spark.read.option("header", True).csv(out["dominant_backtest_csv"])
    assert out["dominant_backtest_csv"] == str(tmp_path / "f_dominant_backtest_2025.csv") and compared.count() == 9 and "Actual_Title" in compared.columns
    score = lambda d: d.withColumn("Probability", F.when(F.col("Accession") == "A1", 0.9).otherwise(0.1))
    out = forecast_run.run(meta, groups, str(tmp_path / "g.csv"), ["Peru"], [2026], backtest_year=2026, scorer=score)
    assert (out["test_rows"], out["rows"], out["dominant_backtest_csv"], out["new_forecast_dna_count"]) == (0, 36, None, 0)
    with pytest.raises(ValueError):
        forecast_run.run(meta, groups, str(tmp_path / "h.csv"), backtest_year=2023)
    assert model.point(score, spark, "A1", "Peru", 3) == 0.9
