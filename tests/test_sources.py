"""Files: headers, sequences, duplicates documents, windows, CSV order; and what is built from them."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from strainlake.functions import dna, text
from strainlake.operators import dedup, growth, labels, model, scope, signal
from strainlake.plans import forecast_run
from strainlake.sources import fasta, remote, sinks, windows

HEADERS = {
    "Accession": ["Accession", "accession", " ACCESSION ", "﻿Accession"],
    "Collection_Date": ["Collection_Date", "isolate-collection-date", "Isolate Collection date", "collection-date", "Isolate Collection Date", "Collection Date"],
    "Country": ["Country", "geo-location", "Geo_Location", "Geo Location", "Geographic Location"],
    "GenBank_Title": ["GenBank_Title", "virus-name", "Virus Name", "title"],
    "Host_Name": ["host-name", "Host Name", "host", "Host"],
    "Length": ["length", "Length"],
    "Completeness": ["completeness", "Completeness"],
    "Release_Date": ["release-date", "Release date", "Release Date", "Release_Date"],
    "Source_Database": ["sourcedb", "Source database", "Source Database"],
}


def test_every_header(spark):
    first = {to: names[0] for to, names in HEADERS.items()}
    for to, names in HEADERS.items():
        for name in names:
            columns = {**first, to: name}
            df = spark.createDataFrame([tuple(f"{c}: x" for c in columns)], ", ".join(f"`{n}` string" for n in columns.values()))
            row = text.normalize_metadata(df).first()
            assert set(row.asDict()) == set(HEADERS) and row[to] == ("Country" if to == "Country" else f"{to}: x")
    assert text.resolve(["ACCESSION", "accession"], ["Accession", "accession"]) == "accession"  # name by name, the last of columns alike
    assert text.resolve(["Host", "host-name "], ["host-name", "host"]) == "host-name "


def test_relative_dates(spark):
    today = F.lit("2024-07-01").cast("date")
    day = lambda label: str(spark.range(1).select(text.relative_date(label, today)).first()[0])
    assert [day(x) for x in ("Any Date", "Last 30 days", "Last 6 months", "Last 5 years")] == ["None", "2024-06-01", "2024-01-03", "2019-07-03"]
    with pytest.raises(ValueError, match="Last 180 days"):
        text.relative_date("Last 180 days")


def test_catalog(spark):
    every = list(remote.catalog())
    assert len(every) == len(set(every)) == 16 * 22 * 7 * 2
    rows = remote.keyed(spark.createDataFrame([("11320", "France", "2024-01-01", "Complete"), ("11320", "Peru", "2023-01-01", "partial")], "Taxon string, Country string, Release_Date string, Completeness string").withColumn("Release_Date", F.col("Release_Date").cast("date")))
    assert remote.Selection("11320").apply(rows).count() == 2 and remote.Selection("11320", "FRANCE", "2024-01-01", True).apply(rows).count() == 1
    assert remote.Selection(released_after="Last 30 days").apply(rows).count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("11320", "France")], "Taxon string, Country string")
    remote.keyed(rows).write.parquet(str(tmp_path / "m"))
    for selection, wanted in ((remote.Selection("11320"), "EqualTo(Taxon_Key,11320)"), (remote.Selection(location="France"), "EqualTo(Country_Key,france)")):
        plan = selection.apply(spark.read.parquet(str(tmp_path / "m")))._jdf.queryExecution().executedPlan().toString()
        assert wanted in plan


def test_fasta_forms(spark, tmp_path):
    (tmp_path / "a.fna").write_text("before\n>a x\r\nAC\r\nGT\r\n>>q z\n  TT\n   >in\nGG\n>empty\n>last\n")
    (tmp_path / "b.fna").write_text(">\nCC\n>n>n\nA>C\n")
    read = lambda **k: [(r.id, r.seq) for r in fasta.read(spark, str(tmp_path), **k).orderBy("ord").collect()]
    whole = [("a", "ACGT"), (">q", "TT"), ("in", "GG"), ("unknown_id", "CC"), ("n>n", "A>C")]
    assert read() == whole
    assert read(preamble=True) == [("unknown_id", "before"), *whole]
    assert read(all_marks=True)[1] == ("q", "TT") and read(max_seqs=1) == [whole[0], whole[3]]
    assert read(empty=True) == [*whole[:3], ("empty", ""), *whole[3:]]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("data/genomic.fna", (tmp_path / "a.fna").read_text())
    got = fasta.read_package_fasta(spark, str(tmp_path), all_marks=True).orderBy("ord").collect()
    assert [(r.id, r.seq) for r in got] == [("a", "ACGT"), ("q", "TT"), ("in", "GG")]
    with pytest.raises(Exception, match="genomic.fna"):
        fasta.read_package_fasta(spark, str(tmp_path), "other.fna").collect()


def test_fasta_in_splits(spark, tmp_path):
    records = [(f"r{k}", "ACGT" * (k % 50) + "A") for k in range(3000)]
    (tmp_path / "a.fna").write_text("".join(f">{i} d\n{s[:70]}\n{s[70:]}\n" for i, s in records))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        df = fasta.read(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = df.orderBy("ord").collect()
    finally:
        spark.conf.set(name, before)
    assert [(r.id, r.seq) for r in got] == records and len({r.ord for r in got}) == len(records)


def test_csv_order(spark, tmp_path):
    for name, first in (("b", 100), ("a", 0)):
        (tmp_path / f"{name}.csv").write_text("Accession,title\n" + "".join(f"A{first + k},t{k}\n" for k in range(50)))
    got = fasta.read_csv_ordered(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.Accession for r in got] == [f"A{k}" for k in [*range(50), *range(100, 150)]]


def test_duplicates_document(spark, tmp_path):
    records = spark.createDataFrame([(0, "b", "ACGT"), (1, "d", "ACGT"), (2, "e", "acgt"), (3, "a", "TTTT"), (4, "b", "TTTT"), (5, "c", "GGGGG"), (6, "z", "N")], "ord long, id string, seq string")
    groups = dedup.group_sequences(records).join(records.select(F.sha2(dna.clean(F.col("seq")), 256).alias("seq_hash"), dna.clean(F.col("seq")).alias("sequence")).distinct(), "seq_hash")
    metadata = spark.createDataFrame([("b", "old", 1), ("b", "new", 2), ("q", "x", 3)], "Accession string, host string, ord long")
    enriched = dedup.enrich(groups, metadata)
    enriched = enriched.withColumn("metadata_by_accession", F.coalesce(F.transform_values("metadata_by_accession", lambda _, v: F.create_map(F.lit("host"), v["host"])), F.create_map().cast("map<string,map<string,string>>")))
    want = [("ACGT", 3, ["b", "d", "e"]), ("TTTT", 2, ["a", "b"]), ("GGGGG", 1, ["c"])]
    totals = fasta.write_document(enriched, str(tmp_path / "d.json"), "x.fna", metadata_key="Accession")
    fasta.write_groups(enriched, str(tmp_path / "lines"), source_file="x.fna")
    made = json.loads((tmp_path / "d.json").read_text())
    assert (totals["total_sequences"], totals["unique_sequences"], totals["duplicate_sequences"]) == (6, 3, 3)
    assert made["source_file"] == "x.fna" and made["max_seqs"] is None and made["metadata_key"] == "Accession" and len(made["sequences"]) == 3
    for path in ("d.json", "lines"):
        back = fasta.read_groups(spark, str(tmp_path / path))
        got = back.orderBy("group_ord").collect()
        assert [(r.sequence, r["count"], r.identifiers) for r in got] == want and [r.group_ord for r in got] == [0, 1, 2]
        assert got[1].metadata_by_accession == {"b": {"host": "new"}}
        # an identifier in several groups belongs to the last one of the document
        assert dict(labels.masters(back).collect()) == {"b": "a", "d": "b", "e": "b", "a": "a", "c": "c"}
    assert dict(labels.masters(groups).collect())["b"] == "a"
    empty = fasta.write_document(enriched.limit(0), str(tmp_path / "e.json"), "y")
    assert empty["total_sequences"] == 0 and fasta.read_groups(spark, str(tmp_path / "e.json")).count() == 0


def test_newest(spark, tmp_path):
    assert fasta.newest(spark, str(tmp_path / "none")) is None and fasta.newest(spark, str(tmp_path)) is None
    import os

    for k, name in enumerate(("checkpoint-9", "checkpoint-10", "other")):
        (tmp_path / name).mkdir()
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    assert fasta.newest(spark, str(tmp_path)).endswith("checkpoint-10")


def test_windows(spark, tmp_path):
    reads = spark.createDataFrame([(0, "ACGTACGTA", "IIIIIIIII"), (1, "AC", "II"), (2, "NACGTNTTTTx", "I5IIIIIII"), (3, "acgtacgtacgt", "I" * 12)], "ord long, seq string, quality string")
    windows.write_windows(reads, str(tmp_path / "w"))
    back = spark.read.parquet(str(tmp_path / "w"))
    assert sorted((r.read, r.w) for r in back.collect()) == [(0, 0), (0, 1)]
    data = b"".join(bytes(r.packed) for r in windows.packed(reads).orderBy("read").collect())
    assert struct.unpack_from("<I", data)[0] == 2 and len(data) == 4 + 2 * 2 * 8 * 2
    (tmp_path / "x.polardb").write_bytes(data + data[:20])  # cut off in the second read
    got = windows.read_packed(spark, str(tmp_path)).orderBy("read", "w").collect()
    assert [(r.read, r.w) for r in got] == [(0, 0), (0, 1)] and got[0].phi == pytest.approx([0, 1.5708, 3.1416, -1.5708] * 2, abs=2e-3) and got[0].r == pytest.approx([41 / 94] * 8, abs=1e-3)
    best = windows.matches(windows.read_packed(spark, str(tmp_path)), "ACGTACGT", 0.2).first()
    assert (best.read, best.w) == (0, 0) and best.score == pytest.approx(41 / 94, abs=1e-3)
    hits = signal.search_reads(reads, "ACGTACGT", 0.2).collect()
    assert [(r.doc, r.w) for r in hits] == [(0, 0)] and hits[0].score == pytest.approx(41 / 94)
    rows = signal.symbols(spark.createDataFrame([(0, "ACGTACGTAGGATTACAGG")], "k long, s string"), "k", "s").withColumn("r", F.lit(0.5))
    signs = signal.signatures(spark.createDataFrame([(0, "ACGTACGTAGGATTACAGG")], "k long, s string"), "k", "s", lambda i: F.lit(0.5))
    assert sorted(map(tuple, signal.motif_hits(rows, "GATTACAG", 0.1).collect())) == sorted(map(tuple, signal.matches(signs, "GATTACAG", 0.1).collect()))


def test_scope_of_metadata_and_groups(spark):
    meta = spark.createDataFrame([("2024-01", "France: x", None), ("1999", "brazil", "")], "`Isolate Collection date` string, `GEO location` string, `release date` string")
    groups = spark.createDataFrame([({"a": {"year": "2001", "collection_date": "", "country": "Chad: x"}, "b": {"isolate-collection-date": "2002-02"}},)], "metadata_by_accession map<string,map<string,string>>")
    one = lambda *x: tuple(scope.infer_all(*x).first())
    assert one(meta, groups) == ([1999, 2024], ["brazil", "France"])
    assert one(meta.drop("GEO location"), groups) == ([1999, 2001, 2002, 2024], ["Chad"])
    assert one(meta.limit(0), groups) == ([2001, 2002], ["Chad"]) and one(meta) == ([1999, 2024], ["brazil", "France"])


def test_full_report(spark):
    rows = [(2024, m, "X", a, p, f"title of {a}") for m, a, p in ((1, "A", 0.1), (2, "A", 0.4), (1, "B", 0.9), (2, "B", 0.2))]
    df = spark.createDataFrame(rows, "Year int, Month int, Country string, Accession string, Probability double, t string")
    lines = [r.line for r in growth.full_report(df, "x", 1, "t", 1).orderBy("part", "line_no").collect()]
    assert lines[:2] == ["Rows analyzed: 4", "Country filter: x"] and lines[6] == "X                     A                    0.1000   0.4000   +0.3000  0.4000@2024-02  title of A"
    assert "X                     B                    0.9000   0.2000   -0.7000  0.9000@2024-01  title of B" in lines
    assert lines[-3:] == ["X                     2024-01  B                       0.9000  title of B", "... 1 more rows not shown", "Analyzed 4 forecast rows across 1 countries and 2 strains."]
    with pytest.raises(ValueError, match="no rows"):
        growth.full_report(df, "nowhere")
    with pytest.raises(ValueError, match="two rows"):
        growth.full_report(df.where("Month = 1"))


def test_training_set(spark, tmp_path):
    rows = [("Influenza B", "o", "B/Victoria/1", "X", "2024-01-05", "ACGT"), ("Influenza B", "o", "B/Victoria/2", "X", "2024-02", "AC"), ("Influenza A", "a (H3N2)", "t", "X", "2024-02-01", "GG"), (None, "o", "t", "X", "2024-02-09", "TT"), ("Influenza A", None, "t", None, "2024-01-01", "A"), ("Influenza A", None, "t", "X", "none", "A")]
    df = spark.createDataFrame(rows, "Virus_Type string, Organism_Name string, GenBank_Title string, Country string, Collection_Date string, sequence string")
    sinks.write_training_set(labels.training_set(df), str(tmp_path / "t"))
    got = {r.text: round(r.labels, 6) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {"[Influenza B][X][Victoria] ACGT": round(1 / 3 - 1, 6), "[Influenza B][X][Victoria] AC": 0, "[Influenza A][X][H3N2] GG": 0, "[nan][X][Unknown] TT": 0}


def test_codes_and_transforms(spark):
    texts = ["A" * 14 + "C", "AA-AA", "N", "", "acgtn" * 3 + "TTTTTTTTTTTTTTTTTTTTTTTTTTT", "mMzZ!é😀G" + "G" * 12 + "g", "AA", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", dna.run_length(F.col("t")).alias("c"), dna.run_length_decoded(dna.run_length(F.col("t"))).alias("b")).orderBy("k").collect()
    assert [r.c for r in got][:4] == ["maA", "bb", "!", ""] and got[-2].c == "aa" and got[-1].c is None
    assert [r.b for r in got[:-1]] == ["".join(c for c in t.upper() if c in "ACGTN") for t in texts[:-1]]
    x = [3.0, -1.0, 2.5, 0.0, 7.0, 1.0, 1.0, -4.0]
    y = spark.createDataFrame([(x,)], "x array<double>").select(dna.walsh_hadamard(F.col("x"), 8).alias("y")).first().y
    assert y == pytest.approx([sum(v * (-1) ** bin(i & j).count("1") for j, v in enumerate(x)) for i in range(8)])
    one = df.where("k = 0").select(dna.one_hot(F.col("t"), 20).alias("x")).first().x
    assert one == [[1, 0, 0, 0]] * 14 + [[0, 1, 0, 0]] + [[0, 0, 0, 0]] * 5


def test_model_of_sequences(spark, tmp_path):
    seqs = {"M0": "ACGT" * 30, "M1": "GGGCCC" * 20, "M2": "TTTAAA" * 20}
    rows = [(f"A{k}", f"{y}-{m:02d}-01", "France", f"t{k}") for k, (y, m, _) in enumerate((y, m, j) for y in (2023, 2024, 2025) for m in range(1, 7) for j in range(6))]
    meta = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord long, Accession string, Collection_Date string, Country string, title string")
    groups = spark.createDataFrame([(k, s, [r[0] for i, r in enumerate(rows) if i % 3 == k]) for k, s in enumerate(seqs.values())], "group_ord int, sequence string, identifiers array<string>")
    out = forecast_run.run(meta, groups, str(tmp_path / "f.csv"), ["France"], [2025], backtest_year=2030, dominant_year=2025)
    assert (out["target_year"], out["train_rows"], out["test_rows"], out["rows"]) == (2025, 72, 36, 36)
    learn = forecast_run.master_dataset(meta, groups).withColumn("Month", F.col("Month").cast("string"))
    fitted = model.fit_sequences(learn, groups.select(F.get("identifiers", 0).alias("Master"), "sequence"))
    assert set(fitted.validation) == {"log_loss", "auc"} and fitted.validation["log_loss"] > 0
    only = labels.with_sequences(learn, spark.createDataFrame([("A0", "ACGT"), ("A1", "NNN")], "Master string, sequence string"))
    assert {r.Master for r in only.select("Master").distinct().collect()} == {"A0"}
    assert spark.createDataFrame([("ACGTA",)], "s string").select(model.kmers(F.col("s"), 3)).first()[0] == ["ACG", "CGT", "GTA"]


def test_commands(spark, tmp_path, capsys):
    from strainlake.__main__ import main

    (tmp_path / "a.fna").write_text(">A1 x\nACGT\n>A2\nACGT\n>A3\nGG\n")
    (tmp_path / "m.csv").write_text("accession,host\nA1,old\nA1,new\nQ,x\n")
    run = lambda *args: main([str(tmp_path / x) if x in files else x for x in args])
    files = {"a.fna", "m.csv", "d.json", "rle", "a.fna.pqc", "f.csv"}
    run("duplicates", "a.fna", "--out", "d.json", "--metadata-csv", "m.csv")
    made = json.loads((tmp_path / "d.json").read_text())
    assert made["sequences"][0]["identifiers"] == ["A1", "A2"] and made["sequences"][0]["metadata_by_accession"] == {"A1": {"host": "new"}}
    assert made["metadata_summary"] == {"metadata_rows": 2, "duplicate_sequence_entries": 2, "enriched_sequence_entries": 1, "matched_accessions": 1, "missing_accessions": 2}
    run("uniqueness", "a.fna")
    assert "duplicates: 1" in capsys.readouterr().out
    run("run-length", "a.fna", "rle")
    assert [r.value for r in spark.read.text(str(tmp_path / "rle")).collect()][:2] == [">A1 x", dna_code(spark, "ACGT")]
    raw = (tmp_path / "a.fna").read_bytes()
    run("pack", "a.fna")
    (tmp_path / "a.fna").unlink()
    run("unpack", "a.fna.pqc")
    assert (tmp_path / "a.fna").read_bytes() == raw
    (tmp_path / "f.csv").write_text("Year,Month,Country,Accession,Probability\n2024,1,X,A,0.1\n2024,2,X,A,0.3\n")
    run("growth", "f.csv", "--country", "X")
    assert "FASTEST RISING STRAINS" in capsys.readouterr().out


def dna_code(spark, s):
    return spark.range(1).select(dna.run_length(F.lit(s))).first()[0]
