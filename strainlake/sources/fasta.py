"""Sequence files as DataFrames. File order is kept in ``ord``.

Text files are read in splits of whole records.  Members of zip files are read as streams; a zip file itself is one row, of 2 GB
at most (Spark's limit for binary files).
"""

from __future__ import annotations

import io
import itertools
import json
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.functions.dna import BASES
from strainlake.operators.signal import BLOCK

#: Bits of ord that number rows within a file (or split); files are numbered above them, in order of their paths.
RECORD_BITS = 40
#: Rows that a parser hands on at once.
AT_ONCE = 1000


def parse(lines: Iterable[str], preamble: bool = False, empty: bool = False) -> Iterator[tuple[str | None, str]]:
    """(header line, sequence) of each record with sequence lines; text before the first header counts only with preamble,
    records without sequence lines only with empty, and not as the last."""
    header, body = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if (body and (header is not None or preamble)) or (empty and header is not None):
                yield header, "".join(body)
            header, body = line, []
        elif line:
            body.append(line)
    if body and (header is not None or preamble):
        yield header, "".join(body)


def identifier(header: Column, all_marks: bool = False) -> Column:
    """First word after the mark (or after all leading ones) of a header line, or unknown_id."""
    found = F.regexp_extract(F.coalesce(header, F.lit("")), r"^\s*>*+\s*(\S+)" if all_marks else r"^\s*>\s*(\S+)", 1)
    return F.when(found == "", "unknown_id").otherwise(F.replace(found, F.lit("\ufffd"), F.lit("")))


def _ranks(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, file (its rank) of the files, from their listing."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return listed.select(F.col("_metadata.file_path").alias("path")).withColumn("file", F.row_number().over(W.orderBy("path")) - 1)


def _numbered(rows: DataFrame, spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """ord from the rank of the file's path and the record's number in it."""
    place = F.shiftleft(F.col("file").cast("long"), RECORD_BITS) + F.col("record")
    return rows.join(F.broadcast(_ranks(spark, path, pattern)), "path").withColumn("ord", place).drop("file", "record")


def read(spark: SparkSession, path: str, max_seqs: int | None = None, preamble: bool = False, pattern: str = "*", empty: bool = False, all_marks: bool = False) -> DataFrame:
    """ord, id, header, seq of the records of FASTA files; max_seqs counts records of a file, also those that clean to nothing.

    Files are cut before the marks that begin lines, so that a split has whole records, and read once.  A record's number is the
    place of its split and its number there.  preamble and empty: as in ``parse``; all_marks: as in ``identifier``.
    """
    names = ["path", "record", "header", "seq"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n>").text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, nth = None, 0
        for b in batches:
            for value, path, start in zip(*[b.column(i).to_pylist() for i in range(3)]):
                first = at != (path, start)
                if first:
                    at, nth = (path, start), start
                lines = (value if first and not start else ">" + value).replace("\ufffd", "").split("\n")
                if empty:
                    lines.append(">")  # ends the record, which may be empty; the last of the file is left out later
                for header, seq in parse(lines, preamble, empty):
                    yield path, nth, header, seq
                    nth += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while part := list(itertools.islice(rows, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)

    rows = text.mapInArrow(run, "path string, record long, header string, seq string")
    if empty:
        last = rows.groupBy("path").agg(F.max("record").alias("last"))
        rows = rows.join(F.broadcast(last), "path").where((F.col("seq") != "") | (F.col("record") < F.col("last"))).drop("last")
    if max_seqs is not None:
        rows = rows.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("record"))).where(F.col("n") <= max_seqs).drop("n")
    return _numbered(rows, spark, path, pattern).select("ord", identifier(F.col("header"), all_marks).alias("id"), "header", "seq")


def _zips(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), "content")


def _streamed(rows: Iterator[tuple], columns: list[str]):
    import pandas as pd

    while part := list(itertools.islice(rows, AT_ONCE)):
        yield pd.DataFrame(part, columns=columns)


def read_fastq_zip(spark: SparkSession, path: str, max_reads: int | None = None, first_member: bool = False) -> DataFrame:
    """ord, read_id, seq, quality of the reads of .fastq members of zip files; four lines a read.

    max_reads counts the reads of a file that hold a window of bases, and leaves out the others; first_member reads only the first.
    """

    def reads(z: zipfile.ZipFile) -> Iterator[tuple[str, str, str]]:
        members = [n for n in z.namelist() if n.endswith(".fastq")]
        for member in members[:1] if first_member else sorted(members):
            lines = (x.rstrip("\r\n") for x in io.TextIOWrapper(z.open(member), "utf-8", errors="ignore"))
            for head, seq, _, quality in zip(lines, lines, lines, lines):
                if max_reads is None or sum(map(seq.count, BASES)) >= BLOCK:
                    yield head.removeprefix("@").split(" ")[0], seq, quality

    def run(parts):
        for p in parts:
            for where, content in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = ((where, n, *r) for n, r in enumerate(itertools.islice(reads(z), max_reads)))
                    yield from _streamed(found, ["path", "record", "read_id", "seq", "quality"])

    rows = _zips(spark, path).mapInPandas(run, "path string, record long, read_id string, seq string, quality string")
    return _numbered(rows, spark, path).select("ord", "read_id", "seq", "quality")


def _member(z: zipfile.ZipFile, member: str) -> list[str]:
    names = [n for n in z.namelist() if n.rpartition("/")[2] == member]
    if not names:
        raise ValueError(f"no {member} among {z.namelist()}")
    return names


def read_package(spark: SparkSession, path: str, member: str = "genomic.fna") -> DataFrame:
    """path, name, text of the members of zip packages with that file name; ValueError names the members if there is none."""

    def run(parts):
        import pandas as pd

        for p in parts:
            for where, content in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in _member(z, member):
                        yield pd.DataFrame([(where, n, z.read(n).decode("utf-8", "ignore"))], columns=["path", "name", "text"])

    return _zips(spark, path).mapInPandas(run, "path string, name string, text string")


def read_package_fasta(spark: SparkSession, path: str, member: str = "genomic.fna", all_marks: bool = False) -> DataFrame:
    """ord, id, header, seq of the records of that member of zip packages, which is read as a stream."""

    def run(parts):
        for p in parts:
            for where, content in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    records = (r for n in _member(z, member) for r in parse(io.TextIOWrapper(z.open(n), "utf-8", errors="ignore")))
                    yield from _streamed(((where, k, *r) for k, r in enumerate(records)), ["path", "record", "header", "seq"])

    rows = _zips(spark, path).mapInPandas(run, "path string, record long, header string, seq string")
    return _numbered(rows, spark, path).select("ord", identifier(F.col("header"), all_marks).alias("id"), "header", "seq")


#: Column of a package's report, and where its JSON holds it.
REPORT = {
    "accession": "accession string", "virus-name": "virus.organismName string", "virus-tax-id": "virus.taxId bigint",
    "isolate-collection-date": "isolate.collectionDate string", "geo-location": "location.geographicLocation string",
    "host-name": "host.organismName string", "length": "length bigint", "completeness": "completeness string",
    "release-date": "releaseDate string", "sourcedb": "sourceDatabase string",
}


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The ten columns of REPORT of each JSON line of the packages' data_report.jsonl; absent values are null."""
    lines = read_package(spark, path, "data_report.jsonl").select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return lines.select(*[F.get_json_object("line", f"$.{where.split()[0]}").cast(where.split()[1]).alias(to) for to, where in REPORT.items()])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, all columns text; numbers and dates are cast where they are used."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_csv_ordered(spark: SparkSession, path: str, ord: str = "ord") -> DataFrame:
    """read_csv with ord, which grows in the order of the files' paths and of the rows in them.

    Splits are ranked by path and start (a row for each); within one, rows are counted as they come.
    """
    rows = read_csv(spark, path)
    names = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.select(*names, F.col("_metadata.file_path").alias("path__"), F.col("_metadata.file_block_start").alias("start__"))
    rows = rows.withColumn("nth__", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranks = rows.select("path__", "start__").distinct().withColumn("split__", F.row_number().over(W.orderBy("path__", "start__")) - 1)
    place = F.shiftleft(F.col("split__").cast("long"), RECORD_BITS) + F.col("nth__")
    return rows.join(F.broadcast(ranks), ["path__", "start__"]).select(place.alias(ord), *names)


GROUP = "sequence string, count bigint, identifiers array<string>, metadata_by_accession map<string,map<string,string>>"
GROUPS = f"sequences array<struct<{', '.join(x.replace(' ', ':', 1) for x in GROUP.split(', '))}>>"


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """group_ord, sequence, count, identifiers, metadata_by_accession of a duplicates document, or of a folder of its groups as
    JSON lines; groups without identifiers are left out."""
    if _is_folder(spark, path):
        rows = spark.read.schema(f"group_ord bigint, {GROUP}").json(path)
    else:
        rows = spark.read.schema(GROUPS).json(path, multiLine=True).select(F.posexplode("sequences").alias("group_ord", "g")).select(F.col("group_ord").cast("long").alias("group_ord"), "g.*")
    return rows.where(F.size("identifiers") > 0)


def _ordered(groups: DataFrame) -> DataFrame:
    """group_ord, sequence, count, identifiers and what else GROUP has of groups, in the document's order, from 0."""
    values = [c for c in ("sequence", "count", "identifiers", "metadata_by_accession") if c in groups.columns]
    ranked = groups.orderBy(F.desc("count"), F.desc(F.length("sequence")), "first_ord").select(*values)
    # numbered along the sorted partitions: one row for each of them is summed up
    ranked = ranked.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = ranked.groupBy("part").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "first")
    return ranked.join(F.broadcast(firsts), "part").select((F.col("first") + F.col("nth")).alias("group_ord"), *values)


def write_groups(groups: DataFrame, path: str, **about) -> None:
    """A folder of JSON lines, one for each group with its group_ord, and what is said about them beside it.

    groups: sequence, count, identifiers, first_ord and, of enriched ones, metadata_by_accession.
    """
    rows = _ordered(groups)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
    if about:
        groups.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-summary")


def write_document(groups: DataFrame, path: str, source_file: str, max_seqs: int | None = None, **about) -> dict:
    """One duplicates document of all groups: totals, then the sequences in order, then what else is said; returns the totals.

    One task writes it, a line at a time; ``write_groups`` is for what one file can't hold.
    """
    spark = groups.sparkSession
    found = groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    head = {"source_file": source_file, "max_seqs": max_seqs, "total_sequences": found.total, "unique_sequences": found.n, "duplicate_sequences": found.total - found.n}
    rows = _ordered(groups)
    line = F.to_json(F.struct(*rows.columns[1:]), {"ignoreNullFields": "false"})
    body = rows.select(F.col("group_ord").alias("k"), F.when(F.col("group_ord") < found.n - 1, F.concat(line, F.lit(","))).otherwise(line).alias("value"))
    first = json.dumps(head)[:-1] + ', "sequences": ['
    ends = spark.createDataFrame([(-1, first), (1 << 62, "]" + "".join(f", {json.dumps(k)}: {json.dumps(v)}" for k, v in about.items()) + "}")], "k long, value string")
    part = f"{path}.parts"
    ends.unionByName(body).repartition(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, parts = hadoop.Path(path), hadoop.Path(part)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    made = next(f.getPath() for f in files.listStatus(parts) if f.getPath().getName().startswith("part-"))
    files.delete(target, True)
    files.rename(made, target)
    files.delete(parts, True)
    return head


def newest(spark: SparkSession, path: str, prefix: str = "checkpoint") -> str | None:
    """The folder of that prefix in path that was changed last; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    found = [(f.getModificationTime(), f.getPath().toString()) for f in files.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith(prefix)]
    return max(found)[1] if found else None
