"""Windows of reads: as Parquet, and in the binary layout of phase and magnitude halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlake.operators.signal import BLOCK, read_windows

# Type of the count before a read's windows, and of the phases and magnitudes after it.
COUNT, HALF = np.dtype("<u4"), np.dtype("<f2")
LAYOUT = "read long, w int, phi array<float>, r array<float>"


def windows(reads: DataFrame) -> DataFrame:
    """read (ord), w, phi, r of each window of 8 bases of the reads (ord, seq, quality); shorter reads have none."""
    rows = reads.select(F.col("ord").alias("read"), F.posexplode(read_windows(F.col("seq"), F.col("quality"))).alias("w", "x"))
    part = lambda f: F.transform("x", lambda p: p[f].cast("float"))
    return rows.select("read", "w", part("phi").alias("phi"), part("r").alias("r"))


def write_windows(reads: DataFrame, path: str) -> None:
    """The windows as Parquet."""
    windows(reads).write.mode("overwrite").parquet(path)


def packed(reads: DataFrame) -> DataFrame:
    """read, packed (binary) of each read that has windows: their count, all phases, all magnitudes."""
    rows = reads.select(F.col("ord").alias("read"), read_windows(F.col("seq"), F.col("quality")).alias("x")).where("x is not null")
    flat = lambda f: F.flatten(F.transform("x", lambda w: F.transform(w, lambda p: p[f].cast("float"))))
    rows = rows.select("read", flat("phi").alias("phi"), flat("r").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for phi, r in zip(b.column(1), b.column(2)):
                halves = [np.asarray(x.values, np.float32).astype(HALF).tobytes() for x in (phi, r)]
                out.append(np.array([len(phi.values) // BLOCK], COUNT).tobytes() + b"".join(halves))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["read", "packed"])

    return rows.mapInArrow(run, "read long, packed binary")


def unpacked(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the read, phases and magnitudes (a row for each window); what is cut off at the end is left out."""
    at, read = 0, 0
    while at + COUNT.itemsize <= len(data):
        n = int(np.frombuffer(data, COUNT, 1, at)[0]) * BLOCK
        at += COUNT.itemsize
        if at + 2 * n * HALF.itemsize > len(data):
            return
        phi, r = (np.frombuffer(data, HALF, n, at + k * n * HALF.itemsize).astype(np.float32).reshape(-1, BLOCK) for k in range(2))
        yield read, phi, r
        at, read = at + 2 * n * HALF.itemsize, read + 1


def read_packed(spark: SparkSession, path: str, pattern: str = "*.polardb") -> DataFrame:
    """path, read, w, phi, r of the windows in files of that layout."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for read, phi, r in unpacked(data):
                    n = len(phi)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array([read] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(list(phi), pa.list_(pa.float32())), pa.array(list(r), pa.list_(pa.float32()))],
                        names=["path", "read", "w", "phi", "r"],
                    )

    return files.mapInArrow(run, f"path string, {LAYOUT}")


def matches(found: DataFrame, motif: str, threshold: float = 0.6) -> DataFrame:
    """Columns of windows that are more like the motif's first 8 bases than threshold, with score, the best first."""
    from strainlake.functions.dna import BASES

    motif = "".join(c for c in motif.upper() if c in BASES)[:BLOCK]
    if len(motif) < BLOCK:
        raise ValueError(f"a motif has at least {BLOCK} bases")
    total = F.lit(0.0)
    for k, c in enumerate(motif):
        total = total + F.cos(F.get("phi", k) - F.lit(float((0.0, np.pi / 2, np.pi, -np.pi / 2)[BASES.index(c)]))) * F.get("r", k)
    scored = found.withColumn("score", total / BLOCK).where(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), *[c for c in ("path", "read", "w") if c in found.columns])
