"""Motif search in reads and adaptive code lengths, as windows over (document, position, symbol) rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.functions import dna

BLOCK = 8


def symbols(docs: DataFrame, doc: str, seq: str) -> DataFrame:
    """doc, i (from 0), sym (0 to 3) of each base of the cleaned sequence."""
    cleaned = docs.select(F.col(doc).alias("doc"), dna.ids(dna.clean(F.col(seq))).alias("ids"))
    return cleaned.select("doc", F.posexplode("ids").alias("i", "sym"))


def motif_hits(rows: DataFrame, motif: str, threshold: float = 0.6) -> DataFrame:
    """doc, w, score of each window of 8 bases that is more like the motif's first 8 than threshold; rows: doc, i, sym, r.

    For bases that come as rows: each meets the motif's eight positions, and windows are sums.  Sequences in arrays have ``matches``.
    """
    motif = "".join(c for c in motif.upper() if c in dna.BASES)[:BLOCK]
    if len(motif) < BLOCK:
        raise ValueError(f"a motif has at least {BLOCK} bases")
    table = F.array(*[F.struct(F.lit(k).alias("off"), F.lit(dna.BASES.index(c)).alias("msym")) for k, c in enumerate(motif)])
    met = rows.withColumn("m", F.explode(table)).select("doc", (F.col("i") - F.col("m.off")).alias("w"), (F.col("r") * dna.phase_cos(F.col("sym"), F.col("m.msym"))).alias("x")).where("w >= 0")
    scored = met.groupBy("doc", "w").agg(F.count("*").alias("n"), (F.sum("x") / BLOCK).alias("score"))
    return scored.where((F.col("n") == BLOCK) & (F.col("score") > threshold)).select("doc", "w", "score")


def signatures(docs: DataFrame, doc: str, seq: str, strength=lambda i: F.lit(1.0)) -> DataFrame:
    """doc, sym (array of 0 to 3), r (array of magnitudes, by position) of each cleaned sequence."""
    cleaned = docs.select(F.col(doc).alias("doc"), dna.ids(dna.clean(F.col(seq))).alias("sym"))
    return cleaned.withColumn("r", F.transform("sym", lambda _, i: strength(i).cast("double")))


def read_signatures(reads: DataFrame) -> DataFrame:
    """doc (ord), sym, r of each read (ord, seq, quality): its A, C, G and T with the magnitude of their quality."""
    kept = reads.select(F.col("ord").alias("doc"), _points(F.col("seq"), F.col("quality")).alias("points"))
    return kept.select("doc", F.transform("points", lambda p: F.instr(F.lit(dna.BASES), p["b"]) - 1).alias("sym"), F.transform("points", lambda p: dna.phred(p["q"])).alias("r"))


def matches(signs: DataFrame, motif: str, threshold: float = 0.6) -> DataFrame:
    """doc, w, score of each window of 8 bases that is more like the motif's first 8 than threshold; signs: doc, sym, r.

    Scored inside a sequence's arrays: nothing is sent.
    """
    motif = "".join(c for c in motif.upper() if c in dna.BASES)[:BLOCK]
    if len(motif) < BLOCK:
        raise ValueError(f"a motif has at least {BLOCK} bases")
    cosines = [F.array(*[F.lit((1.0, 0.0, -1.0, 0.0)[abs(dna.BASES.index(c) - k)]) for k in range(4)]) for c in motif]

    def score(w: Column) -> Column:
        total = F.lit(0.0)
        for k, cos in enumerate(cosines):
            total = total + F.get("r", w + k) * F.get(cos, F.get("sym", w + k))
        return F.struct(w.alias("w"), (total / BLOCK).alias("score"))

    windows = F.when(F.size("sym") >= BLOCK, F.sequence(F.lit(0), F.greatest(F.size("sym") - BLOCK, F.lit(0))))
    hits = F.filter(F.transform(windows, score), lambda x: x["score"] > threshold)
    return signs.select("doc", F.explode(hits).alias("x")).select("doc", "x.w", "x.score")


def search_reads(reads: DataFrame, motif: str, threshold: float = 0.6) -> DataFrame:
    """matches of the reads, the best first, ties by read and window."""
    return matches(read_signatures(reads), motif, threshold).orderBy(F.desc("score"), "doc", "w")


def _points(seq: Column, quality: Column) -> Column:
    """The read's bases A, C, G, T (in upper case) with their quality characters, as far as both go."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    pairs = F.zip_with(letters(seq), letters(quality), lambda b, q: F.struct(b.alias("b"), q.alias("q")))
    return F.filter(pairs, lambda p: F.coalesce(p["b"].isin(*dna.BASES) & p["q"].isNotNull(), F.lit(False)))


def read_windows(seq: Column, quality: Column) -> Column:
    """Arrays of 8 (phase, magnitude) of each window over the read's A, C, G and T; null if there are fewer than 8."""
    phase = lambda b: F.when(b == "A", 0.0).when(b == "C", math.pi / 2).when(b == "G", math.pi).otherwise(-math.pi / 2)
    points = F.transform(_points(seq, quality), lambda p: F.struct(phase(p["b"]).alias("phi"), dna.phred(p["q"]).alias("r")))
    return F.when(F.size(points) >= BLOCK, F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - BLOCK + 1, F.lit(1))), lambda i: F.slice(points, i, BLOCK)))


def buckets(rows: DataFrame, count: int = 8, window: int = 64, current: bool = False) -> DataFrame:
    """rows with bucket: the angle of the sum of the 64 bases before, in one of count sectors; 0 where there is none.

    With current, the last of the 64 is the base itself; a decoder cannot follow that.
    """
    past = W.partitionBy("doc").orderBy("i").rowsBetween(*((-(window - 1), 0) if current else (-window, -1)))
    re = F.sum(F.when(F.col("sym") == 0, 1).when(F.col("sym") == 2, -1).otherwise(0)).over(past)
    im = F.sum(F.when(F.col("sym") == 1, 1).when(F.col("sym") == 3, -1).otherwise(0)).over(past)
    angle = F.atan2(F.col("im").cast("double"), F.col("re").cast("double"))
    sector = F.floor(F.pmod(angle + 2 * math.pi, F.lit(2 * math.pi)) * count / (2 * math.pi)).cast("int") % count
    none = F.col("re").isNull() | ((F.col("re") == 0) & (F.col("im") == 0))
    return rows.withColumns({"re": re, "im": im}).withColumn("bucket", F.when(none, 0).otherwise(sector)).drop("re", "im")


def code_length(rows: DataFrame, order: int = 4, alpha: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """doc, n, bits: length of each document under the adaptive model of the given order, counts of strictly earlier positions.

    Each order's counts are row numbers within (document, context, symbol) and (document, context); ``by`` adds to the contexts.
    """
    if order < 1 or alpha <= 0:
        raise ValueError("order is at least 1 and alpha above 0")
    along = W.partitionBy("doc").orderBy("i")
    d = rows.withColumns({f"c{k}": F.coalesce(F.lag("sym", k).over(along), F.lit(0)) for k in range(1, order + 1)})
    p = F.lit(0.25)
    for o in range(order + 1):
        context = ["doc", *by, *[f"c{k}" for k in range(1, o + 1)]]
        d = d.withColumns({f"n{o}": F.row_number().over(W.partitionBy(*context, "sym").orderBy("i")) - 1, f"t{o}": F.row_number().over(W.partitionBy(*context).orderBy("i")) - 1})
        p = (F.col(f"n{o}") + alpha * p) / (F.col(f"t{o}") + alpha)
    return d.groupBy("doc").agg(F.count("*").alias("n"), F.sum(-F.log2(p)).alias("bits"))
