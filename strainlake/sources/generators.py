"""Made sequences: the same ones for a seed on any number of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlake.functions.dna import BASES

SKEWED = (0.35, 0.15, 0.15, 0.35)
_UNIT = 1 << 30


def drawn(spark: SparkSession, count: int, length: int, weights: Sequence[float] = (0.25,) * 4, seed: int = 0) -> DataFrame:
    """id, seq: count sequences of length bases, drawn by a hash of seed, id and position with these weights of A, C, G, T."""

    def base(i: Column) -> Column:
        at, out = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(_UNIT)), F.lit(BASES[-1])
        for b, w in reversed(list(zip(BASES, weights))[:-1]):
            upto = sum(weights[: BASES.index(b) + 1])
            out = F.when(at < int(_UNIT * upto / sum(weights)), F.lit(b)).otherwise(out)
        return out

    places = F.sequence(F.lit(1), F.lit(length)) if length else F.array().cast("array<int>")
    return spark.range(count).select("id", F.array_join(F.transform(places, base), "").alias("seq"))


def tiled(fragment: Column, length: int) -> Column:
    """A fragment repeated and cut to length; null for an empty one."""
    times = F.ceil(F.lit(length) / F.nullif(F.length(fragment), F.lit(0))).cast("int")
    return F.substr(F.repeat(fragment, times), F.lit(1), F.lit(length))
