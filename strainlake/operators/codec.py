"""Adaptive order-k coding of base sequences and files into bytes, one document at a time, and its container.

The model is the interpolated one whose code length ``signal.code_length`` gives; its probabilities drive a carry-less range
coder of 32 bits.  With buckets, contexts also hold the sector of the sum of the bases before (``signal.buckets``).  A document
is coded sequentially, documents in parallel.
"""

from __future__ import annotations

import bz2
import json
import lzma
import math
import struct
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.functions import dna

# First bytes of the container; its header has the keys version, mode (plain or polar), k, alpha, block_size,
# n_buckets, n_ids and, for files, n_bytes and source_name.
MAGIC = b"PQC1"
_SCALE, _TOP, _FULL = 1 << 16, 1 << 24, (1 << 32) - 1
#: Suffixes of a container and of what is restored from a file without that one.
PACKED, RESTORED = ".pqc", ".out"


class _Adaptive:
    def __init__(self, order: int, alpha: float, buckets: int = 0, window: int = 64):
        self.order, self.alpha, self.past = order, alpha, [0] * order
        self.counts = [defaultdict(lambda: [0, 0, 0, 0]) for _ in range(order + 1)]
        self.buckets, self.window, self.recent, self.at = buckets, window, deque(), [0, 0]

    def bucket(self) -> int:
        """Sector of the sum of the bases before, each a quarter turn after the last in the order A, C, G, T; 0 for none."""
        if not self.buckets or self.at == [0, 0]:
            return 0
        turn = (math.atan2(self.at[1], self.at[0]) + 2 * math.pi) % (2 * math.pi)
        return int(turn * self.buckets / (2 * math.pi)) % self.buckets

    def _contexts(self) -> list[list[int]]:
        b = self.bucket()
        return [self.counts[o][(b, *self.past[:o])] for o in range(self.order + 1)]

    def cumulative(self) -> list[int]:
        """Integer bounds of the four symbols in [0, _SCALE], each symbol at least 1 wide."""
        p = [0.25] * 4
        for c in self._contexts():
            t = sum(c) + self.alpha
            p = [(c[s] + self.alpha * p[s]) / t for s in range(4)]
        bounds = [0]
        for x in p:
            bounds.append(bounds[-1] + 1 + int(x * (_SCALE - 8)))
        bounds[4] = _SCALE
        return bounds

    def learn(self, symbol: int) -> None:
        for c in self._contexts():
            c[symbol] += 1
        self.past = [symbol, *self.past][: self.order]
        if self.buckets:
            self.recent.append(symbol)
            self.at[symbol & 1] += 1 if symbol < 2 else -1
            if len(self.recent) > self.window:
                old = self.recent.popleft()
                self.at[old & 1] -= 1 if old < 2 else -1


def encode_symbols(symbols: list[int], order: int = 4, alpha: float = 1.0, buckets: int = 0, window: int = 64) -> bytes:
    model, low, width, out = _Adaptive(order, alpha, buckets, window), 0, _FULL, bytearray()
    for s in symbols:
        bounds = model.cumulative()
        unit = width // _SCALE
        low += unit * bounds[s]
        width = unit * (bounds[s + 1] - bounds[s])
        while True:
            if (low ^ (low + width)) >= _TOP:
                if width >= _SCALE:
                    break
                width = -low & (_SCALE - 1)  # the interval straddles a byte: cut it there
            out.append(low >> 24 & 255)
            low, width = low << 8 & _FULL, width << 8 & _FULL
        model.learn(s)
    for _ in range(4):
        out.append(low >> 24 & 255)
        low = low << 8 & _FULL
    return bytes(out)


def decode_symbols(data: bytes, n: int, order: int = 4, alpha: float = 1.0, buckets: int = 0, window: int = 64) -> list[int]:
    model, low, width, out = _Adaptive(order, alpha, buckets, window), 0, _FULL, []
    code, at = int.from_bytes(data[:4], "big"), 4
    for _ in range(n):
        bounds = model.cumulative()
        unit = width // _SCALE
        target = min(_SCALE - 1, (code - low) // unit)
        s = next(k for k in range(4) if target < bounds[k + 1])
        low += unit * bounds[s]
        width = unit * (bounds[s + 1] - bounds[s])
        while True:
            if (low ^ (low + width)) >= _TOP:
                if width >= _SCALE:
                    break
                width = -low & (_SCALE - 1)
            code = (code << 8 | (data[at] if at < len(data) else 0)) & _FULL
            at += 1
            low, width = low << 8 & _FULL, width << 8 & _FULL
        model.learn(s)
        out.append(s)
    return out


def pack(symbols: list[int], order: int = 4, alpha: float = 1.0, buckets: int = 0, window: int = 64, **header) -> bytes:
    """Container: magic, header length, compact JSON header, payload."""
    mode = "polar" if buckets else "plain"
    head = {"version": 1, "mode": mode, "k": order, "alpha": alpha, "block_size": window, "n_buckets": buckets, "n_ids": len(symbols), **header}
    text = json.dumps(head, separators=(",", ":")).encode()
    return MAGIC + struct.pack("<I", len(text)) + text + encode_symbols(symbols, order, alpha, buckets, window)


def unpack(data: bytes) -> tuple[dict, list[int]]:
    """Header and symbols of a container; ValueError for anything else."""
    if len(data) < 8 or data[:4] != MAGIC:
        raise ValueError("no such container")
    size = struct.unpack("<I", data[4:8])[0]
    head = json.loads(data[8 : 8 + size])
    if head["mode"] not in ("plain", "polar"):
        raise ValueError(f"unknown mode {head['mode']}")
    return head, decode_symbols(data[8 + size :], head["n_ids"], head["k"], head["alpha"], head["n_buckets"], head["block_size"])


def pack_files(files: DataFrame, order: int = 4, alpha: float = 1.0, buckets: int = 8, window: int = 64) -> DataFrame:
    """path (with the container's suffix), raw_bytes, packed_bytes, packed of files (path, content); four symbols a byte, no buckets for the plain mode."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, raw in zip(p["path"], p["content"]):
                symbols = [byte >> shift & 3 for byte in raw for shift in (6, 4, 2, 0)]
                packed = pack(symbols, order, alpha, buckets, window, n_bytes=len(raw), source_name=path.rpartition("/")[2])
                yield pd.DataFrame({"path": [path + PACKED], "raw_bytes": [len(raw)], "packed_bytes": [len(packed)], "packed": [packed]})

    return files.select("path", "content").mapInPandas(run, "path string, raw_bytes long, packed_bytes long, packed binary")


def unpack_files(files: DataFrame, content: str = "packed") -> DataFrame:
    """path (without the container's suffix, else with another), content of containers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, packed in zip(p["path"], p["content"]):
                head, s = unpack(bytes(packed))
                raw = bytes(s[i] << 6 | s[i + 1] << 4 | s[i + 2] << 2 | s[i + 3] for i in range(0, len(s) - 3, 4))
                if len(raw) != head["n_bytes"]:
                    raise ValueError(f"{path}: {len(raw)} bytes instead of {head['n_bytes']}")
                yield pd.DataFrame({"path": [path.removesuffix(PACKED) if path.endswith(PACKED) else path + RESTORED], "content": [raw]})

    return files.select("path", F.col(content).alias("content")).mapInPandas(run, "path string, content binary")


def write_files(rows: DataFrame, content: str) -> list[str]:
    """Writes the binary column to the paths in ``path``, one file after the other, and returns the paths."""
    spark, done = rows.sparkSession, []
    for r in rows.select("path", F.col(content).alias("content")).toLocalIterator():
        target = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(r.content)
        finally:
            out.close()
        done.append(r.path)
    return done


def sizes(docs: DataFrame, key: str, seq: str, order: int = 4, higher: int = 6, buckets: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """key, n, method, bytes, bits_per_base, times_smaller (than two bits a base; null for no bases) of each document's cleaned sequence."""
    cleaned = docs.select(F.col(key).alias("key"), dna.clean(F.coalesce(F.col(seq), F.lit(""))).alias("seq"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for one, text in zip(p["key"], p["seq"]):
                ids, raw = ["ACGT".index(c) for c in text], text.encode()
                found = {"two_bit": (len(ids) + 3) // 4, "bz2": len(bz2.compress(raw)), "lzma": len(lzma.compress(raw))}
                found |= {f"plain_{k}": len(encode_symbols(ids, k)) for k in (order, higher)}
                found |= {f"polar_{order}_{b}": len(encode_symbols(ids, order, buckets=b)) for b in buckets}
                yield pd.DataFrame({"key": one, "n": len(ids), "method": list(found), "bytes": list(found.values())})

    out = cleaned.mapInPandas(run, f"key {docs.schema[key].dataType.simpleString()}, n long, method string, bytes long").withColumnRenamed("key", key)
    return out.withColumns({"bits_per_base": F.try_divide(F.col("bytes") * 8.0, F.col("n")), "times_smaller": F.when(F.col("n") > 0, F.try_divide(F.floor((F.col("n") + 3) / 4).cast("double"), F.col("bytes")))})


def compress(docs: DataFrame, key: str, seq: str, order: int = 4) -> DataFrame:
    """key, n (bases), packed (binary) of each document's cleaned sequence."""
    cleaned = docs.select(F.col(key).alias("key"), dna.clean(F.coalesce(F.col(seq), F.lit(""))).alias("seq"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"key": p["key"], "n": p["seq"].str.len(), "packed": [pack(["ACGT".index(c) for c in s], order) for s in p["seq"]]})

    return cleaned.mapInPandas(run, f"key {docs.schema[key].dataType.simpleString()}, n long, packed binary").withColumnRenamed("key", key)


def decompress(packed: DataFrame, key: str) -> DataFrame:
    """key, seq of each container."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"key": p["key"], "seq": ["".join("ACGT"[s] for s in unpack(bytes(x))[1]) for x in p["packed"]]})

    kind = packed.schema[key].dataType.simpleString()
    return packed.select(F.col(key).alias("key"), "packed").mapInPandas(run, f"key {kind}, seq string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, key: str, seq: str, order: int = 4) -> DataFrame:
    """key, n, packed_bytes, two_bit_bytes, same (whether the bases come back)."""
    packed = compress(docs, key, seq, order)
    back = decompress(packed, key)
    own = docs.select(key, dna.clean(F.coalesce(F.col(seq), F.lit(""))).alias("own"))
    return packed.join(back, key).join(own, key).select(key, "n", F.octet_length("packed").alias("packed_bytes"), F.floor((F.col("n") + 3) / 4).alias("two_bit_bytes"), (F.col("seq") == F.col("own")).alias("same"))
