"""Column helpers that stay linear in one row's array or text: running folds, and pieces of a string at many places.

A fold that grows an array or a string by each element copies it as often, and a substring is counted out from the start of
its text; both take quadratic time in a row with many elements.  Here arrays are folded in blocks of BLOCK elements, level by
level, and texts are cut into large pieces first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block, and levels of blocks above the elements: 64 ** 3 elements before the last level's fold grows.
BLOCK, LEVELS = 64, 3


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def blocks(values: Column, size: int) -> Column:
    """The array (a column or lambda variable) in slices of size elements; an empty array is one empty slice."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(values, j * size + 1, F.lit(size)))


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column, kind: str = "bigint") -> Column:
    """For each element the fold by op of all before it; op is associative and zero neutral to it."""

    def scan(block: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, empty, step, lambda acc: acc["out"])

    def level(part: Column, depth: int) -> Column:
        if not depth:
            return scan(part, zero)
        total = lambda block: F.aggregate(block, zero, lambda acc, x: op(acc, x))
        return bound(part, lambda v: bound(blocks(v, BLOCK), lambda bs: F.flatten(F.zip_with(bs, level(F.transform(bs, total), depth - 1), scan))))

    return level(values, LEVELS)


def sums_before(values: Column) -> Column:
    """For each of an array of longs the sum of all before it."""
    return running(values, lambda a, x: a + x, F.lit(0).cast("bigint"))


def cut(text: Column, spans: Column) -> Column:
    """The pieces text[start:end] of an array of (start, end), in order and without overlap, in code points from 0."""
    piece = lambda p, a, b: F.substr(p["text"], (a - p["at"] + 1).cast("int"), (b - a).cast("int"))
    parts = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), text.alias("text"), spans.alias("spans")))
    for size in (BLOCK * BLOCK, BLOCK):
        smaller = lambda p: F.transform(
            blocks(p["spans"], size),
            lambda s: bound(F.get(s, 0)["start"], lambda a: F.struct(a.alias("at"), piece(p, a, F.get(s, F.size(s) - 1)["end"]).alias("text"), s.alias("spans"))),
        )
        parts = F.flatten(F.transform(parts, smaller))
    pieces = F.flatten(F.transform(parts, lambda p: F.transform(p["spans"], lambda s: piece(p, s["start"], s["end"]))))
    return F.when(F.size(spans) > 0, pieces).otherwise(F.array().cast("array<string>"))
