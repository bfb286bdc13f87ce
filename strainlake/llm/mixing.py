"""Mixing sources to target weights by capped water-filling.

Each source is due its weight's share of all words, but at most ``epochs`` times its own size; what a clamped source
leaves goes to the others by weight, until no target is above its cap.  A source's documents are then repeated
floor(target / size) times in whole, and a seeded order of its documents decides which get one repetition more: whole
ones until the words still due are used up, and at the edge one document the rest as a fraction, its first words.  So the words
taken from a source are its target, rounded.

Sizes are aggregated to (source, slice of the seeded order) before anything else happens, so a source that holds most rows
is no larger for any task than another.  Only one row for each source is joined back, and broadcast only if that is small.

Defined cases: null text has size 0; a null source is a source, the last one; copies of one row are numbered where the words
run out among them, so that the totals hold, and which copy is taken is arbitrary; all sizes 0 or no rows give targets of 0;
documents of size 0 are taken as often as whole repetitions say, and once more ahead of the edge.  Input columns named as an
output column make way in ``mix``; ``mixture`` returns its input's columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.llm._common import Scratch, lasting, settled

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 17
#: Hexadecimal digits of the seeded order that make a slice, 4096 a source; the one at the edge is sorted on its own.
SLICE_DIGITS = 3
#: Columns that ``mix`` adds.
ADDED = ("size", "source_size", "target", "repeats", "part")
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources with rank (from 0) by code point, null last: a range sort, and offsets of its partitions."""
    dealt = scratch.save(sources.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), sources.count())
    sizes = dealt.groupBy("part").count()  # a row for each partition
    offsets = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    own = W.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    return dealt.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.row_number().over(own) - 1).drop("part", "before")


def targets(sources: DataFrame, weights: Sequence[float], epochs: float, scratch: Scratch) -> DataFrame:
    """source, source_size, target of each source (source, source_size).

    The level (words for each unit of weight) rises while sources are clamped; each round is one sum over the sources.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    rows = scratch.save(ranked(sources, scratch).select("source", "source_size", turn.alias("weight"), (F.col("source_size") * float(epochs)).alias("cap")), sources.count())
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        s = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if s.n == clamped or not s.weight:
            break
        clamped, level = s.n, (total - s.cap) / s.weight
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, repeats (whole repetitions), part (words of a fractional one)."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    done = _mixed(rows.withColumns({"size": words(F.col("text")), "order": _order(seed)}), weights, epochs)
    return done.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ADDED], *ADDED)


def _order(seed: int) -> Column:
    """The seeded order of documents, as text that any engine sorts alike; its first three digits are the slice."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))


def _mixed(rows: DataFrame, weights: Sequence[float], epochs: float, frozen: bool = False) -> DataFrame:
    """rows (doc_id, source, size, order and others) with source_size, target, repeats, part; frozen: they are a saved table."""
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        lean = rows.select("source", "doc_id", "size", "order", F.substring("order", 1, SLICE_DIGITS).alias("slice"))
        lean = lean if frozen else scratch.save(lean)
        sliced = scratch.save(lean.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), lean.count())
        sources = scratch.save(sliced.groupBy("source").agg(F.sum("slice_size").alias("source_size")), sliced.count())
        n = sources.count()
        goal = scratch.save(targets(sources, weights, epochs, scratch), n)
        due = F.round("target").cast("long")
        goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(0)).withColumn("rest", due - F.col("whole") * F.col("source_size"))
        # the slice of each source in which the words still due run out
        before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        edge = sliced.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).alias("a").join(goal.alias("g"), F.expr("a.source <=> g.source"))
        edge = edge.where("before <= rest and rest < before + slice_size").select("a.source", "slice", (F.col("rest") - F.col("before")).alias("due"))
        # and in it, the document, with all its copies, in which they do
        equal = lean.alias("s").join(edge.alias("e"), F.expr("s.source <=> e.source and s.slice = e.slice")).groupBy("s.source", "s.order", "s.doc_id", "s.size", "e.due").agg(F.count("*").alias("n"))
        upto = W.partitionBy("source").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
        at_edge = equal.withColumn("due", F.col("due") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(upto), F.lit(0))).where((F.col("due") >= 0) & (F.col("due") < F.col("size") * F.col("n")))
        stop = at_edge.select("source", F.struct("order", "doc_id").alias("stop"), F.expr("due div size").alias("copies"), F.expr("due % size").alias("words"), "n")
        table = goal.alias("g").join(stop.alias("s"), F.expr("g.source <=> s.source"), "left").select(F.col("g.source").alias("of"), "source_size", "target", "whole", "stop", "copies", "words", "n")
        table = settled(table, n)
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(table) if few else table, F.expr("source <=> of"))
    place = F.struct("order", "doc_id")  # copies of a row have one place; its size, if not asked for, is not counted again
    here = F.coalesce((F.col("order") == F.col("stop.order")) & F.col("doc_id").eqNullSafe(F.col("stop.doc_id")), F.lit(False))
    more = F.when(here, F.col("copy") < F.col("copies")).otherwise(F.coalesce(place < F.col("stop"), F.lit(False)))
    part = F.when(here & (F.col("copy") == F.col("copies")), F.col("words")).otherwise(0)

    def done(df: DataFrame) -> DataFrame:
        out = df.withColumns({"repeats": (F.col("whole") + more.cast("long")).cast("long"), "part": part.cast("long")})
        return out.drop("of", "whole", "stop", "copies", "words", "n", "copy")

    if table.where("n > 1").isEmpty():
        return done(joined.withColumn("copy", F.lit(0)))
    # copies at the edge are numbered: where they lie first, as many as a partition holds, then along the partitions
    copies = lasting(spark).save(joined.where(here & (F.col("n") > 1)).withColumns({"at": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}))
    held = copies.groupBy("of", "at").agg(F.count("*").alias("held"))
    first = held.select(F.col("of").alias("f_of"), F.col("at").alias("f_at"), F.coalesce(F.sum("held").over(W.partitionBy("of").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    numbered = copies.join(first, F.expr("of <=> f_of and at = f_at"))
    numbered = numbered.withColumn("copy", F.col("first") + F.row_number().over(W.partitionBy("of", "at").orderBy("nth")) - 1).drop("f_of", "f_at", "first", "at", "nth")
    others = joined.where(~(here & (F.col("n") > 1)) | F.col("n").isNull()).withColumn("copy", F.lit(0).cast("long"))
    return done(others.unionByName(numbered))


def taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; its texts are read once."""
    rows = docs.select("doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("size"), _order(seed).alias("order"))
    done = _mixed(lasting(docs.sparkSession).save(rows), weights, epochs, frozen=True)
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats") + F.col("part")).alias("taken"))


def _copies(rows: DataFrame) -> DataFrame:
    """Rows with text, repeats, part as often as these say, with text cut to its first part words in a fraction."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats").cast("int"))))
    whole = F.col("copy") > 0
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.col("part").cast("int")), "")
    return copies.where(whole | (F.col("part") > 0)).withColumn("text", F.when(whole, F.col("text")).otherwise(head))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of a mix as often as it takes them, without the columns that ``mix`` adds; a fraction has its first words."""
    names = [c for c in mixed.columns if c.lower() not in ADDED]
    rows = _copies(mixed.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", "repeats", "part"))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names])


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all its columns, as often as the mix takes them; a fraction has its first words."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    done = _mixed(rows.withColumns({"size": words(F.col("text")), "order": _order(seed)}), weights, epochs)
    rows = _copies(done.select("row", "text", "repeats", "part"))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
