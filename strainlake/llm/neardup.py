"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. Every document becomes the set of its hashed word shingles, a sketch of it (see fastsketch) and band keys.
   Documents of equal sets are one class from here on, however many copies there are.
2. Classes that share a band are compared with the smallest class of that bucket, on full sets: a number of
   comparisons in proportion to the bucket, which finds nearly all links.  Linked classes form components.
3. Classes of a bucket that fell into different components may still be linked with each other.  In buckets of at
   most SMALL classes each such pair is verified.  In larger ones candidates come from an exact prefix filter:
   with shingles ordered by rarity, two similar sets must share one of their first few shingles.  Bitmaps of the shingles'
   parities rule out most pairs that come close, before anything is sent.
4. Components follow from alternating large-star and small-star steps over the link table.

Nothing about all documents reaches the driver.  Probability enters at one place: a pair of similarity s shares no
band with probability (1 - s**rows)**bands, 8e-7 at 0.85 and 120 coordinates in bands of 5.  Sets are told apart by hashes of
128 bits (a class is named by 64 of them, and by others where two classes share those), shingles by 64 bits.
Classes with many copies and nodes with many links are dealt over several tasks where rows are joined by them (``spread``).

Defined cases: null or wordless texts have an empty set, are linked with nothing and kept; texts of fewer words than a
shingle have one shingle; repeated rows are linked like copies; a null doc_id belongs to its group but never names one, and
is kept only in groups without any id; other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.llm import fastsketch as fs
from strainlake.llm._common import Scratch, extended, field, map_texts, settled

#: Classes in a bucket up to which all open pairs are verified (31 a class at most).
SMALL = 32
#: Members compared in one streamed group; hubs with more are split, into at most GROUPS of them.
GROUP, GROUPS = 128, 1 << 16
#: Rows of one key that a join leaves in one task, at least, and the share of all rows that it does.
TOGETHER, SHARE = 1000, 1 / 2000
#: Rows of 16 bytes up to which a table is broadcast (16 MB); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Longs of 64 bits in a set's parity bitmap.
BITMAP = 8
BITS = tuple(f"bits{i}" for i in range(BITMAP))
#: Ratio of neighbouring size classes in the prefix filter.
STEP = 1.02


def _set_ids(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's hash as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def spread(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a saved table (one row for each key, with the number ``copies`` of rows that have it).

    Keys of more than TOGETHER rows and SHARE of the total are dealt over several tasks, the table's rows with them; there are
    at most 1 / SHARE such keys, so their list is broadcast.  rows are read from saved tables, so that a task that runs again
    deals them alike.  ``copies`` is left out of the result.
    """
    most = max(TOGETHER, int(total * SHARE))
    parts = F.greatest(F.ceil(F.col(copies) / most), F.lit(1).cast("long"))
    hot = table.where(F.col(copies) > most).select(F.col(key).alias("__hot"), parts.alias("__parts"))
    if hot.isEmpty():
        return rows.join(table.drop(copies), key, how)
    dealt = table.withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(copies)
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    salted = salted.withColumn("__deal", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__parts")), F.lit(0).cast("long")))
    return salted.drop("__hot", "__parts").join(dealt, [key, "__deal"], how).drop("__deal")


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def features(docs: DataFrame, width: int, coords: int, rows: int) -> DataFrame:
    """doc_id, key (finds the row again), n (set size), c and d (hash of the set), bands."""
    rows_in = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text")
    schema = extended(rows_in.drop("text").schema, *_fields("n long, c long, d long, bands array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = fs.WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                n, c, d, bands = [], [], [], []
                for text in b.column(2).to_pylist():
                    s = fs.shingles(fs.words_of(text), hashes, width)
                    n.append(len(s))
                    for ids, half in zip((c, d), _set_ids(s) if len(s) else (None, None)):
                        ids.append(half)
                    bands.append(_signed(fs.band_keys(fs.sketch(s, coords), rows)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return rows_in.mapInArrow(run, schema)


def _fields(ddl: str):
    from pyspark.sql import types as T

    return list(T._parse_datatype_string(ddl).fields)


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_ROWS rows; df must be a saved table of two numbers a row."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _parities(s: np.ndarray) -> np.ndarray:
    """Bitmap whose bits are the parities of the shingles hashed to them: two bitmaps differ in no more bits than their sets in shingles."""
    n = np.bincount((fs.mix(s) >> np.uint64(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(n.astype(np.uint8)).view(np.int64)


def _may_be_similar(x: str, y: str, percent: int):
    """False only if sizes or bitmaps rule it out: similar sets differ in at most (100 - percent) / (100 + percent) of their joint size."""
    differ = sum((F.bit_count(F.col(f"{x}bits{i}").bitwiseXOR(F.col(f"{y}bits{i}"))) for i in range(BITMAP)), F.lit(0))
    return _sizes_allow(f"{x}n", f"{y}n", percent) & ((100 + percent) * differ <= (100 - percent) * (F.col(f"{x}n") + F.col(f"{y}n")))


def _named(df: DataFrame, prefix: str, *same: str) -> DataFrame:
    return df.select(*same, *[F.col(c).alias(f"{prefix}{c}") for c in ("c", "n", "root", *BITS)])


def _sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """c, d, bits0 ... (parity bitmap), shingles (sorted 64-bit hashes as bytes) of the documents found by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = fs.WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found = [fs.shingles(fs.words_of(t), hashes, width) for t in whole.slice(at, 1024).column(0).to_pylist()]
                found = [s for s in found if len(s)]
                bits = np.array([_parities(s) for s in found], np.int64).reshape(len(found), BITMAP)
                ids = [_set_ids(s) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in ids], pa.int64()), pa.array([d for _, d in ids], pa.int64()), *[pa.array(np.ascontiguousarray(b)) for b in bits.T], pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["c", "d", *BITS, "shingles"],
                )

    rows = docs.select("text", F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("key"))
    return rows.join(_bounded(keys), "key", "left_semi").select("text").mapInArrow(run, "c long, d long, " + "".join(f"{b} long, " for b in BITS) + "shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b), a saved table, whose full sets are similar; a's set is sent once for each GROUP of its partners."""
    total = pairs.count()
    degree = scratch.save(pairs.groupBy("a").count(), total)
    groups = F.least(F.ceil(F.col("count") / GROUP), F.lit(GROUPS))
    dealt = spread(pairs, degree.select("a", groups.alias("groups"), "count"), "a", "count", total).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    heads = degree.select("a", groups.alias("groups")).join(sets, F.col("a") == sets.c)
    first = heads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    others = dealt.join(sets, dealt.b == sets.c).select("a", "part", "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in batches:
            out = []
            for a, part, b, s in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                s = np.frombuffer(s, np.uint64)
                if b is None:
                    now, one = (a, part), s
                elif (a, part) == now and fs.similar(one, s, percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return first.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """c, root (smallest class reachable) of every class that has a link (a, b)."""
    edges, before = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), None
    edges = scratch.save(edges, links.count())
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("larger")).select("u", F.least("u", "m").alias("m"), "larger"), 2 * state.n)
        large = spread(both.where("v > u"), least, "u", "larger", state.n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, state.n)
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), state.n)
        small = spread(large, least, "u", "n", state.n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = scratch.save(small.select("e.u", "e.v").where("u <> v").distinct(), 2 * state.n)


def united(roots: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """roots (c, root) once the pairs (a, b) of ``more`` are linked as well: only the roots that these touch are joined anew."""
    of = lambda x: F.coalesce(F.col(f"{x}.root"), F.col(x))
    n = more.count()
    met = more.join(roots.alias("ra"), F.col("a") == F.col("ra.c"), "left").select(F.coalesce("ra.root", "a").alias("a"), "b")
    met = met.join(roots.alias("rb"), F.col("b") == F.col("rb.c"), "left").select("a", F.coalesce("rb.root", "b").alias("b")).where("a <> b")
    moved = components(scratch.save(met, n), scratch).select(F.col("c").alias("old"), F.col("root").alias("new"))
    later = roots.join(_bounded(moved), F.col("root") == F.col("old"), "left").select("c", F.coalesce("new", "root").alias("root"))
    # roots and classes without links have no row in roots; those that are moved get one
    return scratch.save(later.unionByName(moved.select(F.col("old").alias("c"), F.col("new").alias("root"))), roots.count() + n)


def prefix_pairs(open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots that share a shingle within the prefixes which their sizes and percent call for.

    open_sets: c, n, root, bits, shingles.  Exact: similar sets x <= y share at least p / (1 + p) * (x + y) shingles, so in any
    common order each has one of them among its first size - that + 1.  Rare shingles come first, so that sets that
    differ in their own edits of a shared text hardly meet.  Size classes keep the prefixes short.
    """
    p = percent / 100
    reach = math.ceil(math.log(1 / p) / math.log(STEP)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, n, s in zip(*[b.column(i).to_pylist() for i in range(3)]):
                s = np.frombuffer(s, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), x), pa.int64()) for x in (c, n)] + [pa.array(s)], names=["c", "n", "s"])

    tokens = open_sets.select("c", "n", "shingles").mapInArrow(run, "c long, n long, s long")
    shared = tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    from pyspark.sql import Window as W

    own = W.partitionBy("c")
    ranked = tokens.join(shared, "s").withColumn("rank", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "s")))
    size = F.floor(F.log("n") / math.log(STEP)).cast("int")
    dealt = ranked.withColumn("size", size).withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    least = F.pow(F.lit(STEP), F.col("size") + F.col("d") - 1e-6)
    partner = F.when(F.col("d") > 0, F.greatest(F.col("n").cast("double"), least)).otherwise(F.greatest(F.col("n") * p, least))
    need = F.ceil((F.col("n") + partner) * (p / (1 + p)) - 1e-6)
    dealt = dealt.where(F.col("rank") <= F.col("n") - need + 1)
    dealt = dealt.select("c", "s", "size", "d").join(open_sets.drop("shingles"), "c")
    x = _named(dealt.where("d >= 0"), "x", "s", "size", "d")
    y = _named(dealt.where("d <= 0"), "y", "s", (F.col("size") + F.col("d")).alias("size"), (-F.col("d")).alias("d"))
    met = x.join(y, ["s", "size", "d"]).where((F.col("xroot") != F.col("yroot")) & ((F.col("d") > 0) | (F.col("xc") < F.col("yc"))) & _may_be_similar("x", "y", percent))
    return met.select(F.least("xc", "yc").alias("a"), F.greatest("xc", "yc").alias("b")).distinct()


def _sizes_allow(x: str, y: str, percent: int):
    return 100 * F.least(F.col(x), F.col(y)) >= percent * F.greatest(F.col(x), F.col(y))


def _classes_of(width: int):
    """A function from texts to the hashes of their sets, as features gives them."""
    hashes = fs.WordHashes()

    def run(texts: list) -> list[list]:
        sets = [fs.shingles(fs.words_of(t), hashes, width) for t in texts]
        return [list(x) for x in zip(*[_set_ids(s) if len(s) else (None, None) for s in sets])]

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coords: int = 160, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id)."""
    return _grouped(docs, width, percent, coords, rows).drop("key", "c", "d")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, coords: int = 160, rows: int = 5) -> DataFrame:
    """The rows of docs, with its columns, of which one of each group stays, that of the smallest doc_id."""
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    groups = _grouped(docs, width, percent, coords, rows)
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"), "text")
    lost = groups.where(~F.col("kept")).select("key", "c", "d").distinct()
    n = groups.count()
    gone = settled(lost.select("key").distinct(), n)
    left = keyed.join(_bounded(gone), "key", "left_anti")
    mixed = settled(groups.where("kept").select("key").distinct().join(_bounded(gone), "key", "left_semi"), n)
    if not mixed.isEmpty():  # an id on rows of unlike texts, of which some stay: told apart by their sets
        classed = map_texts(keyed.join(_bounded(mixed), "key", "left_semi"), "text", [field("c", "long"), field("d", "long")], lambda: _classes_of(width)).alias("r")
        again = classed.join(lost.alias("l"), F.expr("r.key = l.key and r.c <=> l.c and r.d <=> l.d"), "left_anti").drop("c", "d")
        left = left.unionByName(again)
    twice = settled(groups.where("kept and n_shingles > 0").groupBy("key").count().where("count > 1").select("key"), n)
    if not twice.isEmpty():  # rows of one id: of equal texts among them, one stays
        again = left.join(_bounded(twice), "key", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["key", "h"]).drop("h")
        left = left.join(_bounded(twice), "key", "left_anti").unionByName(again)
    return left.select("row.*")


def _grouped(docs: DataFrame, width: int, percent: int, coords: int, rows: int) -> DataFrame:
    """doc_id, key, c, d (hash of the set), n_shingles, component_id, kept of every document."""
    with Scratch(docs.sparkSession) as scratch:
        raw = scratch.save(features(docs, width, coords, rows))
        # classes: equal sets, whose hashes agree in all 128 bits; one of several that share the first 64 keeps those as its name
        alike = raw.where("c is not null").groupBy("c").agg(F.min("d").alias("least_d"), F.max("d").alias("most_d"))
        n = raw.count()
        shared = scratch.save(alike.where("least_d < most_d").select(F.col("c").alias("shared"), "least_d"), n)

        def named(df: DataFrame) -> DataFrame:
            if shared.isEmpty():
                return df
            own = F.when(F.col("d") != F.col("least_d"), F.xxhash64("c", "d")).otherwise(F.col("c"))
            return df.join(_bounded(shared), F.col("c") == F.col("shared"), "left").withColumns({"c": own, "hash_c": F.col("c")}).drop("shared", "least_d")

        each = [F.min("key").alias("key"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.count("*").alias("copies"), F.first("bands").alias("bands")]
        classes = scratch.save(named(raw).where("c is not null").groupBy("c").agg(*each), n)
        in_bands = classes.count() * (coords // rows)
        banded = classes.select("c", "n", F.explode("bands").alias("bucket"))
        many = scratch.save(banded.groupBy("bucket").agg(F.min("c").alias("hub"), F.max("c").alias("top")).where("hub < top").select("bucket", "hub"), in_bands)
        members = scratch.save(banded.join(_bounded(many), "bucket").select("bucket", "hub", "c", "n"), in_bands)
        stars = scratch.save(members.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct(), members.count())
        keys = scratch.save(classes.select("c", "key").join(members.select("c").distinct(), "c", "left_semi").select("key"), n)
        sets = scratch.save(named(_sets(docs, keys, width)).drop("d", "hash_c"))
        if sets.select("c").distinct().count() < sets.count():  # a doc_id that stands more than once
            sets = scratch.save(sets.dropDuplicates(["c"]))
        links = scratch.save(verify(stars, sets, percent, scratch))
        roots = components(links, scratch)

        rooted = scratch.save(members.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), members.count())
        disputed = scratch.save(rooted.groupBy("bucket").agg(F.count("*").alias("k"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("bucket", "k"), many.count())
        if not disputed.isEmpty():
            open_rows = rooted.join(_bounded(disputed), "bucket")
            few = open_rows.where(F.col("k") <= SMALL).where("c <> hub").select("bucket", "c", "n", "root").join(sets.drop("shingles"), "c")
            met = _named(few, "x", "bucket").join(_named(few, "y", "bucket"), "bucket").where((F.col("xc") < F.col("yc")) & (F.col("xroot") != F.col("yroot")) & _may_be_similar("x", "y", percent))
            pairs = met.select(F.col("xc").alias("a"), F.col("yc").alias("b")).distinct()
            large = open_rows.where(F.col("k") > SMALL).select("c", "n", "root").distinct()
            pairs = pairs.unionByName(prefix_pairs(large.join(sets, "c"), percent)).distinct()
            more = scratch.save(verify(scratch.save(pairs), sets, percent, scratch))
            if not more.isEmpty():
                roots = united(roots, more, scratch)

        # a label for each class first, then one join with the documents, in which classes of many copies are spread
        least = scratch.save(classes.select("c", "copies", "least").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), n)
        smallest = scratch.save(least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), n)
        named_classes = scratch.save(spread(least.select("c", "copies", "root"), smallest, "root", "n", least.count()).select("c", "copies", "component_id"), n)
        placed = spread(named(raw.drop("bands")), named_classes, "c", "copies", n, "left")
        component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        first = F.coalesce("hash_c", "c") if "hash_c" in placed.columns else F.col("c")
        out = placed.select("doc_id", "key", first.alias("c"), "d", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
        return settled(out, n)
