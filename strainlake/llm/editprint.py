"""Fingerprints under which likeness follows edits: shared random walks over the characters.

Walk: one pointer moves over a text; at each time a random bit, shared by all texts and drawn for (time, character), says
whether it moves on.  Two texts meet again soon after an edit, so the walks' outputs, compared time by time, differ in
about as many places as the texts in edits (edit distance embedded into Hamming distance).  Random bits repeat after
PHASES times, so the time that a word takes is a function of the phase in which it begins; that is tabled for
words that recur, and a text of n words costs n steps.

Fingerprint: SAMPLES symbols of the output, at times drawn alike for all texts: each sampler keeps the last of a random
sequence of record times that the walk reached, a uniform time which texts of about the same length share.  Each
symbol is one byte (1 to 255); likeness is the share of equal symbols.

Groups: different texts that agree in a band of BAND_SYMBOLS sampled symbols are compared with the smallest of the bucket,
first by their fingerprints, then, where these are LOOSE alike at least, by the whole outputs of their walks.  Texts of LEAST
likeness so measured are linked.  Texts of a bucket that fell into different components are then compared with each other, all of
them, in blocks: no link between two components is lost, however large the bucket.  What can be missed is a pair without a common
band, of likeness 0.8 with probability (1 - 0.8 ** 8) ** 16, 0.05 (recall is measured in the tests).  Texts are told apart by 64-bit hashes.

Defined cases: null text counts as empty; empty texts have the fingerprint of zeros and are groups of their own; equal texts have
equal fingerprints and are one group; rows are ordered by doc_id, nulls first, ties by a hash of the text; the last row's next one
is the first; a null doc_id names no group; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.llm._common import Scratch, settled, small, small_batches
from strainlake.llm.neardup import GROUP, GROUPS, _bounded, components, spread, united

SAMPLES, PHASES, SEED = 128, 64, 20
#: Characters of a word that are tabled together, words that a worker remembers, and how often one is walked before it is tabled.
PIECE, REMEMBERED, TABLED_AFTER = 32, 200_000, 12
BANDS, BAND_SYMBOLS = 16, 8
#: Likeness of whole walks that links two texts, and that of fingerprints below which walks are not compared.
LEAST, LOOSE = 0.8, 0.6
#: Bytes of text that are held of a block of at most about GROUP texts.
BLOCK_BYTES = 32 << 20


class Walker:
    """Walks and fingerprints; all from SEED, so that every worker has the same."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        # a move at one of any four times at least: no word of PIECE characters takes more than a byte of time
        moves = rng.random((256, PHASES)) < 0.5
        moves[:, ::4] |= ~(moves[:, ::4] | moves[:, 1::4] | moves[:, 2::4] | moves[:, 3::4])
        steps = np.empty((256, PHASES), np.int64)
        for p in range(PHASES):
            ahead = moves[:, (p + np.arange(PHASES)) % PHASES]
            steps[:, p] = ahead.argmax(axis=1) + 1
        self.steps, self.lists = steps, steps.tolist()
        self.symbol = [1 + (xxhash.xxh64_intdigest(bytes([c]), seed) % 255) for c in range(256)]
        self.records = [self._records(rng) for _ in range(samples)]
        self.kind: dict[str, int] = {}
        self.times: dict[str, bytes] = {}
        self.met: dict[str, int] = {}

    @staticmethod
    def _records(rng) -> list[int]:
        """Times at which a uniform time in [0, T) is drawn anew as T grows."""
        out, t = [0], 0
        while t < 1 << 40:
            t = int(np.ceil((t + 1) / (1 - rng.random()))) - 1 or 1
            t = max(t, out[-1] + 1)
            out.append(t)
        return out

    def kind_of(self, c: str) -> int:
        got = self.kind.get(c)
        if got is None:
            got = self.kind[c] = ord(c) if ord(c) < 128 else 128 + xxhash.xxh32_intdigest(c.encode("utf-8", "surrogatepass")) % 128
        return got

    def _table(self, w: str) -> None:
        """Notes the time that the word takes, for each phase in which it can begin."""
        if len(self.times) >= REMEMBERED:
            self.times.clear()
        t = np.arange(PHASES)
        for c in w:
            t = t + self.steps[self.kind_of(c)][t % PHASES]
        self.times[w] = (t - np.arange(PHASES)).astype(np.uint8).tobytes()

    def _walked(self, w: str, t: int) -> int:
        """Time after a word that begins at t and has no table; it gets one once it was met often enough."""
        met = self.met
        n = met[w] = met.get(w, 0) + 1
        if n >= TABLED_AFTER:
            del met[w]
            self._table(w)
        elif len(met) > 2 * REMEMBERED:
            met.clear()
        kinds, lists = self.kind, self.lists
        for c in w:
            kind = kinds.get(c)
            t += lists[self.kind_of(c) if kind is None else kind][t & 63]
        return t

    @staticmethod
    def pieces(text: str) -> list[str]:
        words = text.split(" ")
        out = [w + " " for w in words[:-1]] + [words[-1]]
        return out if max(map(len, out)) <= PIECE else [w[i : i + PIECE] for w in out for i in range(0, len(w), PIECE)]

    def walk(self, pieces: list[str], at: list[int]) -> list[int]:
        """Times at which the pieces begin, and the end; ``at`` holds those before and gets the new ones."""
        get, walked, t, add = self.times.get, self._walked, at[-1], at.append
        for w in pieces:
            table = get(w)
            t = walked(w, t) if table is None else t + table[t & 63]
            add(t)
        return at

    def fingerprint(self, text: str) -> bytes:
        pieces = self.pieces(text)
        return self.sampled(pieces, self.walk(pieces, [0]), {})

    def output(self, text: str) -> np.ndarray:
        """The whole walk's output: the symbol at each time."""
        t, kinds, took, lists = 0, [], [], self.lists
        for c in text:
            kinds.append(self.kind_of(c))
            took.append(lists[kinds[-1]][t & 63])
            t += took[-1]
        return np.repeat(np.array(self.symbol, np.uint8)[np.array(kinds, np.int64)], took)

    def both(self, text: str, following: str) -> tuple[bytes, bytes, str]:
        """Fingerprints of the text and of its edited form, which are walked together as far as they agree; the edited text."""
        pieces = self.pieces(text)
        at = self.walk(pieces, [0])
        new = edited(text, following)
        head = text[: len(text) - len(text) // 4]
        same, n = head.count(" "), head.rfind(" ") + 1  # words that end in the part that stays
        rest = self.pieces(new[n:])
        if len(pieces) != text.count(" ") + 1 or len(rest) != new.count(" ", n) + 1:  # long words are cut into pieces
            return self.sampled(pieces, at, {}), self.fingerprint(new), new
        seen: dict[int, int] = {}
        own = self.sampled(pieces, at, seen)
        shared = {j: x for j, x in seen.items() if j < at[same]}  # the walks are one up to there
        return own, self.sampled(pieces[:same] + rest, self.walk(rest, at[: same + 1]), shared), new

    def sampled(self, pieces: list[str], at: list[int], seen: dict[int, int]) -> bytes:
        """The symbols at the samplers' times; ``seen`` holds those of times that were looked up before."""
        end, kinds, lists = at[-1], self.kind, self.lists
        if not end:
            return bytes(len(self.records))
        out = bytearray()
        for records in self.records:
            j = records[bisect_right(records, end - 1) - 1]
            got = seen.get(j)
            if got is None:
                k = bisect_right(at, j) - 1
                t = at[k]
                for c in pieces[k]:
                    kind = kinds.get(c)
                    if kind is None:
                        kind = self.kind_of(c)
                    t += lists[kind][t & 63]
                    if t > j:
                        break
                got = seen[j] = self.symbol[kind]
            out.append(got)
        return bytes(out)


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal symbols of two whole walks, of the longer one's times."""
    n = min(len(a), len(b))
    return float((a[:n] == b[:n]).sum()) / max(len(a), len(b), 1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many characters (or all) of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, turn, h, packed: the text's bytes, compressed), one partition for each part, sorted.

    Parts are ranges of doc_id between quantiles; rows without one come first, in ranges of the hash.  turn is 0 for a row of the part; the first row of the part that follows is
    added with turn 1 (2 after the last part), so that every row's next one is in its partition.  Only these are sent twice.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("q")).first()[0] if n > 1 else []
    marks = np.array(sorted(set(marks or [])), np.int64)

    of_null = 0 if rows.where("doc_id is null").isEmpty() else n

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, h: pd.Series) -> pd.Series:
        found = np.searchsorted(marks, ids.fillna(0).to_numpy(np.int64), side="left") if len(marks) else np.zeros(len(ids), np.int64)
        first = np.clip(np.floor((h.to_numpy(np.int64) / 2.0**64 + 0.5) * of_null), 0, max(0, of_null - 1))
        return pd.Series(np.where(ids.isna(), first, of_null + found).astype(np.int32))

    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("part", part_of("doc_id", "h"))
    order = F.struct("doc_id", "h")
    firsts = rows.select("part", "doc_id", "h").groupBy("part").agg(F.min(order).alias("first"))
    firsts = sorted((r.part, r["first"]) for r in firsts.collect())  # a row for each part
    if not firsts:
        return rows.limit(0).select("doc_id", "part", F.lit(0).alias("turn"), "h", F.col("text").cast("binary").alias("packed"))
    shifted = [(firsts[k - 1][0], 2 if k == 0 else 1, f[1].doc_id, f[1].h) for k, f in enumerate(firsts)]
    heads = spark.createDataFrame(shifted, "to_part int, turn int, id long, hh long")
    added = rows.join(F.broadcast(heads), F.expr("doc_id <=> id and h = hh")).dropDuplicates(["doc_id", "h", "to_part"]).select("doc_id", "text", F.col("to_part").alias("part"), "h", "turn")
    every = rows.withColumn("turn", F.lit(0)).unionByName(added).select("doc_id", "part", "turn", "h", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for b in batches:
            texts = [pack(t.encode("utf-8", "surrogatepass")) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.binary())], names=["doc_id", "part", "turn", "h", "packed"])

    small_batches(spark)
    every = every.mapInArrow(packed, "doc_id long, part int, turn int, h long, packed binary")
    dealt = every.repartitionById(firsts[-1][0] + 1, F.col("part"))
    return dealt.sortWithinPartitions("part", "turn", F.asc_nulls_first("doc_id"), "h")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """doc_id, n_chars, fingerprint (hex), h (the text's hash) of every document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Walker(samples, seed)
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([w.fingerprint(t).hex() for t in texts], pa.string()), b.column(1)], names=["doc_id", "n_chars", "fingerprint", "h"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string, h long")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id of every document.

    group_id: the smallest doc_id among the texts that verified links connect with the document's.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.save(_compared(docs))
        named = grouped(rows, docs, scratch)
        out = spread(rows, named, "h", "copies", rows.count(), "left")
        return settled(out.select(*PRINTED, F.coalesce("group_id", "doc_id").alias("group_id")))


PRINTED = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compared(docs: DataFrame) -> DataFrame:
    """PRINTED and h, the text's hash, of every document."""
    rows = with_next(docs)
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
    names = [*PRINTED, "h"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, last, row, row_print = Walker(), None, None, b""
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, out = whole.slice(at, 512), []
                for doc_id, part, turn, h, data in zip(*[b.column(i).to_pylist() for i in range(5)]):
                    text = unpack(data).decode("utf-8", "surrogatepass")
                    if last is not None and last[1] == part:
                        before, _, prior, hash_ = last
                        own, other, new = w.both(prior, text)
                        if row is not None:
                            out.append((*row[:-1], likeness(row_print, own), row[-1]))
                        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                        row, row_print = (before, len(prior), digest, own.hex(), other.hex(), likeness(own, other), hash_), own
                    if turn != 0 and row is not None:
                        out.append((*row[:-1], likeness(row_print, w.fingerprint(text)), row[-1]))
                        row = None
                    last = (doc_id, part, text, h) if turn == 0 else None
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=names)

    return rows.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, least: float, seed: int, scratch: Scratch) -> DataFrame:
    """a, b, likeness of the pairs (a, b), a saved table, whose texts' whole walks agree in a share of at least ``least``.

    texts: h, text of both.  The text of a is sent once for each GROUP of its partners, and walked as often.
    """
    total = pairs.count()
    degree = scratch.save(pairs.groupBy("a").count(), total)
    groups = F.least(F.ceil(F.col("count") / GROUP), F.lit(GROUPS))
    dealt = spread(pairs, degree.select("a", groups.alias("groups"), "count"), "a", "count", total).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    heads = degree.select("a", groups.alias("groups")).join(texts, F.col("a") == texts.h)
    first = heads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(texts, dealt.b == texts.h).select("a", "part", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, now, walked = Walker(1, seed), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out = []
                for a, part, b, text in zip(*[whole.slice(at, 512).column(i).to_pylist() for i in range(4)]):
                    if b is None:
                        now, walked = (a, part), w.output(text)
                    elif (a, part) == now and (like := agreement(walked, w.output(text))) >= least:
                        out.append((a, b, like))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64()])], names=["a", "b", "likeness"])

    return first.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long, likeness double")


class Block:
    """Texts that meet in a block; those of one component, given or found by their links, are not compared."""

    def __init__(self, w: Walker, least: float):
        self.w, self.least, self.loose = w, least, least - (LEAST - LOOSE)
        self.held: list[list] = []  # h, root, text or its walk
        self.prints = np.empty((0, 0), np.uint8)
        self.joined: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.joined.get(x, x)) != x:
            x = up
        return x

    def links(self, h: int, root: int, mark: bytes, text: str, meets: bool, stays: bool) -> list[tuple]:
        """Links (a, b, likeness) of the text with those that are held, if it meets them; it is held too, if it stays."""
        own, row, out, n = np.frombuffer(mark, np.uint8), [h, root, text], [], len(self.held)
        for k in np.flatnonzero((self.prints[:n] == own).mean(axis=1) >= self.loose) if meets and n else ():
            other = self.held[k]
            if (x := self.root(other[1])) != (y := self.root(root)):
                for r in (other, row):
                    if isinstance(r[2], str):
                        r[2] = self.w.output(r[2])
                if (like := agreement(other[2], row[2])) >= self.least:
                    self.joined[max(x, y)] = min(x, y)
                    out.append((min(h, other[0]), max(h, other[0]), like))
        if stays:
            if n == len(self.prints):
                self.prints = np.concatenate([self.prints.reshape(n, len(own)), np.empty((max(16, n), len(own)), np.uint8)])
            self.prints[n] = own
            self.held.append(row)
        return out


def met_in_blocks(members: DataFrame, prints: DataFrame, texts: DataFrame, least: float, seed: int, scratch: Scratch) -> DataFrame:
    """Links (a, b, likeness) between members (band, h, root; saved) of one band and different roots, as many as join what they join.

    texts: h, text, bytes.  The members of each band's largest root and the others are dealt by hash into blocks of about GROUP texts and
    BLOCK_BYTES; each block of the others meets all blocks of that root and of the others.  Fingerprints and texts are sent to
    the blocks, pairs never.
    """
    few = scratch.save(members.select("h").distinct(), members.count())
    known = scratch.save(texts.join(_bounded(few), "h", "left_semi").join(prints.join(_bounded(few), "h", "left_semi").select("h", "fingerprint"), "h"))
    of_root = members.join(known.select("h", "bytes"), "h").groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of_band = of_root.groupBy("band").agg(F.max(F.struct("n", "bytes", "root")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("roots"))
    parts = lambda n, size: F.greatest(F.ceil(n / GROUP), F.ceil(size / BLOCK_BYTES))
    main, rest = parts(F.col("most.n"), F.col("most.bytes")), parts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    of_band = scratch.save(of_band.select("band", F.col("most.root").alias("main"), main.alias("mains"), rest.alias("rests"), "roots"), few.count())

    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    of_main = F.col("root") == F.col("main")
    block = F.pmod(F.xxhash64(F.lit("block"), "h"), F.when(of_main, F.col("mains")).otherwise(F.col("rests")))
    place = lambda apart, i, j, side: F.struct(F.lit(apart).alias("apart"), i.alias("i"), j.alias("j"), side.alias("side"))
    with_main = F.transform(each("mains"), lambda i: place(False, i, F.col("block"), F.lit(1)))
    with_rest = F.transform(each("rests"), lambda j: place(True, F.least(j, "block"), F.greatest(j, "block"), (j < F.col("block")).cast("int")))
    of_rest = F.when(F.col("roots") > 2, F.concat(with_main, with_rest)).otherwise(with_main)
    places = F.when(of_main, F.transform(each("rests"), lambda j: place(False, F.col("block"), j, F.lit(0)))).otherwise(of_rest)
    dealt = members.join(small(of_band), "band").withColumn("block", block).select("band", "h", "root", F.explode(places).alias("at"))
    key = ["band", "apart", "i", "j"]
    rows = dealt.select("band", "at.*", "h", "root").join(known, "h").select(*key, "side", "h", "root", F.unhex("fingerprint").alias("mark"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, now, block = Walker(1, seed), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out = []
                for *to, side, h, root, mark, text in zip(*[whole.slice(at, 512).column(i).to_pylist() for i in range(9)]):
                    if to != now:
                        now, block = to, Block(w, least)
                    _, apart, i, j = to
                    out += block.links(h, root, mark, text, side == 1 or apart and i == j, side == 0)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64()])], names=["a", "b", "likeness"])

    met = rows.repartition(*key).sortWithinPartitions(*key, "side", "h").mapInArrow(run, "a long, b long, likeness double")
    return scratch.save(met.dropDuplicates(["a", "b"]), members.count())


def near_links(prints: DataFrame, docs: DataFrame, scratch: Scratch, least: float = LEAST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, likeness) between different texts, by their hashes, and the components (c, root) that they make.

    prints: h, fingerprint of each different text, saved.  Two texts that share a band, whose fingerprints are LOOSE alike and whose
    walks are alike are in one component.  A member is compared with its bucket's hub; those of other components with each other.
    """
    width, samples = 2 * BAND_SYMBOLS, prints.select(F.max(F.length("fingerprint"))).first()[0] or 0
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("fingerprint", 1 + b * width, width)) for b in range(max(1, min(BANDS, samples // width)))])
    banded = prints.select("h", F.explode(keys).alias("band"))
    in_bands = prints.count() * BANDS
    hubs = scratch.save(banded.groupBy("band").agg(F.min("h").alias("hub"), F.max("h").alias("top")).where("hub < top").select("band", "hub"), in_bands)
    members = scratch.save(banded.join(small(hubs), "band"), in_bands)
    n = members.count()
    involved = scratch.save(members.select("h").distinct(), n)
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.save(rows.join(small(involved), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")).withColumn("bytes", F.octet_length("text")))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, x, b, y: hashes and fingerprints) of which the fingerprints are LOOSE alike at least."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in batches:
                prints_ = [np.frombuffer(bytes.fromhex("".join(p.column(i).to_pylist())), np.uint8).reshape(p.num_rows, -1) for i in (1, 3)]
                q = p.filter(pa.array((prints_[0] == prints_[1]).mean(axis=1) >= least - (LEAST - LOOSE), pa.bool_()) if p.num_rows else pa.array([], pa.bool_()))
                yield pa.RecordBatch.from_arrays([q.column(0), q.column(2)], names=["a", "b"])

        return scratch.save(pairs.select("a", "x", "b", "y").mapInArrow(run, "a long, b long").distinct())

    print_of = lambda name, to: prints.select(F.col("h").alias(name), F.col("fingerprint").alias(to))

    def linked(pairs: DataFrame) -> DataFrame:
        return scratch.save(verified(likely(pairs.join(print_of("a", "x"), "a").join(print_of("b", "y"), "b")), texts, least, seed, scratch))

    links = linked(members.where("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct())
    roots = components(links.select("a", "b"), scratch)
    # the hubs have met all of their buckets; the others of a bucket, where they are not of one component, meet now
    rooted = members.where("h <> hub").join(roots, F.col("h") == F.col("c"), "left").select("band", "h", F.coalesce("root", "h").alias("root"))
    rooted = scratch.save(rooted, n)
    disputed = scratch.save(rooted.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("band"), n)
    if not disputed.isEmpty():
        more = met_in_blocks(scratch.save(rooted.join(small(disputed), "band"), n), prints, texts, least, seed, scratch)
        if not more.isEmpty():
            links, roots = scratch.save(links.unionByName(more)), united(roots, more.select("a", "b"), scratch)
    return links, roots


def grouped(rows: DataFrame, docs: DataFrame, scratch: Scratch, least: float = LEAST, seed: int = SEED) -> DataFrame:
    """h, copies, group_id of each different text that is not empty; rows: doc_id, n_chars, fingerprint, h of docs, saved."""
    each = [F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("fingerprint").alias("fingerprint")]
    n = rows.count()
    texts = scratch.save(rows.where("n_chars > 0").groupBy("h").agg(*each), n)
    _, roots = near_links(texts.select("h", "fingerprint"), docs, scratch, least, seed)
    placed = scratch.save(texts.select("h", "copies", "id").join(roots, F.col("h") == F.col("c"), "left").select("h", "copies", "id", F.coalesce("root", "h").alias("root")), n)
    least_id = scratch.save(placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n")), n)
    return scratch.save(spread(placed.select("h", "copies", "root"), least_id, "root", "n", placed.count()).select("h", "copies", "group_id"), n)


def near_pairs(docs: DataFrame, least: float = LEAST, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """hub, doc_id, likeness: verified links between documents of different texts, and (likeness 1) between copies of a text and its
    smallest doc_id; hub < doc_id, of each text its smallest.  Documents without an id are not in it."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.save(fingerprints(docs, samples, seed).where("n_chars > 0 and doc_id is not null"))
        texts = scratch.save(rows.groupBy("h").agg(F.min("doc_id").alias("id"), F.first("fingerprint").alias("fingerprint")))
        links, _ = near_links(texts.select("h", "fingerprint"), docs, scratch, least, seed)
        ids = texts.select("h", "id")
        named = links.join(ids.select(F.col("h").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("h").alias("b"), F.col("id").alias("y")), "b")
        named = named.select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("doc_id"), "likeness").where("hub < doc_id")
        copies = rows.join(ids, "h").where("id < doc_id").select(F.col("id").alias("hub"), "doc_id", F.lit(1.0).alias("likeness"))
        return settled(named.unionByName(copies).groupBy("hub", "doc_id").agg(F.max("likeness").alias("likeness")))
