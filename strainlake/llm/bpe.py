"""BPE encoding and decoding through a table of the corpus' distinct words.

Encoding: documents are split into words in Spark, every distinct word is encoded once, and the ids are joined back at the
words' positions.  The table has two parts.  Words that are frequent in SAMPLE documents (at most FREQUENT short and LONG longer
ones, of bounded length) are encoded first and broadcast; the sample decides nothing else.  Documents become word numbers: ranks of
those words, and places in the document's own list of other words.  The other words of all documents are dealt by word and
sorted, each distinct one is encoded where its first row comes by, and the ids go back to their documents by a shuffled
join.  Where the rows of one word are more than a partition, Spark splits them (adaptive rebalancing), and each part encodes
the word once.  Texts are not shuffled.
Decoding: the distinct ids of each batch of documents are joined with the id-to-piece table, whose size the tokenizer fixes
and which is broadcast, and the pieces put in the places of the ids.

Defined cases: null text counts as empty; no words give no ids and the empty decoded text; repeated rows are
kept; input columns named as an output column make way.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainlake.llm._common import Scratch, field, map_texts, small_batches

#: Words that are broadcast at most, and the largest length and number of ids of each: 262,144 * (48 + 4 * 24) bytes at most.
FREQUENT, FREQUENT_BYTES, FREQUENT_IDS = 1 << 18, 48, 24
#: Longer words that are broadcast at most, such as rules and addresses: 2,048 * (1,024 + 4 * 1,024) bytes at most.
LONG, LONG_BYTES = 1 << 11, 1 << 10
#: Documents, chosen by a hash, in which frequent words are counted, and distinct words that a task counts at once.
SAMPLE, COUNTED_AT_ONCE = 30_000, 300_000
#: Marks a special token in the word list; no word can hold a space.
SPECIAL = " "

#: Characters on which all Unicode versions since 3.2 agree; texts with others are split by the library itself.
SETTLED = r"\x00-\u0557\u2010-\u2027\u2030-\u2046\u20ac\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
UNSETTLED = re.compile(f"[^{SETTLED}]")


@cache
def settled_class(prop: str) -> str:
    r"""Character ranges of the settled characters with a property such as \p{L}, for the standard library's faster patterns."""
    has, ranges = regex.compile(prop), []
    for c in range(0xD800):
        if has.fullmatch(chr(c)) and not UNSETTLED.match(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


@cache
def settled_words() -> re.Pattern:
    """The pattern by which the tokenizer splits normalised text, for texts of settled characters."""
    letter, digit, blank = (settled_class(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{blank}{letter}{digit}]+")


def byte_letters() -> list[str]:
    """Letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, others follow at 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(b if b in shown else next(rest)) for b in range(256)]


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def specials(path: str) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


def lowered(text: str) -> str:
    """NFC, then each character's own lower case (str.lower() has a rule of its own for a final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def split_words(path: str):
    """Function from a text to its words in order; a special token's string becomes SPECIAL + string."""
    own, lib, back = specials(path), tokenizer(path), {c: b for b, c in enumerate(byte_letters())}
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(own, key=len, reverse=True))) + ")")
    some = next(iter(own))[:2]

    find = settled_words().findall

    def plain(text: str) -> list[str]:
        low = lowered(text)
        if not UNSETTLED.search(text) and not UNSETTLED.search(low):
            return find(low)
        parts = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(back[c] for c in w).decode() for w, _ in parts]

    def words(text: str | None) -> list[str]:
        if not text:
            return []
        if some not in text:
            return plain(text)
        return [w for part in cut.split(text) for w in ([SPECIAL + part] if part in own else plain(part))]

    return words


def encode_word(path: str):
    """Function from a distinct word to its ids as little-endian unsigned 32-bit integers."""
    model, own, letters = tokenizer(path).model, specials(path), byte_letters()

    def ids(word: str) -> bytes:
        if word[:1] == SPECIAL:
            return struct.pack("<I", own[word[1:]])
        found = [t.id for t in model.tokenize("".join(letters[b] for b in word.encode()))]
        return struct.pack(f"<{len(found)}I", *found)

    return ids


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """word, n (occurrences), ids (binary): each distinct word of the texts, encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = split_words(path), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words(text))
                if len(seen) > COUNTED_AT_ONCE:
                    yield from table(seen)
                    seen.clear()
        yield from table(seen)

    def table(seen: Counter) -> Iterator[pa.RecordBatch]:
        keys, counts = list(seen), list(seen.values())
        for at in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000], pa.string()), pa.array(counts[at : at + 50_000], pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return map_texts(counted, "word", [field("ids", "binary")], lambda: lambda ws, f=encode_word(path): [[f(w) for w in ws]])


def encode(docs: DataFrame, path: str, frequent: int = FREQUENT, sample: int = SAMPLE, keep_text: bool = True, marked: bool = False) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers of the whole text); marked: as rows of ``_marked``, made by
    the workers that put the ids in place."""
    spark = docs.sparkSession
    share = sample / max(1, docs.count())
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("words"), "text"), F.lit(1 << 30)) < share * (1 << 30)) if share < 1 else docs
    with Scratch(spark) as scratch:
        table = scratch.save(word_table(drawn, path))
        short = (F.octet_length("word") <= FREQUENT_BYTES) & (F.octet_length("ids") <= 4 * FREQUENT_IDS)
        long = ~short & (F.octet_length("word") <= LONG_BYTES) & (F.octet_length("ids") <= 4 * LONG_BYTES)
        top = [table.where(of).orderBy(F.desc("n"), "word").limit(n).select("word", "ids") for of, n in ((short, frequent), (long, min(frequent, LONG)))]
        known = top[0].unionByName(top[1]).toArrow()  # columns, so that neither the driver nor the broadcast holds an object for each word
        every = share >= 1 and table.count() <= known.num_rows
    common = spark.sparkContext.broadcast(known)
    if every:
        out = map_texts(docs, "text", [field("ids", "binary")], lambda: _joined(path, dict(zip(_words(common), _ids(common)))))
        out = out if keep_text else out.drop("text")
        if marked:
            schema, mark = _marked(out.schema, path)
            out = out.mapInArrow(mark, schema)
        return out
    return _with_others(docs, path, common, keep_text, marked)


def _words(common) -> list[str]:
    return common.value["word"].to_pylist()


def _ids(common) -> list[bytes]:
    return common.value["ids"].to_pylist()


def _joined(path: str, known: dict[str, bytes]):
    words = split_words(path)

    def run(texts: list) -> list[list]:
        get = known.__getitem__
        return [[b"".join(map(get, words(t))) for t in texts]]

    return run


def _numbered(path: str, known: list[str]):
    """Function from a text to its words' numbers and to its other words: known words' ranks, then places in that list."""
    words, rank, first = split_words(path), {w: i for i, w in enumerate(known)}, len(known)

    def run(text: str | None) -> tuple[list[int], list[str]]:
        own: dict[str, int] = {}
        numbers = []
        for w in words(text):
            n = rank.get(w)
            numbers.append(own.setdefault(w, first + len(own)) if n is None else n)
        return numbers, list(own)

    return run


def _with_others(docs: DataFrame, path: str, common, keep_text: bool, marked: bool) -> DataFrame:
    """Words beyond the broadcast ones are encoded once each, gathered for each document, and put in place."""
    import zstandard

    docs = docs.drop("ids")
    key = {"__key": F.xxhash64(F.col("text")), **({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))} if "doc_id" in docs.columns else {})}
    keys = list(key)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank = split_words(path), set(_words(common))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = [list(dict.fromkeys([w for w in words(t) if w not in rank])) for t in b.column(0).to_pylist()]
                row = pa.array([i for i, ws in enumerate(found) for _ in ws], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).take(row) for k in range(1, len(keys) + 1)] + [pa.array([k for ws in found for k in range(len(ws))], pa.int32()), pa.array([w for ws in found for w in ws], pa.string())],
                    names=[*keys, "k", "word"],
                )

    keyed = docs.withColumns(key)
    pairs = keyed.select("text", *keys).mapInArrow(others, ", ".join(f"{k} {'long' if k == '__key' else 'string'}" for k in keys) + ", k int, word string")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, last, ids = encode_word(path), None, b""
        for b in batches:
            out = []
            for w in b.column(len(keys) + 1).to_pylist():
                if w != last:
                    last, ids = w, one(w)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*keys, "k", "ids"])

    ids_schema = T.StructType([*pairs.schema.fields[:-1], field("ids", "binary")])
    dealt = pairs.hint("rebalance", "word").sortWithinPartitions("word")
    # a set, as copies of a row (all with one key) send the same words
    found = dealt.mapInArrow(encoded, ids_schema).groupBy(*keys).agg(F.collect_set(F.struct("k", "ids")).alias("__others"))

    def number():
        numbered, packed = _numbered(path, _words(common)), zstandard.ZstdCompressor(3)
        return lambda texts: [[packed.compress(np.array(numbered(t)[0], "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for t in texts]]

    coded = map_texts(keyed, "text", [field("__numbers", "binary")], number)
    both = (coded if keep_text else coded.drop("text")).join(found, keys, "left")
    names = both.columns
    kept = [c for c in names if c not in (*keys, "__numbers", "__others")]
    out_schema = T.StructType([both.schema[c] for c in kept] + [field("ids", "binary")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unpacked = _ids(common), zstandard.ZstdDecompressor()
        first = len(ids)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = []
                for packed, own in zip(b.column(names.index("__numbers")).to_pylist(), b.column(names.index("__others")).to_pylist()):
                    numbers = np.frombuffer(unpacked.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().tolist()
                    if own:
                        mine = {first + r["k"]: r["ids"] for r in own}
                        out.append(b"".join([ids[n] if n < first else mine[n] for n in numbers]))
                    else:
                        out.append(b"".join(map(ids.__getitem__, numbers)))
                yield pa.RecordBatch.from_arrays([b.column(names.index(c)) for c in kept] + [pa.array(out, pa.binary())], names=[*kept, "ids"])

    if not marked:
        return both.mapInArrow(place, out_schema)
    marked_schema, mark = _marked(out_schema, path)
    return both.mapInArrow(lambda batches: mark(place(batches)), marked_schema)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece of every token: the tokenizer's id-to-piece table."""
    t = tokenizer(path)
    if t.decoder is not None:
        raise ValueError("pieces are joined by blanks only where the tokenizer has no decoder")
    return spark.createDataFrame(pa.table({"id": pa.array(range(t.get_vocab_size(with_added_tokens=True)), pa.int32()), "piece": [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]}))


def _marked(schema: T.StructType, path: str) -> tuple[T.StructType, Callable]:
    """Schema and function of batches that are preceded by a row for each id that stands in their column ids.

    Such a row has the id in the last column and nothing else; that column is null in the batches' own rows.
    """
    keep = [f.name for f in schema.fields]
    key = next(f"id{'_' * n}" for n in range(1, 99) if f"id{'_' * n}" not in {c.lower() for c in keep})
    size, at_ids = tokenizer(path).get_vocab_size(with_added_tokens=True), keep.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, stands = whole.slice(at, 512), np.zeros(size, bool)
                stands[np.frombuffer(b"".join(x for x in b.column(at_ids).to_pylist() if x), "<u4")] = True
                found = np.flatnonzero(stands).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(found), c.type) for c in b.columns], pa.array(found)], names=[*keep, key])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int32())], names=[*keep, key])

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [field(key, "int")]), run


def _decoded(marked: DataFrame, path: str) -> DataFrame:
    """Rows of ``_marked`` joined with the id-to-piece table, and the pieces put in the places of the ids."""
    *keep, key = marked.columns
    size, at_ids = tokenizer(path).get_vocab_size(with_added_tokens=True), keep.index("ids")
    table = pieces(marked.sparkSession, path).select(F.col("id").alias(f"{key}2"), F.col("piece").alias(f"{key}3"))
    joined = marked.join(F.broadcast(table), F.col(key) == F.col(f"{key}2"), "left").select(*[F.col(f"`{c}`") for c in keep], key, f"{key}3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fresh = [None] * size, False
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids, rows, out = b.column(len(keep)).to_pylist(), b.column(at_ids).to_pylist(), []
                for i, p, row in zip(ids, b.column(len(keep) + 1).to_pylist(), rows):
                    if i is None:
                        fresh = True
                        out.append("" if row is None else " ".join(map(known.__getitem__, np.frombuffer(row, "<u4").tolist())))
                    else:
                        if fresh:  # pieces of the next batch
                            known, fresh = [None] * size, False
                        known[i] = p
                docs = b.filter(pa.array([i is None for i in ids]))
                yield pa.RecordBatch.from_arrays([*docs.columns[:-2], pa.array(out, pa.string())], names=[*keep, "decoded"])

    return joined.mapInArrow(run, T.StructType([*marked.schema.fields[:-1], field("decoded", "string")]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded (string): the pieces of its ids, joined as the tokenizer's decode() joins them.

    Each batch of rows is preceded by a row for each id that stands in it; these rows are joined with the broadcast id-to-piece
    table, which keeps their order, and what follows reads a batch's pieces before its documents.
    """
    small_batches(encoded.sparkSession)
    kept = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"])
    schema, mark = _marked(kept.schema, path)
    return _decoded(kept.mapInArrow(mark, schema), path)


def digests(docs: DataFrame, path: str, frequent: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    done = _decoded(encode(docs.select("doc_id", "text"), path, frequent, sample, keep_text=False, marked=True), path)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
