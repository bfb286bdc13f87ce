"""Language identification by the nearest of several clustered centroids per language.

Texts become TF-IDF vectors of hashed byte trigrams (lower case, everything but letters a blank), normalised to
length 1.  Spherical k-means clusters a sample of each language's vectors; a text gets the language of the centroid
with the largest cosine and is rejected (``accepted`` is false, the language stays) if it lies farther from that
centroid than RADIUS times the FAR quantile of the sample's own distances.

The model is fitted on at most SAMPLE different labelled texts, spread evenly over the languages and chosen by a hash.
Defined cases: text null or without a letter gives ``und`` and score 0; without labelled rows every text does.
Repeated rows are kept; an input column named as an output column makes way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainlake.llm._common import field, map_texts

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 8
#: Labelled rows that the model is fitted on, over all languages.
SAMPLE = 3000
FAR, RADIUS = 0.995, 1.1
LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """How often each hashed byte trigram stands in the text."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    code = code[code != 0x202020]
    return np.bincount(((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), minlength=DIMENSIONS)


def known(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    radius: np.ndarray

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf
        return v / (np.linalg.norm(v) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not known(text) or not self.languages:
            return "und", 0.0, False
        cos = self.centroids @ self.vector(counts(text))
        k = int(cos.argmax())
        return self.languages[k], float(min(1.0, max(0.0, cos[k]))), bool(1 - cos[k] <= self.radius[k])


def clusters(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and the cluster of each row; starts at rows that are far from each other."""
    c = x[:1]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[(x @ c.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.vstack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def drawn(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, lang: at most ``sample`` different labelled texts, the same number of each language, by a hash of the text.

    Of more languages than that, those of the most texts take part.  Copies of a text count once, before anything is sent; a
    first cut by the hash, twice as wide as a language's share, keeps what is ranked small in every language.
    """
    h = F.xxhash64(F.lit("language sample"), "text")
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", h.alias("h"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("texts"), "lang").limit(sample).collect()
    each = max(1, sample // max(1, len(found)))
    cuts = [(r.lang, min(1.0, (2 * each + 100) / max(1, r.texts))) for r in found]
    cuts = labelled.sparkSession.createDataFrame(cuts, "of string, share double")
    place = F.pmod("h", F.lit(1 << 30)).cast("double") / float(1 << 30)
    near = rows.join(F.broadcast(cuts), F.expr("lang = of")).where(place < F.col("share"))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return once.withColumn("rank", rank).where(F.col("rank") <= each).select("text", "lang")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from text, lang rows; what reaches the driver is at most sample * DIMENSIONS numbers and the languages' names."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(lang, counts(text)) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if known(text)]
            at = [np.flatnonzero(n) for _, n in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in out], pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array([n[i] for i, (_, n) in zip(at, out)], pa.list_(pa.int32()))],
                names=["lang", "at", "n"],
            )

    got = drawn(labelled, sample).mapInArrow(features, "lang string, at array<int>, n array<int>").toArrow()
    langs = np.array(got["lang"].to_pylist(), dtype=object)
    if not len(langs):
        return Model(np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), [], np.zeros(0))
    x = np.zeros((len(langs), DIMENSIONS), np.float32)
    for i, (at, n) in enumerate(zip(got["at"].to_pylist(), got["n"].to_pylist())):
        x[i, at] = n
    order = np.array(sorted(range(len(x)), key=lambda i: (langs[i], x[i].tobytes())))  # the same model whatever order rows came in
    x, langs = x[order], langs[order]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x = np.log1p(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centroids, names, radius = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        c, cluster = clusters(own, CENTROIDS)
        far = 1 - (own * c[cluster]).sum(axis=1)
        for j in range(len(c)):
            centroids.append(c[j])
            names.append(str(lang))
            radius.append(RADIUS * float(np.quantile(far[cluster == j], FAR)) if (cluster == j).any() else 0.0)
    return Model(idf, np.array(centroids), names, np.array(radius))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and accepted, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS * DIMENSIONS numbers a language

    def make():
        m = shared.value
        return lambda texts: [list(x) for x in zip(*[m.predict(t) for t in texts])]

    return map_texts(docs, "text", [field("lang_pred", "string"), field("score", "double"), field("accepted", "boolean")], make)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predictions(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document; held-out rows are not learned from."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), sample)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
