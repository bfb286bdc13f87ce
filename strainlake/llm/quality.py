"""Quality rules whose thresholds follow the data: quantile sketches per language and source.

Counts of each document feed a mergeable KLL sketch for each (language, source) and measure.  A document is rejected by a
measure that lies beyond the outer fence of its group (third quartile + FENCE * interquartile range, or the mirror image below).
The range counts as a small spread at least, so that a group of uniform documents rejects none of them for being a little
different; beside that no cutoff is fixed.  A fence that lies outside that of the language, merged from its groups, makes way
for it, so that a group full of junk cannot loosen its own.  Groups of fewer than TRUSTED documents borrow the sketch of their
language, and small languages that of all documents.  Sketches are built where the rows are; one for each group is merged.

Defined cases: null text has no words and fails the base rules; a null language or source is a group like any other;
repeated rows get the same verdict; input columns named as an output column make way.  SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainlake.llm._common import Scratch, lasting, settled

FENCE, TRUSTED, SKETCH_K = 3.0, 100, 200
WINDOW = 8
#: Measure: its numerator and denominator, and the least interquartile range that counts.
UPPER = {
    "symbols": ("n_symbols", "word_chars", 0.02),
    "same_lines": ("n_dup_lines", "n_lines", 0.12),
    "same_neighbours": ("n_adjacent", "n_words", 0.02),
    "same_windows": ("n_repeat_words", "n_words", 0.08),
    "long_words": ("word_chars", "n_words", 0.5),
}
LOWER = {"short_words": ("word_chars", "n_words", 0.5)}
#: (Language, source) groups up to which their thresholds are broadcast.
BROADCAST_GROUPS = 50_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts of MEASURES, n_lines and n_adjacent (words equal to the one before), all long."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumns(
        {
            "__words": F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
            "__lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    d = d.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__h": F.transform("__words", lambda w: F.xxhash64(w)),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    ).drop("__words", "__lines")
    window = F.transform(
        F.slice("__h", 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get("__h", i + k) for k in range(1, WINDOW)]),
    )
    d = d.withColumns({"__w": F.when(F.size("__h") > WINDOW, window).otherwise(F.array().cast("array<bigint>")), "n_adjacent": F.size(F.filter("__h", lambda x, i: _same(x, F.get("__h", i - 1)))).cast("long")}).drop("__h")
    places = F.array_sort(F.transform("__w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), places)).drop("__w")
    again = F.filter("__s", lambda e, i: _same(e["w"], F.get("__s", i - 1)["w"]) | _same(e["w"], F.get("__s", i + 1)["w"]))
    d = d.withColumn("__s", F.array_sort(F.transform(again, lambda e: e["i"])))
    # a repeated window adds the words up to the next one's start, 8 at most
    covered = F.aggregate(
        F.transform("__s", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__s", i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    # 0, and not deterministic for the optimizer: else it would push a filter on these columns below the arrays and compute them
    # anew for each of their elements
    barrier = F.least(F.monotonically_increasing_id(), F.lit(0).cast("long"))
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")) + barrier).drop("__s")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(top: str, under: str) -> Column:
    return F.col(top) / F.greatest(F.col(under), F.lit(1))


def _measures() -> dict[str, tuple[str, str, float]]:
    return {**UPPER, **LOWER}


def thresholds(counted: DataFrame) -> DataFrame:
    """lang, source and one threshold for each measure, of every (lang, source) of the counted documents."""
    names = _measures()
    good = counted.where(~base_failed()).select("lang", "source", *[_ratio(a, b).alias(m) for m, (a, b, _) in names.items()])
    sketched = good.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in names])
    merge = [F.kll_merge_agg_double(m).alias(m) for m in names]
    by_lang = sketched.groupBy("lang").agg(F.sum("n").alias("n"), *merge)
    every = sketched.groupBy().agg(F.sum("n").alias("n"), *merge).where("n > 0")

    def fences(df: DataFrame, *keys: str) -> DataFrame:
        def fence(m: str) -> Column:
            low, high = F.kll_sketch_get_quantile_double(m, F.lit(0.25)), F.kll_sketch_get_quantile_double(m, F.lit(0.75))
            spread = F.greatest(high - low, F.lit(names[m][2]))
            return high + FENCE * spread if m in UPPER else low - FENCE * spread

        return df.select(*keys, *[fence(m).alias(m) for m in names])

    groups = counted.select("lang", "source").distinct().alias("k")
    own = fences(sketched.where(F.col("n") >= TRUSTED), "lang", "source").alias("g")
    lang = fences(by_lang.where(F.col("n") >= TRUSTED), "lang").alias("l")
    whole = fences(every).alias("e")
    j = groups.join(own, F.expr("k.lang <=> g.lang and k.source <=> g.source"), "left").join(lang, F.expr("k.lang <=> l.lang"), "left")
    j = j.join(F.broadcast(whole), F.lit(True), "left")  # one row

    def threshold(m: str) -> Column:
        # nulls do not count; where not one document passes the base rules there is no threshold and nothing to judge
        pick = F.least if m in UPPER else F.greatest
        return F.when(F.coalesce(f"g.{m}", f"l.{m}").isNotNull(), pick(f"g.{m}", f"l.{m}")).otherwise(F.col(f"e.{m}"))

    return j.select(F.col("k.lang").alias("__lang"), F.col("k.source").alias("__source"), *[threshold(m).alias(f"__{m}") for m in names])


def judged(docs: DataFrame) -> DataFrame:
    """docs with the counts, base_failed, kept and rejected_by (the measures that reject it)."""
    new = (*MEASURES, "base_failed", "kept", "rejected_by")
    done = _judged(docs)
    return done.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new], *new)


def _judged(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), the counts, base_failed, kept and rejected_by; texts are measured once and their rows saved."""
    counted = measured(docs.select(F.struct("*").alias("row"), "text", "lang", "source")).drop("text")
    counted = lasting(docs.sparkSession).save(counted)
    return _verdict(counted, settled(thresholds(counted)))


def _verdict(counted: DataFrame, table: DataFrame) -> DataFrame:
    few = table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    d = counted.join(F.broadcast(table) if few else table, F.expr("lang <=> __lang and source <=> __source"), "left")
    beyond = [F.when(_ratio(a, b) > F.col(f"__{m}"), m) for m, (a, b, _) in UPPER.items()] + [F.when(_ratio(a, b) < F.col(f"__{m}"), m) for m, (a, b, _) in LOWER.items()]
    d = d.withColumns({"base_failed": base_failed(), "rejected_by": F.array_compact(F.array(*beyond))})
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(*table.columns)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document; its texts are read once."""
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.save(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"))
        return settled(_verdict(counts, thresholds(counts)).select("doc_id", *MEASURES, "base_failed", "kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with the columns of docs."""
    return _judged(docs).where("kept").select("row.*")
