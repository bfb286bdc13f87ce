"""Personal data: patterns, and the terms beside them that give them away.

Protected entities (e-mail and IP addresses, card and phone numbers) are found by patterns.  Over the whole corpus, terms
of the texts that hold an entity are counted with it, wherever they stand outside of entities; the information a term has on
it, log(p(e, t) / (p(e) p(t))), against all there is to know, log(1 / p(e)), says how far the term discloses it.  Terms beyond
THRESHOLD, seen with the entity in at least SUPPORT different texts, become spans of kind ``term`` at every occurrence in every
document that holds them.  Redaction removes entities and generalises terms.

Patterns are linear in the text: possessive forms that start only where a match can start.  SQL functions only.

Defined cases: null text counts as empty and stays null when redacted; texts without entities and disclosing terms are left alone; equal
texts get equal spans; repeated rows are kept; input columns named as an output column make way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainlake.llm._common import Scratch, is_small, lasting, settled, small
from strainlake.llm.arrays import bound, cut, running, sums_before

KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD, SUPPORT = 0.9, 2
TERM = r"\p{L}[\p{L}\p{N}]{2,60}+"
# What the four patterns match, in forms that do not go back: an address starts where its characters start, or where
# the match before it ended; a number starts where no digit, or digit and separator, stands before it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){13})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPAN = "struct<kind:int,start:bigint,end:bigint,value:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.regexp_replace(p, r"^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        d = _digits(x)
        return F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def located(text: Column, pattern: str, kind: Column) -> Column:
    """The matches of a pattern as SPAN structs, in code points."""

    def measured(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        return F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).cast("bigint").alias("skip"), F.length(hit).cast("bigint").alias("length"), hit.alias("value")))

    def placed(parts: Column) -> Column:
        span = lambda p, at: F.struct(kind.cast("int").alias("kind"), (at + p["skip"]).alias("start"), (at + p["skip"] + p["length"]).alias("end"), p["value"].alias("value"))
        return F.zip_with(parts, sums_before(F.transform(parts, lambda p: p["skip"] + p["length"])), span)

    found = lambda hits: F.when(F.size(hits) > 0, bound(measured(hits), placed)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def entities(text: Column) -> Column:
    """The spans of all protected entities, by kind, then start."""
    found = []
    for k, kind in enumerate(KINDS[:4]):
        spans = F.filter(located(text, PATTERNS[kind], F.lit(k)), _checked(kind))
        found.append(F.when(F.contains(text, F.lit(SIGN[kind])), spans).otherwise(F.array().cast(f"array<{SPAN}>")) if SIGN[kind] else spans)
    return F.coalesce(F.concat(*found), F.array().cast(f"array<{SPAN}>"))


def _barred() -> Column:
    """0, and not deterministic for the optimizer: else filters on computed columns would compute them twice."""
    return F.least(F.monotonically_increasing_id(), F.lit(0).cast("long"))


def _key() -> Column:
    return F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))


def with_entities(docs: DataFrame) -> DataFrame:
    """docs with base (the spans of entities), more (those found once these are blanked out), key (of the text), plain (the text
    with all of them blanked out; null where there are none).

    A match that fails its check, such as a phone number with a card number behind it, hides what it covers; it shows
    in the second search.
    """
    docs = docs.withColumn("base", entities(F.col("text")))
    blanked = F.when(F.size("base") > 0, _blanked(F.col("base")))
    # the bar lies above both, so that filters on them stay above as well
    same = F.slice("base", (_barred() + 1).cast("int"), F.greatest(F.size("base"), F.lit(1)))
    docs = docs.withColumn("once", blanked).withColumn("more", entities(F.col("once"))).withColumns({"base": same, "key": _key()})
    return docs.withColumn("plain", F.when(F.size("more") > 0, _blanked(F.concat("base", "more"))).otherwise(F.col("once"))).drop("once")


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def replaced(spans: Column, by) -> Column:
    """The column text with what each span covers beyond those before it replaced; spans: as _ordered gives them, one at least."""

    def shown(ss: Column) -> Column:
        reach = running(F.transform(ss, lambda s: s["end"]), F.greatest, F.lit(0).cast("bigint"))
        own = F.zip_with(ss, reach, lambda s, at: F.struct(at.alias("gap"), F.greatest(s["start"], at).alias("start"), F.greatest(s["end"], at).alias("end"), s["kind"].alias("kind")))
        return bound(own, joined)

    def joined(ps: Column) -> Column:
        gaps = cut(F.col("text"), F.transform(ps, lambda p: F.struct(p["gap"].alias("start"), p["start"].alias("end"))))
        marked = F.zip_with(ps, gaps, lambda p, gap: F.concat(gap, F.when(p["end"] > p["start"], by(p)).otherwise(F.lit(""))))
        tail = F.substr("text", (F.array_max(F.transform(ps, lambda p: p["end"])) + 1).cast("int"), F.length("text"))
        return F.array_join(F.concat(marked, F.array(tail)), "")

    return bound(spans, shown)


def _blanked(spans: Column) -> Column:
    """The text with as many # for the characters of each span."""
    return replaced(_ordered(spans), lambda s: F.repeat(F.lit("#"), (s["end"] - s["start"]).cast("int")))


def _plain() -> Column:
    return F.coalesce("plain", "text", F.lit(""))


def _terms(text: Column) -> Column:
    """The different terms of a text whose entities are blanked out."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(searched: DataFrame, scratch: Scratch) -> DataFrame:
    """term, disclosure (the largest), entity (the first of those with it) of the terms that disclose an entity.

    searched: text and what with_entities adds, saved.  As with_both <= with_entity, disclosure at THRESHOLD bounds with_term
    from above by with_entity; pairs beyond it are left out before they are counted, so that common terms meet no entity.
    Entities that stand in the same texts are one class, and so are terms of the same texts and number: classes meet, so a
    text with many of both, and others like it, make few pairs.
    """
    n = searched.where(F.size("base") > 0).count()  # about eight entities and a hundred terms a text
    hits = scratch.save(searched.where(F.size("base") > 0).groupBy("key").agg(F.count("*").alias("n_docs"), F.first("plain").alias("plain"), F.first(F.concat("base", "more")).alias("spans")), n)
    entity = F.transform("spans", lambda b: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), b["kind"] + 1), F.lit(":"), F.lower(b["value"])))
    held = scratch.save(hits.select("key", "n_docs", F.explode(F.array_distinct(entity)).alias("entity")), 8 * n)
    texts = [F.count("*").alias("texts"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum")]
    known = held.groupBy("entity").agg(F.sum("n_docs").alias("with_entity"), *texts).where(F.col("texts") >= SUPPORT)
    total = float(searched.count())
    most = F.col("with_entity") * F.pow(F.lit(total + 1) / F.col("with_entity"), F.lit(1 - THRESHOLD)) * 1.000001  # rounding loses none
    known = scratch.save(known.select("entity", "with_entity", most.alias("most"), F.xxhash64("texts", "sum", "with_entity").alias("of_entity")), 8 * n)
    first = known.groupBy("of_entity").agg(F.min("entity").alias("entity"))
    held = scratch.save(held.join(small(known.select("entity", "with_entity", "most", "of_entity")), "entity").select("key", "n_docs", "with_entity", "most", "of_entity").distinct(), 8 * n)
    tops = scratch.save(held.groupBy("key").agg(F.max("most").alias("top")), n)
    own = scratch.save(hits.join(small(tops), "key").select("key", "top", F.explode(_terms(F.col("plain"))).alias("term")), 100 * n)
    wanted = scratch.save(own.groupBy("term").agg(*texts).where(F.col("texts") >= SUPPORT), 100 * n)
    # counted where the texts are, before anything is sent; other terms are passed over if these can be broadcast
    everywhere = searched.select(F.explode(_terms(_plain())).alias("term"))
    names = wanted.select("term")
    everywhere = (everywhere.join(F.broadcast(names), "term", "left_semi") if is_small(names) else everywhere).groupBy("term").agg(F.count("*").alias("with_term"))
    counted = scratch.save(wanted.join(everywhere, "term").select("term", "with_term", F.xxhash64("texts", "sum", "with_term").alias("of_term")), 100 * n)
    rare = own.join(small(counted), "term").where("with_term <= top").select("key", "of_term", "with_term").distinct()
    pairs = rare.join(held, "key").where("with_term <= most")
    j = pairs.groupBy("of_entity", "of_term", "with_entity", "with_term").agg(F.count("*").alias("texts"), F.sum("n_docs").alias("both")).where(F.col("texts") >= SUPPORT)
    knows = F.log2(F.lit(total) * F.col("both") / (F.col("with_entity") * F.col("with_term"))) / F.log2(F.lit(total + 1) / F.col("with_entity"))
    told = j.withColumn("disclosure", knows).where(F.col("disclosure") >= THRESHOLD).join(first, "of_entity")
    best = scratch.save(told.groupBy("of_term").agg(F.max("disclosure").alias("disclosure"), F.min_by("entity", F.struct(-F.col("disclosure"), "entity")).alias("entity")), 100 * n)
    return counted.join(small(best), "of_term").select("term", "disclosure", "entity")


def terms_of(searched: DataFrame) -> DataFrame:
    """key, terms (their spans) of every text that holds disclosing terms; searched: text and what with_entities adds, saved.

    Terms meet their places where the texts are; what is sent is the spans that disclose, once for each text and task.  Texts that
    hold no such term are passed over first, where those that do are few enough for their keys to be broadcast.
    """
    with Scratch(searched.sparkSession) as scratch:
        n = searched.count()
        told = scratch.save(disclosing(searched, scratch).select("term"), n)
        holds = scratch.save(searched.select("key", F.explode(_terms(_plain())).alias("term")).join(small(told), "term", "left_semi").select("key").distinct(), n)
        texts = searched.join(F.broadcast(holds), "key", "left_semi") if is_small(holds) else searched
        placed = texts.select("key", F.explode(located(_plain(), TERM, F.lit(4))).alias("s")).select("key", "s.start", "s.end", F.lower("s.value").alias("term"))
        span = F.struct(F.lit(4).alias("kind"), "start", "end", F.col("term").alias("value"))
        return settled(placed.join(small(told), "term", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set(span)).alias("terms")), n)


def _with_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.join(small(spans), "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast(f"array<{SPAN}>")))


def find(docs: DataFrame) -> DataFrame:
    """docs with base, more and terms: SPAN arrays of the entities, those hidden by others, and the terms that disclose them."""
    new = ("base", "more", "terms")
    done = _found(docs)
    return done.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new], *new)


def _found(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), text, base, more, terms of every document; its texts are searched for entities once."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    searched = lasting(docs.sparkSession).save(with_entities(rows).drop("text")).withColumn("text", F.col("row.text"))
    return _with_terms(searched.drop("plain"), terms_of(searched))


def _written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans of every document; its texts are searched for entities once."""
    with Scratch(docs.sparkSession) as scratch:
        searched = scratch.save(with_entities(docs.select("doc_id", "text")))
        done = _with_terms(searched.select("doc_id", "key", "base", "more"), terms_of(searched))
        counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
        return settled(done.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "more", "terms"))).alias("spans")))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with entities removed and disclosing terms generalised, as [EMAIL], [IP], [CARD], [PHONE], [TERM]."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = _found(docs).withColumn("spans", _ordered(F.concat("base", "more", "terms")))
    redacted = replaced(F.col("spans"), lambda s: F.element_at(marks, s["kind"] + 1))
    text = F.when(F.size("spans") > 0, redacted).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
