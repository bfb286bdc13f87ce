"""Whole results of the operators against plain versions, hot groups, one large text or conversation, and clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from strainlake.llm import _common, arrays, bpe, chat, editprint, langid, licenses, mixing, neardup, pii, quality, queries
from tests.llm.test_llm import DIR, PATTERNS, SCHEMA, WORD_BPE, sha, valid

HOSTILE_NAMES = ("row", "key", "plain", "once", "base", "more", "terms", "spans", "n_words", "kept", "n_symbols", "rejected_by", "size", "source_size", "target", "repeats", "part", "order", "copy", "of", "whole", "c", "d", "h", "__lang", "__x")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", ["op3_neardup", "op5_mixing", "op10_chat"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = queries.queries()[name](spark, DIR)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(plain, df.select(*names).collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)


def test_base_counts_equal_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    want = con.execute(r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w)
      SELECT doc_id, len(w), length(array_to_string(w, '')), len(regexp_extract_all(text, '[#*$%&|<>]')), len(l) - len(list_distinct(l)) FROM w JOIN l USING (doc_id)""").fetchall()
    got = quality.verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# One row's arrays and texts


def test_running_and_cut(spark):
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 5000):
        text = "".join(rng.choice("aé😀 ") for _ in range(3 * n + 5))
        at = sorted(rng.randint(0, len(text)) for _ in range(2 * n))
        spans = list(zip(at[::2], at[1::2]))
        values = [rng.randint(0, 9) for _ in range(n)]
        df = spark.createDataFrame([(values, text, spans)], "v array<bigint>, t string, s array<struct<start:bigint,end:bigint>>")
        r = df.select(arrays.sums_before(F.col("v")).alias("sums"), arrays.cut(F.col("t"), F.col("s")).alias("cut")).first()
        assert r.sums == [sum(values[:k]) for k in range(n)] and r.cut == [text[a:b] for a, b in spans]


def seconds(f):
    began = time.time()
    out = f()
    return out, time.time() - began


def test_many_addresses_in_one_text(spark):
    def report(n):
        text = "é " + " ".join(f"mail person{k}.x{k % 7}@mail{k % 13}.example.com or name{k}" for k in range(n))
        df = table(spark, [(1, text, None, None, 0), (2, text + " again", None, None, 0), (3, "x", None, None, 0)])
        return text, pii.report(df).orderBy("doc_id").first()

    report(10)
    _, few = seconds(lambda: report(10_000))
    (text, r), many = seconds(lambda: report(20_000))
    assert r.n_email == 20_000 and many < 3 * few + 5
    base = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERNS["email"], text))
    assert r.base_sha256 == sha(base)


def test_many_turns_in_one_conversation(spark):
    def digest(n):
        turns = [(1, k, ("user", "assistant")[k % 3 % 2], f"text {k} <| \\ é") for k in range(n)]
        return turns, chat.digests(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()

    digest(10)
    _, few = seconds(lambda: digest(25_000))
    (turns, r), many = seconds(lambda: digest(50_000))
    loss = "".join(t for _, _, role, t in turns if role == "assistant")
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (50_000, len(loss), sha(loss)) and many < 3 * few + 5


def test_many_notices_in_one_text():
    s = licenses.Scanner()
    few, many = (seconds(lambda n=n: s.scan("é MIT license and creative comons attribution, " * n))[1] for n in (25_000, 50_000))
    assert many < 3 * few + 5


# Licenses


def exhaustive(text):
    """n_words, base places, labels and score by trying every place."""
    line = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).strip()
    words = line.split(" ") if line else []
    places, found, best = [], set(), 0.0
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    for notice, label in licenses.NOTICES.items():
        edits = len(notice) // licenses.CHARACTERS_PER_EDIT
        for m in regex.finditer(rf"(?b)(?<= )(?:{regex.escape(notice)}){{e<={edits}}}(?= )", f" {line} ", overlapped=True):
            found.add(label)
            best = max(best, 1 - sum(m.fuzzy_counts) / len(notice))
    firsts, base = [k for k, _ in places], {x for _, x in places}
    return len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best


def test_licenses_equal_exhaustive_search(spark, docs):
    rng, hard = random.Random(5), []
    for notice in licenses.NOTICES:
        for _ in range(4):
            chars = list(notice)
            for _ in range(rng.randint(0, len(notice) // 8)):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([[], [rng.choice("abcx ")], [chars[k], rng.choice("abcx")]])
            hard.append(f"Some é words, {''.join(chars).upper()}; and others")
    hard += ["cc by cc by", "CC-BY", "apache licenseapache license", None, "", "gnu general public license " * 3]
    df = docs.unionByName(table(spark, [(10_000 + k, x, None, None, 0) for k, x in enumerate(hard)]))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in licenses.labels(df).collect():
        want = exhaustive(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6] and abs(r.score - want[6]) < 1e-9


# Languages


def plain_languages(rows):
    """lang_pred and score of every row by plain loops over dictionaries of trigrams, for few enough texts that all are learned from."""
    def features(text):
        b = b" " + bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b" "
        out = Counter()
        for i in range(len(b) - 2):
            code = b[i] << 16 | b[i + 1] << 8 | b[i + 2]
            if code != 0x202020:
                out[(code * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        v = np.zeros(langid.DIMENSIONS)
        for k, n in out.items():
            v[k] = n
        return v

    usable = lambda t: t is not None and regex.search(r"\p{L}", t) is not None
    learned = {(r.lang, r.text) for r in rows if r.lang is not None and usable(r.text) and __import__("zlib").crc32(str(r.doc_id).encode()) % 5}
    labelled = sorted(((lang, features(t).astype(np.float32)) for lang, t in learned), key=lambda x: (x[0], x[1].tobytes()))
    x = np.array([v for _, v in labelled])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    unit = lambda v: v / (np.sqrt((v * v).sum()) or 1.0)
    x = np.array([unit(np.log1p(v) * idf) for v in x])
    centroids = []
    for lang in sorted({name for name, _ in labelled}):
        own = np.array([v for v, (name, _) in zip(x, labelled) if name == lang])
        c = [own[0]]
        while len(c) < min(langid.CENTROIDS, len(own)):
            c.append(own[int(np.argmin([max(float(v @ u) for u in c) for v in own]))])
        for _ in range(langid.ROUNDS):
            near = [int(np.argmax([float(v @ u) for u in c])) for v in own]
            c = [unit(sum(v for v, k in zip(own, near) if k == j)) if j in near else c[j] for j in range(len(c))]
        centroids += [(lang, u) for u in c]
    out = {}
    for r in rows:
        if not usable(r.text):
            out[r.doc_id] = ("und", 0.0)
            continue
        v = unit(np.log1p(features(r.text)) * idf)
        score, lang = max(((float(v @ u), name) for name, u in centroids), key=lambda s: s[0])
        out[r.doc_id] = (lang, min(1.0, max(0.0, score)))
    return out


def test_languages_equal_plain_version(docs, rows):
    want = plain_languages(rows)
    for r in langid.predictions(docs).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-5


def test_sample_is_bounded(spark):
    many = [(None if k % 3 == 0 else k, f"text number {k % 9000}", f"l{k % 5000}", None, 0) for k in range(10_000)]
    copies = [(None, "one text", "en", None, 0)] * 20_000
    few = langid.drawn(table(spark, many + copies), 3000).collect()
    assert len(few) <= 3000 and max(Counter(r.lang for r in few).values()) == 1
    two = langid.drawn(table(spark, [(k, f"text {k}", "en", None, 0) for k in range(9000)] + copies + [(1, f"x{k}", "fr", None, 0) for k in range(5)]), 3000).collect()
    assert Counter(r.lang for r in two) == {"en": 1500, "fr": 5} and len({r.text for r in two}) == 1505
    assert sorted(map(tuple, two)) == sorted(map(tuple, langid.drawn(table(spark, copies + [(1, f"x{k}", "fr", None, 0) for k in range(5)] + [(k, f"text {k}", "en", None, 0) for k in range(9000)]), 3000).collect()))


# Quality


def test_verdicts_equal_plain_version(spark):
    rng = random.Random(11)
    word = lambda n=6: "".join(rng.choices("abcdefgh", k=rng.randint(2, n)))
    texts = []
    for k in range(180):  # as many as a sketch holds exactly
        w = [word() for _ in range(rng.randint(15, 60))]
        if k % 9 == 0:
            w += ["#" * rng.randint(1, 60)]
        if k % 11 == 0:
            w = w[:10] * 4 + w
        if k % 13 == 0:
            w = ["longlonglong" * 2] * 2 + [word(30) for _ in w]
        sep = "\n" if k % 5 == 0 else " "
        texts.append((k, sep.join(w + (w[:3] if k % 7 == 0 else [])), "en" if k < 130 else "fr", "ab"[k % 2] if k < 130 else "c", 0))
    df = table(spark, texts + [(900, None, None, None, 0)])
    counted = {r.doc_id: r for r in quality.measured(df).drop("text").collect()}
    ratio = lambda r, a, b: r[a] / max(1, r[b])
    failed = {d: r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words for d, r in counted.items()}
    measures = {**quality.UPPER, **quality.LOWER}

    def fences(rows):
        out = {}
        for m, (a, b, least) in measures.items():
            v = sorted(ratio(r, a, b) for r in rows)
            low, high = (v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.75))
            spread = max(high - low, least)
            out[m] = high + quality.FENCE * spread if m in quality.UPPER else low - quality.FENCE * spread
        return out

    good = [r for d, r in counted.items() if not failed[d]]
    groups, langs = defaultdict(list), defaultdict(list)
    for r in good:
        groups[r.lang, r.source].append(r)
        langs[r.lang].append(r)
    whole = fences(good)
    for r in quality.verdicts(df).collect():
        c = counted[r.doc_id]
        levels = [fences(x) for x in (groups[c.lang, c.source], langs[c.lang]) if len(x) >= quality.TRUSTED] or [whole]
        bad = any(ratio(c, *quality.UPPER[m][:2]) > min(x[m] for x in levels) for m in quality.UPPER) or any(ratio(c, *quality.LOWER[m][:2]) < max(x[m] for x in levels) for m in quality.LOWER)
        assert (r.base_failed, r.kept) == (failed[r.doc_id], not failed[r.doc_id] and not bad)
    assert sum(failed.values()) > 10 and {r.kept for r in quality.verdicts(df).where("not base_failed").collect()} == {True, False}


# Mixing


def test_mixing_takes_copies(spark):
    rows_ = [(1, "ten words in this text one two three four five", None, s, 0) for s in ("a", "b") for _ in range(100)]
    rows_ += [(k, f"w{k} " * (k % 9), None, "c", 0) for k in range(100)] + [(None, "a b c", None, None, 0)] * 30 + [(None, None, None, "c", 0)] * 3
    df = table(spark, rows_)
    got = mixing.taken(df)
    assert got.count() == len(rows_) and all(r.taken <= 3 * r.size for r in got.collect())
    mixed = mixing.mix(df)
    per = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats") + F.col("part")).alias("taken"), F.max("target").alias("target")).collect()
    assert len(per) == 4 and all(abs(r.taken - r.target) <= 1 for r in per)
    out = mixing.mixture(df)
    assert out.columns == df.columns and out.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r.taken for r in per)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.taken(df.repartition(3)).collect()), key=str)


# Personal data


def plain_terms(texts):
    """The terms that disclose an entity, by counting every pair."""
    found = {}
    for t in set(texts):
        spans = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        plain = "".join("#" if any(a <= i < b for a, b, _ in spans) else c for i, c in enumerate(t or ""))
        found[t] = ({f"{k}:{t[a:b].lower()}" for a, b, k in spans}, {x.lower() for x in regex.findall(r"\p{L}[\p{L}\p{N}]{2,60}+", plain)})
    copies, total = Counter(texts), len(texts)
    entity, term, pair, n_texts = Counter(), Counter(), Counter(), Counter()
    for t, (es, ts) in found.items():
        for x in ts:
            term[x] += copies[t]
        for e in es:
            entity[e] += copies[t]
            for x in ts:
                pair[e, x] += copies[t]
                n_texts[e, x] += 1
    knows = lambda e, x: math.log2(total * pair[e, x] / (entity[e] * term[x])) / math.log2((total + 1) / entity[e])
    return {x for (e, x), n in n_texts.items() if n >= pii.SUPPORT and knows(e, x) >= pii.THRESHOLD}


def test_terms_and_counts_equal_plain_version(spark, docs):
    more = [f"Wilhelmina {w} text{k}, by wilhelmina.k@mail.example.com" for k, w in enumerate(("wrote", "wrote", "signs", "wrote"))]
    more += [f"call Ottokar at +49 30 123456{k % 2} or +49 30 1234560 today{k}" for k in range(4)] + ["ottokar and WILHELMINA here", "ottokar, wilhelmina", None, ""]
    df = docs.unionByName(table(spark, [(10_000 + k, x, None, None, 0) for k, x in enumerate(more * 2)]))
    texts = {r.doc_id: r.text for r in df.collect()}
    told = plain_terms(list(texts.values()))
    assert {"wrote", "call"} <= told
    for r in pii.report(df).collect():
        t = texts[r.doc_id] or ""
        base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in PATTERNS)
        got = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:")]
        if not any(s.startswith(k) and tuple(s.split(":")) not in {(k, str(a), str(b)) for k, a, b in base} for s in r.spans.split(",") for k in PATTERNS):
            plain = "".join("#" if any(a <= i < b for _, a, b in base) else c for i, c in enumerate(t))
            assert got == [m.span() for m in regex.finditer(r"\p{L}[\p{L}\p{N}]{2,60}+", plain) if m[0].lower() in told]


# Fingerprints


def test_likeness_equals_plain_version(docs, rows):
    ordered = sorted(rows, key=lambda r: r.doc_id)[:40]
    prints = editprint.Walker()
    some = docs.where(F.col("doc_id") <= ordered[-1].doc_id)
    got = {r.doc_id: r for r in editprint.compared(some).collect()}
    share = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    for k, r in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)].text
        own = prints.fingerprint(r.text)
        assert got[r.doc_id].near_next == share(own, prints.fingerprint(following)) and got[r.doc_id].near_edited == share(own, prints.fingerprint(editprint.edited(r.text, following)))


def test_rows_without_id_come_first(spark):
    rows_ = [(None if k < 200 else k, f"text {k} " * (k % 7 + 1), None, None, 0) for k in range(250)]
    df = table(spark, rows_)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    w, want = editprint.Walker(), Counter()
    for k, r in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        own = w.fingerprint(r[1])
        want[r[0], own.hex(), sha(editprint.edited(r[1], following)), editprint.likeness(own, w.fingerprint(following))] += 1
    got = Counter((r.doc_id, r.fingerprint, r.edited_sha256, r.near_next) for r in editprint.compared(df).collect())
    assert got == want


def test_groups_have_nearly_all_alike_pairs(spark):
    rng, texts = random.Random(9), {}
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    for k in range(120):
        base = prose(rng.randint(60, 250))
        texts[3 * k] = texts[3 * k + 1] = base
        a = rng.randrange(len(base))
        texts[3 * k + 2] = base[:a] + prose(60)[: int(len(base) * rng.uniform(0.02, 0.22))] + base[a + int(len(base) * rng.uniform(0.02, 0.22)) :]
    w = editprint.Walker(1)
    walks = {d: w.output(t) for d, t in texts.items()}
    alike = {(a, b) for a in texts for b in texts if a < b and editprint.agreement(walks[a], walks[b]) >= editprint.LEAST}
    own = {d: d for d in texts}
    for _ in range(3):
        for a, b in alike:
            own[a] = own[b] = min(own[a], own[b])
    got = {r.doc_id: r.group_id for r in editprint.compared(table(spark, [(d, t, None, None, 0) for d, t in texts.items()])).collect()}
    assert all(own[d] == own[g] for d, g in got.items()) and all(got[3 * k] == got[3 * k + 1] for k in range(120))
    different = [(a, b) for a, b in alike if texts[a] != texts[b]]
    assert len(different) > 60 and sum(got[a] == got[b] for a, b in different) >= 0.9 * len(different)


@pytest.mark.parametrize("group", [128, 7])
def test_texts_of_one_bucket_all_meet(spark, monkeypatch, group):
    """All fingerprints are equal, so that every bucket has all texts: no few hubs can stand for them."""
    monkeypatch.setattr(editprint, "GROUP", group)
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    texts = [x for k in range(40) for x in (lambda t: [t, t + prose(3), t + prose(5)][: 1 + k % 3])(prose(120))]
    for _ in range(20):  # a chain, each like the next one, and a group that is larger than a block
        texts.append(prose(120) if not _ else texts[-1][: len(texts[-1]) * 9 // 10] + prose(20)[: 1 + len(texts[-1]) // 10])
    base = prose(150)
    texts += [f"{base} {prose(2)}" for _ in range(30)]
    docs = table(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)])
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    ids = {r.h: r.doc_id for r in hashed.collect()}
    w = editprint.Walker(1)
    walks = [w.output(t) for t in texts]
    own = list(range(len(texts)))
    alike = {(a, b) for b in own for a in range(b) if editprint.agreement(walks[a], walks[b]) >= editprint.LEAST}
    for _ in own:
        for a, b in alike:
            own[a] = own[b] = min(own[a], own[b])
    with _common.Scratch(spark) as scratch:
        prints = scratch.save(hashed.select("h", F.lit("07" * editprint.SAMPLES).alias("fingerprint")))
        links, roots = (x.collect() for x in editprint.near_links(prints, docs, scratch))
    assert all((min(x), max(x)) in alike for x in ((ids[r.a], ids[r.b]) for r in links))
    got = {h: h for h in ids} | {r.c: r.root for r in roots}
    assert {frozenset(ids[h] for h in got if got[h] == root) for root in got.values()} == {frozenset(k for k in range(len(own)) if own[k] == x) for x in own}


# Hot groups


def test_spread_equals_join(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    with _common.Scratch(spark) as scratch:
        left = scratch.save(hot)
        right = scratch.save(left.groupBy("k").count().withColumn("v", F.col("k") * 10))
        got = scratch.save(neardup.spread(left.unionByName(left.limit(5).withColumn("k", F.lit(-1).cast("long"))), right, "k", "count", 20_000, "left"))
        assert got.count() == 20_005 and got.where("v <> k * 10").count() == 0 and got.where("v is null").count() == 5
        assert neardup.spread(left, right, "k", "count", 20_000).count() == 20_000


def test_many_copies_and_a_hub(spark):
    words_ = [f"b{k}" for k in range(100)]
    rng, rows_ = random.Random(3), []
    for k in range(3000):
        rows_.append((k, " ".join(words_), None, None, 0))
    for k in range(1500):  # each unlike most others of them, all like the copies
        w = words_[:]
        for _ in range(2):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows_.append((3000 + k, " ".join(w), None, None, 0))
    got = neardup.near_duplicates(table(spark, rows_), 3, 85, 120, 5)
    assert got.where("component_id <> 0").count() == 0 and got.where("kept").count() == 1 and got.count() == 4500


def test_long_word_in_every_document(spark):
    t = bpe.tokenizer(WORD_BPE)
    rule, very = "-" * 90, "=" * 5000
    rows_ = [(k, f"{rule} some w{k} {very if k % 3 == 0 else ''} text{k}", None, None, 0) for k in range(600)] + [(None, f"{rule} {very}", None, None, 0)] * 50
    for args in ({}, {"frequent": 2, "sample": 20}):
        got = bpe.digests(table(spark, rows_), WORD_BPE, **args).collect()
        want = Counter()
        for d, x, *_ in rows_:
            ids = t.encode(x, add_special_tokens=False).ids
            want[d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))] += 1
        assert Counter(map(tuple, got)) == want


# Stages and plumbing


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns(spark, docs, stage):
    import corpus_pipeline

    clash = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in HOSTILE_NAMES])
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, clash, DIR)
    assert out.columns == clash.columns
    got = out.collect()
    assert got and all(r[c] == f"{c} {r.doc_id}" for r in got for c in HOSTILE_NAMES)
    plain = f(spark, docs, DIR).select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(map(tuple, plain))
    assert f(spark, clash.limit(0), DIR).count() == 0


def test_own_folder_only_where_local():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session)


def test_tables_are_removed(spark, docs):
    root = spark._jvm.org.apache.hadoop.fs.Path(_common.shared_dir(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(files.listStatus(root))
    with _common.passing():
        kept = quality.kept_documents(docs)
        assert kept.count() > 0 and len(files.listStatus(root)) > before
    assert len(files.listStatus(root)) == before
    with pytest.raises(ValueError), _common.Scratch(spark) as scratch:
        scratch.save(spark.range(3))
        raise ValueError
    assert len(files.listStatus(root)) == before
