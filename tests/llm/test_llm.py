"""The ten operators against plain versions, and their defined cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strainlake.llm import bpe, chat, editprint, fastsketch, langid, licenses, mixing, neardup, pii, quality, tokencount

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 0), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, "one two", "fr", None, 7),
    (6, LONG, "en", "b", len(LONG)), (7, "a" * 50_000, "de", "b", 50_000), (None, "null id", "en", "a", 7), (8, "İstanbul ΑΣ <|endoftext|> don't ½ 😀  x", "xx", "c", 1), (9, "1 " * 20_000, "en", "c", 1),
]
OPS = {
    "bpe": lambda d: bpe.digests(d, WORD_BPE), "bpe_others": lambda d: bpe.digests(d, WORD_BPE, 3, 2), "langid": langid.predictions, "neardup": neardup.near_duplicates, "quality": quality.verdicts, "mixing": mixing.taken,
    "tokens": lambda d: tokencount.limits(d, BYTE_BPE), "editprint": editprint.compared, "licenses": licenses.labels, "pii": pii.report,
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.mark.parametrize("name", OPS)
def test_defined_cases(spark, odd, name):
    clash = odd.select("*", *[F.lit("own").alias(c) for c in ("ids", "n_tokens", "kept", "c", "key", "size", "score", "base", "terms", "n_words", "bands")])
    got = OPS[name](clash)
    assert got.count() == len(ODD) and sorted(map(str, got.collect())) == sorted(map(str, OPS[name](odd).collect()))
    empty = OPS[name](odd.limit(0))
    assert empty.columns == got.columns and empty.count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "<|turn\\<\\|"), (1, 2, "assistant", None), (1, 3, "assistant", "<|im_end|>é😀<"), (2, 0, None, None), (None, None, "x\ny\\n<|", "z"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, blocks int")
    want = defaultdict(list)
    for c, t, r, x in turns:
        want[c].append((t if t is not None else -1, r or "", x or ""))
    for g in chat.digests(df).collect():
        ts = sorted(want[g.conv_id])
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss))
    assert chat.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("frequent,sample", [(bpe.FREQUENT, bpe.SAMPLE), (200, 30)])
def test_bpe_equals_library(docs, odd, frequent, sample):
    t = bpe.tokenizer(WORD_BPE)
    both = docs.unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {r.doc_id: r for r in bpe.digests(both, WORD_BPE, frequent, sample).collect()}
    for r in both.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False)))


def test_splits_equal_library():
    c, words = tokencount.PrefixCounter(BYTE_BPE), bpe.split_words(WORD_BPE)
    t = bpe.tokenizer(WORD_BPE)
    for k in [*range(0x3000), *range(0xA700, 0xA800), *range(0xFF00, 0x10000), *range(0x1F100, 0x1F200)]:
        x = f"a{chr(k)} b1{chr(k)}'s {chr(k)}  {chr(k)}"
        assert ["".join(c.letters[b] for b in w.encode()) for w in c.split(x)] == [w for w, _ in c.lib.pre_tokenizer.pre_tokenize_str(x)]
        assert ["".join(c.letters[b] for b in w.encode()) for w in words(x)] == [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(x))]


def test_prefix_counts(rows):
    c, lib, rng = tokencount.PrefixCounter(BYTE_BPE), bpe.tokenizer(BYTE_BPE), random.Random(1)
    count = lambda x: len(lib.encode(x, add_special_tokens=False).ids)
    for text in [r.text[:500] for r in rows[:20]] + ["I don't   know'll <|endoftext|>  ok \n\n  a <|endof é́'s 12ab ＡΣ   "]:
        ends, counts = c.boundaries(text)
        for cut in [rng.randint(0, len(text)) for _ in range(30)]:
            assert c.at(text, ends, counts, cut) == count(text[:cut])
        assert count(text[: c.cut(text, ends, counts, 40)]) <= 40


def test_largest_prefixes(spark, rows):
    lib = bpe.tokenizer(BYTE_BPE)
    count = lambda x: len(lib.encode(x, add_special_tokens=False).ids)
    texts = [r.text[:300] for r in rows[:12]] + ["I'll they're  \n\n  a \t we've!!<|endoftext|>'s <|endof é́'s 12ab ＡΣ ½x   ", "語" * 300, "a" * 400, " " * 90 + "b \n c", "", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    for r in tokencount.truncate(tokencount.prefix_table(df, BYTE_BPE), 30).collect():
        want = [count((r.text or "")[:c]) for c in range(len(r.text or "") + 1)]
        assert list(r.prefix_counts) == want
        assert r.cut == max(c for c, n in enumerate(want) if n <= 30)


def test_token_counts(docs, rows):
    lib = bpe.tokenizer(BYTE_BPE)
    got = {r.doc_id: r for r in tokencount.limits(docs, BYTE_BPE).collect()}
    for r in rows:
        n = len(lib.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 1024)
    cut = tokencount.truncate(tokencount.prefix_table(docs, BYTE_BPE), 100)
    assert all(len(lib.encode(r.text[: r.cut], add_special_tokens=False).ids) <= 100 for r in cut.collect())


def test_language_held_out(docs, rows):
    truth = {r.doc_id: r.lang for r in rows}
    got = [r for r in langid.predictions(docs).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got)


def brute_components(rows, width, percent):
    sets, own = {}, {}
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        sets[r.doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        own[r.doc_id] = r.doc_id

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                own[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, width, percent):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    more = []
    for k in range(90):  # one large group: copies of one text with edits of their own, of the group's few kinds
        w = base[:]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(150)] = rng.choice("xyz")
        more.append((10_000 + k, " ".join(w + ["end"] * rng.randint(0, 3)), None, None, 0))
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = brute_components(df.collect(), width, percent)
    got = neardup.near_duplicates(df, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    left = neardup.deduplicated(df, width, percent)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()}) and left.columns == df.columns


def test_one_id_on_unlike_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    df = spark.createDataFrame([(3, a, None, None, 0), (7, a, None, None, 0), (7, b, None, None, 0), (9, b, None, None, 0)], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in neardup.deduplicated(df).collect()) == [(3, a), (7, b)]


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        x = fastsketch.sketch(a, 128)
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        b = a.copy()
        b[: n // 4] = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == fastsketch.sketch(b, 128)).mean() - j) < 0.2


def test_quality(docs, odd):
    both = docs.unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {r.doc_id: r for r in quality.verdicts(both).collect()}
    for r in both.collect():
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, hit = defaultdict(list), set()
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        for places in seen.values():
            if len(places) > 1:
                hit.update(k for i in places for k in range(i, i + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert g.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (g.kept and g.base_failed)
    assert sorted(r.doc_id for r in quality.kept_documents(both).collect()) == sorted(k for k, g in got.items() if g.kept)


def test_fences_tighten_and_hold(spark):
    rng = random.Random(7)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))  # 200 characters of words
    texts = [(prose(), "clean") for _ in range(300)] + [(prose()[:-17] + " " + "#" * 14, "clean")]  # 7% symbols
    texts += [(prose() if k % 10 < 7 else prose() + " " + "#" * 80, "hot") for k in range(200)]
    df = spark.createDataFrame([(k, x, "en", s, len(x)) for k, (x, s) in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.rejected_by for r in quality.judged(df).collect()}
    assert {k for k, why in got.items() if why} == {k for k, (x, _) in enumerate(texts) if "#" in x}
    assert all(got[k] == ["symbols"] for k, (x, s) in enumerate(texts) if "#" in x and s == "clean")


def test_mixing(docs):
    got = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(w[s] for s in w if s not in full)
        if not (new := {s for s in w if w[s] * level > 3 * size[s]} - full):
            break
        full |= new
    for s in w:
        assert abs(target[s] - min(3 * size[s], w[s] * level)) < 1e-6 and abs(taken[s] - target[s]) <= 1
    again = mixing.repeated(mixing.mix(docs))
    assert again.columns == docs.columns and again.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken.values())


def test_fingerprints(docs, rows):
    w = editprint.Walker()

    def plain(x):
        t, out = 0, []
        for c in x:
            k = w.kind_of(c)
            out += [w.symbol[k]] * w.lists[k][t & 63]
            t += w.lists[k][t & 63]
        return bytes(out[max(j for j in r if j < len(out))] for r in w.records)

    rows = sorted(rows, key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in editprint.compared(docs).collect()}
    for k, r in enumerate(rows):
        new = editprint.edited(r.text, rows[(k + 1) % len(rows)].text)
        g = got[r.doc_id]
        assert g.edited_sha256 == sha(new) and g.n_chars == len(r.text)
        if k < 30:
            assert g.fingerprint == plain(r.text).hex() and g.edited_fingerprint == plain(new).hex()
    assert sum(g.near_edited > g.near_next for g in got.values()) > 0.98 * len(got)
    pairs = editprint.near_pairs(docs).collect()
    assert all(p.likeness >= 0.8 and p.hub < p.doc_id for p in pairs)


def test_near_pairs_recall(spark):
    w, rng = editprint.Walker(), random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))
    base = prose(200)
    n = len(base)
    texts = {1000: base, 1001: base[: n * 9 // 10] + prose(40)[: n // 10]}
    for k in range(60):  # each replaces another quarter and more of the text: smaller ids that share bands and are not alike
        at = k * (n * 7 // 10) // 59
        texts[k] = base[:at] + prose(200)[: n * 3 // 10] + base[at + n * 3 // 10 :]
    prints = {d: w.fingerprint(x) for d, x in texts.items()}
    band = lambda d, b: prints[d][4 * b : 4 * b + 4]
    both = [b for b in range(16) if band(1000, b) == band(1001, b)]
    assert both and all(any(band(d, b) == band(1000, b) for d in range(60)) for b in both)  # no bucket of theirs has 1000 as its hub
    walks = {d: w.output(x) for d, x in texts.items()}
    ids = sorted(texts)
    alike = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if editprint.agreement(walks[a], walks[b]) >= 0.8}

    def groups(links):
        own = {d: d for d in ids}
        for _ in ids:
            for a, b in links:
                own[a] = own[b] = min(own[a], own[b])
        return own

    df = spark.createDataFrame([(d, x, None, None, 0) for d, x in texts.items()], SCHEMA)
    got = {(r.hub, r.doc_id) for r in editprint.near_pairs(df).collect()}
    assert (1000, 1001) in alike and got <= alike and groups(got) == groups(alike)


def test_licenses():
    s = licenses.Scanner()
    got = s.scan("The MIT-Licence, and the Apache  LICENSE; cc by cc by gnu general public license")
    assert [p[2] for p in got["places"]] == ["gpl", "apache", "cc-by", "cc-by"] and got["n_words"] == 15
    assert {(f[0], f[1], f[3]) for f in got["fuzzy"]} >= {("mit", 1, 1), ("apache", 5, 0)}
    assert s.scan("the apple and a mild silence of public life, mitigating licensed articles")["fuzzy"] == []
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    assert s.scan("é_x 1a--B c’d")["n_words"] == len(words("é_x 1a--B c’d"))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for k, n in enumerate(int(c) for c in reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_personal_data(spark, docs):
    hard = [
        "a@b.c@d.e a@b.c_x@d.e x..y@z-.com.au. @a.b a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3.0000000255 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111-1 4111--1111111111111 1 4111111111111111 12",
        "+1 (017) 555-7713 +49 30 1234567890 12345+1--2 ++1234567890 +4111111111111111 +1 23", "😀 é a.b%+-c@x.y 😀1.1.1.1😀 4111111111111111", "1 " * 9000, "a@" * 3000, "a" * 20_000, None, "",
    ]
    for k in range(6):  # a name that stands only where one address does, in different texts
        hard.append(f"text{k} number{k} by Wilhelmina of ours wilhelmina.k@mail.example.com and more{k}")
    df = docs.unionByName(spark.createDataFrame([(10_000 + k, x, None, None, 0) for k, x in enumerate(hard)], SCHEMA))
    got = {r.doc_id: r for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for r in df.collect():
        base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "") if valid(k, m[0])]
        g, written = got[r.doc_id], ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert g.base_sha256 == sha(written) and set(written.split(",")) <= set(g.spans.split(","))
        if not g.spans:
            assert clean[r.doc_id] == r.text
        for _, a, b in base:
            assert r.text[a:b] not in clean[r.doc_id] or r.doc_id >= 10_000
    assert "term:" in got[10_010].spans and "Wilhelmina" not in clean[10_010] and "[TERM]" in clean[10_010]


def test_disclosing_terms_anywhere(spark, docs):
    gap = " ".join(["the plain words between"] * 12)
    texts = [f"Wilhelmina wrote text{k}. {gap} by Wilhelmina wilhelmina.k@mail.example.com" for k in range(6)]
    texts += [f"Ottokarine signs number{k}. {gap} {gap} write to o.k@mail.example.com" for k in range(6)]  # never near it
    texts += ["A page on OTTOKARINE alone.", None]
    df = docs.unionByName(spark.createDataFrame([(10_000 + k, x, None, None, 0) for k, x in enumerate(texts)], SCHEMA))
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for k, x in enumerate(texts[:13]):
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"wilhelmina(?!\.k@)|wrote|ottokarine|signs|write", x.lower())]
        assert [s for s in got[10_000 + k].split(",") if s.startswith("term:")] == want and want
        assert not re.search("wilhelmina|ottokarine", clean[10_000 + k].lower())
    assert "the plain words between" in clean[10_000] and clean[10_013] is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in brute_components(docs.collect(), 5, 80).values()})
        docs = spark.createDataFrame(out.collect(), out.schema)
    t = bpe.tokenizer(WORD_BPE)
    want = Counter((r.doc_id, len(ids := t.encode(r.text, add_special_tokens=False).ids), sha(struct.pack(f"<{len(ids)}I", *ids))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DIR).collect()) == want
