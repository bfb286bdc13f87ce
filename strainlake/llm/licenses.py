"""License notices, exact and with a bounded number of edits.

Each notice of k allowed edits is cut into k + 1 seeds, one of which must stand unchanged in any text within k
edits of it (pigeonhole).  One automaton finds all seeds; around each the regex library's bounded-error
matching looks for the notice and reports its span and edits.  Exact places of the base phrases are found on the
words themselves.

Defined cases: null text counts as empty: no words, no places, empty labels, score 0.  Repeated rows are kept; an
input column named as an output column makes way.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.llm._common import field, map_texts

# Phrases that always count, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that are searched with edits, with their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license": "apache",
    "apache software license": "apache",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this program is free software you can redistribute it and or modify it": "gpl",
}
#: One edit is allowed for so many characters of a notice.
CHARACTERS_PER_EDIT = 10
#: Bytes that are no word characters become blanks, A-Z become a-z.
TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
SPAN = "array<struct<label:string,first:int,last:int,edits:int>>"


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, per_edit: int = CHARACTERS_PER_EDIT):
        self.base = [(f" {p} ".encode(), p.count(" ") + 1, label) for p, label in base.items()]
        self.notices, self.seeds = [], ahocorasick.Automaton()
        starts: dict[str, list[tuple[int, int]]] = {}
        for n, (text, label) in enumerate(notices.items()):
            k = len(text) // per_edit
            self.notices.append((regex.compile(rf"(?b)(?<= )(?:{regex.escape(text)}){{e<={k}}}(?= )"), len(text), k, label))
            for j in range(k + 1):
                a, b = j * len(text) // (k + 1), (j + 1) * len(text) // (k + 1)
                starts.setdefault(text[a:b], []).append((n, a))
        for seed, found in starts.items():
            self.seeds.add_word(seed, (len(seed), found))
        self.seeds.make_automaton()

    def scan(self, text: str | None) -> dict:
        words = [] if text is None else text.encode("utf-8", "replace").translate(TABLE).split()
        line = b" " + b" ".join(words) + b" "
        places, blanks = [], None
        for phrase, n, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                if blanks is None:  # places of all blanks; a word begins behind each but the last
                    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                first = int(np.searchsorted(blanks, at))
                places.append((first, first + n - 1, label))
                at = line.find(phrase, at + 1)
        return {"n_words": len(words), "places": places, "fuzzy": self._fuzzy(line.decode()) if words else []}

    def _fuzzy(self, line: str) -> list[tuple[str, int, int, int, float]]:
        """label, first and last word, edits, likeness of each span within its notice's edits."""
        spans: dict[tuple[int, int], tuple[int, int]] = {}
        tried: dict[int, int] = {}
        for end, (length, found) in self.seeds.iter(line):
            for n, offset in found:
                pattern, size, k, _ = self.notices[n]
                begin = end - length + 1 - offset
                if begin < tried.get(n, -1):  # inside the last window that held the notice
                    continue
                if m := pattern.search(line, max(0, begin - k - 1), min(len(line), begin + size + k + 1)):
                    spans[n, m.start()] = (m.end(), sum(m.fuzzy_counts))
                    tried[n] = m.end() - k
        if not spans:
            return []
        out, blanks = [], np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        for (n, a), (b, edits) in sorted(spans.items()):
            first, last = (int(x) - 1 for x in np.searchsorted(blanks, (a, b)))
            out.append((self.notices[n][3], first, last, edits, 1 - edits / self.notices[n][1]))
        return out


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """docs with n_words, base_spans and fuzzy_spans (words from 0) and score (likeness of the best span)."""

    def make():
        s = Scanner(base, notices)

        def run(texts: list) -> list[list]:
            found = [s.scan(t) for t in texts]
            return [
                [x["n_words"] for x in found],
                [[{"label": p[2], "first": p[0], "last": p[1], "edits": 0} for p in x["places"]] for x in found],
                [[{"label": f[0], "first": f[1], "last": f[2], "edits": f[3]} for f in x["fuzzy"]] for x in found],
                [1.0 if x["places"] else max((f[4] for f in x["fuzzy"]), default=0.0) for x in found],
            ]

        return run

    return map_texts(docs, "text", [field("n_words", "long"), field("base_spans", SPAN), field("fuzzy_spans", SPAN), field("score", "double")], make)


def labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    firsts = F.col("base_spans.first").cast("array<bigint>")
    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size("base_spans").cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        joined(F.col("base_spans.label")).alias("base_labels"),
        joined(F.concat("base_spans.label", "fuzzy_spans.label")).alias("labels"),
        "score",
    )
