"""Token counts by prefix dynamic programming.

For every prefix of a piece of text exactly one vocabulary token can end its encoding: the token whose
predecessor, the last token of the remaining prefix, is left alone next to it by the merges.  Filling that in
from left to right stores the exact count of every prefix of the piece; pieces (the tokenizer's own split) add
up.  Truncation to a budget and the count of any prefix then need no further encoding.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are kept; an input column named as
an output column makes way.  Workers remember at most 2 * REMEMBERED pieces.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlake.llm._common import field, map_texts
from strainlake.llm.bpe import UNSETTLED, byte_letters, settled_class, specials, tokenizer

#: Pieces (and pairs) in each of the two generations that a worker keeps; what is asked for again moves to the younger.
REMEMBERED = 500_000
#: Longest piece, in bytes, whose prefix counts are remembered.
SHORT = 64
#: Pieces of which a part, left alone, is split otherwise.
CUT_OTHERWISE = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def settled_pieces() -> re.Pattern:
    """The pattern by which the tokenizer splits text, for texts of settled characters."""
    letter, digit, blank = (settled_class(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class PrefixCounter:
    """Prefix counts of the byte-level BPE in a tokenizers file."""

    def __init__(self, path: str):
        self.lib, self.own, self.letters = tokenizer(path), specials(path), byte_letters()
        self.back = {c: b for b, c in enumerate(self.letters)}
        self.model = self.lib.model
        self.tokens = set(self.lib.get_vocab(with_added_tokens=False))
        self.longest = max(map(len, self.tokens))
        self.cut_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.own, key=len, reverse=True))) + ")")
        self.mark = next(iter(self.own))[:2]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.find = settled_pieces().findall

    def _stays(self, last: str, token: str) -> bool:
        """Whether the merges leave the two tokens alone next to each other ('' before the first)."""
        got = self.pairs.get((last, token))
        if got is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            whole = [t.value for t in self.model.tokenize(last + token)]
            got = self.pairs[last, token] = whole == ([last, token] if last else [token])
        return got

    def prefix_counts(self, piece: str) -> bytes | list[int]:
        """Token counts of the piece's prefixes of 0, 1, 2 ... bytes."""
        got = self.pieces.get(piece)
        if got is not None:
            return got
        got = self.older.get(piece)
        if got is None:
            got = self._fill_in("".join(map(self.letters.__getitem__, piece.encode("utf-8", "surrogatepass"))))
        if len(got) <= SHORT:
            if len(self.pieces) >= REMEMBERED:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = got = bytes(got)
        return got

    def _fill_in(self, word: str) -> list[int]:
        last, counts, known, tokens = [""], [0], self.pairs.get, self.tokens
        for end in range(1, len(word) + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = word[start:end]
                if token in tokens and ((stays := known((last[start], token))) or stays is None and self._stays(last[start], token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError("a byte has no token")
        return counts

    def split(self, text: str | None) -> list[str]:
        """The pieces of a text, in order; a special token's string is one."""
        if not text:
            return []
        if self.mark not in text:
            return self._plain(text)
        return [w for part in self.cut_at.split(text) for w in ([part] if part in self.own else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if not UNSETTLED.search(text):
            return self.find(text)
        return [bytes(self.back[c] for c in w).decode() for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def total(self, piece: str) -> int:
        return 1 if piece in self.own else self.prefix_counts(piece)[-1]

    def count(self, text: str | None) -> int:
        get, own, n = self.pieces.get, self.own, 0
        for p in self.split(text):
            got = get(p)
            if got is None:
                if p in own:
                    n += 1
                    continue
                got = self.prefix_counts(p)
                get = self.pieces.get
            n += got[-1]
        return n

    def boundaries(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ends of the pieces in code points, and the token counts up to there."""
        ends, counts, at, n = [], [], 0, 0
        for p in self.split(text):
            at, n = at + len(p), n + self.total(p)
            ends.append(at)
            counts.append(n)
        return ends, counts

    def at(self, text: str, ends: list[int], counts: list[int], cut: int) -> int:
        """Tokens of text[:cut], from the stored counts; only the last two pieces can split otherwise there."""
        if cut <= 0 or not ends:
            return 0
        k = bisect_left(ends, min(cut, ends[-1]))
        first = max(0, k - 1)
        begin = ends[first - 1] if first else 0
        return (counts[first - 1] if first else 0) + self.count(text[begin:cut])

    def every(self, text: str | None) -> list[int]:
        """Token counts of the text's prefixes of 0, 1, 2 ... code points, each as if the text ended there."""
        out, (ends, counts), pieces = [0], self.boundaries(text), self.split(text)
        blank = lambda p: p not in self.own and not UNSETTLED.search(p) and p.isspace()
        k = 0
        while k < len(pieces):
            p, begin, n = pieces[k], ends[k - 1] if k else 0, counts[k - 1] if k else 0
            if len(out) <= begin and blank(p):  # an end of the text makes a run of blanks one piece
                j = k
                while j < len(pieces) and blank(pieces[j]):
                    j += 1
                run = "".join(pieces[k:j]) + (" " if j < len(pieces) and pieces[j][0] == " " and pieces[j] not in self.own else "")
                out += self._within(run, n)
                k = j
                continue
            if p in self.own or p in CUT_OTHERWISE or UNSETTLED.search(p):
                out += [self.at(text, ends, counts, c) for c in range(len(out), ends[k] + 1)]
            else:
                out += self._within(p, n)[len(out) - begin - 1 :]
            k += 1
        return out

    def _within(self, piece: str, before: int) -> list[int]:
        """Counts at the code points 1, 2 ... of a piece with so many tokens before it."""
        counts, at, out = self.prefix_counts(piece), 0, []
        for c in piece:
            at += 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
            out.append(before + counts[at])
        return out

    def cut(self, text: str, ends: list[int], counts: list[int], budget: int) -> int:
        """Largest number of code points whose prefix has at most budget tokens; longer prefixes can have fewer."""
        return max((c for c, n in enumerate(self.every(text)) if n <= budget), default=0)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_bytes and n_tokens of the whole text."""

    def make():
        c = PrefixCounter(path)
        return lambda texts: [[c.count(t) for t in texts]]

    return map_texts(docs, "text", [field("n_tokens", "long")], make).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """docs with prefix_counts: the tokens of the text's prefixes of 0, 1, 2 ... code points."""

    def make():
        c = PrefixCounter(path)
        return lambda texts: [[array("i", c.every(t)) for t in texts]]

    return map_texts(docs, "text", [field("prefix_counts", "array<int>")], make)


def truncate(table: DataFrame, budget: int) -> DataFrame:
    """A prefix table with cut: code points of the largest prefix within budget, from the stored counts alone."""
    fits = F.array_max(F.transform("prefix_counts", lambda n, i: F.when(n <= budget, i)))
    return table.withColumn("cut", F.coalesce(fits, F.lit(0)))


def limits(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return count_tokens(docs.select("doc_id", "text"), path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
