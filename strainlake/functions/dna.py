"""Sequence functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base order, run-length code offsets and the longest run of one code.
BASES = "ACGT"
RLE_OFFSET = {"A": 97, "C": 65, "T": 78, "G": 110, "N": 33}
RLE_RUN = 13


def clean(seq: Column) -> Column:
    """Upper case, everything but A, C, G and T removed."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> tuple[Column, Column]:
    """The smaller of a sequence and its reverse complement, and whether that is the latter."""
    rc = reverse_complement(seq)
    return F.least(seq, rc), rc < seq


def base_id(base: Column) -> Column:
    """0 to 3 for A, C, G, T."""
    return F.instr(F.lit(BASES), base) - 1


def ids(seq: Column) -> Column:
    """Array of base ids of a cleaned sequence."""
    return F.transform(F.filter(F.split(seq, ""), lambda b: b != ""), lambda b: F.instr(F.lit(BASES), b) - 1)


def byte_ids(data: Column) -> Column:
    """Four two-bit ids for each byte, the high bits first; data: array of byte values."""
    return F.flatten(F.transform(data, lambda b: F.array(*[F.shiftright(b, k).bitwiseAND(F.lit(3)) for k in (6, 4, 2, 0)])))


def ids_to_bytes(symbols: Column) -> Column:
    """Inverse of byte_ids; null unless there are four ids for each byte."""
    n = F.size(symbols)
    group = lambda i: F.aggregate(F.slice(symbols, i * 4 + 1, F.lit(4)), F.lit(0), lambda a, x: a * 4 + x.cast("int"))
    packed = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest((n / 4).cast("int") - 1, F.lit(0))), group))
    return F.when(n % 4 == 0, packed)


def runs(seq: Column) -> Column:
    """Runs of one of A, C, G, T and N in the upper-cased text; other symbols end a run and are dropped."""
    return F.regexp_extract_all(F.upper(seq), F.lit("(A+|C+|G+|T+|N+)"), F.lit(1))


#: Characters that stand for bases and for codes while texts are rewritten: a private area, which no base or code is in.
_PRIVATE = 0xE000


def _codes() -> list[tuple[str, int, str]]:
    """(base, length, code) of all codes, longest runs first."""
    return [(b, n, chr(RLE_OFFSET[b] + n - 1)) for n in range(RLE_RUN, 0, -1) for b in RLE_OFFSET]


def run_length(seq: Column) -> Column:
    """Run-length text: a run of k of one base is one letter for each 13, and one for the rest.

    One pass over the text for each of the 65 codes; other symbols than A, C, G, T and N end a run and are dropped.
    """
    stand = {b: chr(_PRIVATE + k) for k, b in enumerate(RLE_OFFSET)}
    gap = chr(_PRIVATE + len(stand))
    out = F.translate(F.regexp_replace(F.upper(seq), "[^ACGTN]+", gap), "".join(stand), "".join(stand.values()))
    for base, n, code in _codes():
        out = F.replace(out, F.lit(stand[base] * n), F.lit(code))
    return F.replace(out, F.lit(gap), F.lit(""))


def run_length_decoded(text: Column) -> Column:
    """The bases of a run-length text; what is no code is dropped."""
    codes = _codes()
    stand = [chr(_PRIVATE + k) for k in range(len(codes))]
    known = "".join(c for _, _, c in codes)
    out = F.translate(F.regexp_replace(text, "[^" + "".join(f"\\x{ord(c):02x}" for c in known) + "]+", ""), known, "".join(stand))
    for (base, n, _), s in zip(codes, stand):
        out = F.replace(out, F.lit(s), F.lit(base * n))
    return out


def phred(quality: Column) -> Column:
    """Magnitude of a quality character, above 0 up to 1."""
    return (F.ascii(quality) - 32) / F.lit(94.0)


def phase_cos(base: Column, other: Column) -> Column:
    """Cosine of the angle between two bases a quarter turn apart in the order A, C, G, T: 1, 0 or -1."""
    apart = F.abs(base - other)
    return F.when(apart == 0, 1).when(apart == 2, -1).otherwise(0)


def one_hot(seq: Column, length: int = 2500) -> Column:
    """Four 0/1 columns for each position, cut or padded to length; anything but A, C, G, T in either case is all zeros.

    A character is one position: upper would make two of some (ß), and move those after it past the cut.
    """
    letters = F.split(F.translate(F.substr(seq, F.lit(1), F.lit(length)), "acgt", "ACGT"), "")
    row = lambda c: F.array(*[F.coalesce(c == b, F.lit(False)).cast("float") for b in BASES])
    # split once: the letters are an element of an array that a function reads
    made = F.transform(F.array(letters), lambda x: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: row(F.get(x, i))))
    return F.when(seq.isNotNull(), F.get(made, 0))


def walsh_hadamard(values: Column, size: int) -> Column:
    """Walsh-Hadamard transform of an array whose size is a power of two: log2(size) rounds of sums and differences."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def joined(h: int):
        return lambda v: F.transform(v, lambda x, i: F.when(i.bitwiseAND(F.lit(h)) == 0, x + F.get(v, i + h)).otherwise(F.get(v, i - h) - x))

    out, h = F.transform(values, lambda x: x.cast("double")), 1
    while h < size:  # each round reads the one before through an array of one element, so that it is computed once
        out = F.get(F.transform(F.array(out), joined(h)), 0)
        h *= 2
    return out
