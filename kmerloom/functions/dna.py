"""Column functions on nucleotide sequences and k-mers.

Sequences are ordered A < C < T < G. They are held as digit strings, A0 C1 T2
G3, whose order as text is that order, whatever their length; `letters` gives
them back. A digit string as binary is cut in constant time, so that reads of
any length explode into k-mers at a cost in proportion to their length.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_K, MAX_K = 8, 127
MIN_M, MAX_M = 4, 15


def check_k(k: int) -> int:
    if not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be from {MIN_K} to {MAX_K}, not {k}")
    return k


def check_m(m: int, k: int) -> int:
    if not MIN_M <= m <= min(MAX_M, k):
        raise ValueError(f"minimizer size must be from {MIN_M} to {min(MAX_M, k)}, not {m}")
    return m


def digits(seq: Column) -> Column:
    """A, C, T, G as 0, 1, 2, 3; other characters stay."""
    return F.translate(seq, "ACTG", "0123")


def letters(d: Column) -> Column:
    return F.translate(d.cast("string"), "0123", "ACTG")


def reverse_complement_digits(d: Column) -> Column:
    return F.translate(F.reverse(d), "0123", "2301")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical_digits(d: Column) -> Column:
    return F.least(d, reverse_complement_digits(d))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement, by A < C < T < G."""
    return letters(canonical_digits(digits(kmer)))


def code(d: Column) -> Column:
    """A digit string of up to 31 digits as a number, first base most significant."""
    return F.conv(d.cast("string"), 4, 10).cast("bigint")


def code_digits(number: Column, k: int) -> Column:
    """The digit string of a number, k up to 31: four bases at a time out of a table."""
    pieces = []
    for end in range(k, 0, -4):
        width = min(4, end)
        table = ",".join("".join(x) for x in product("0123", repeat=width))
        pieces.append(F.get(F.split(F.lit(table), ","), F.shiftrightunsigned(number, 2 * (k - end)).bitwiseAND(F.lit(4**width - 1)).cast("int")))
    return F.concat(*reversed(pieces))


def decode(number: Column, k: int) -> Column:
    return letters(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"))


def clean(text: Column) -> Column:
    """The A, C, G, T of a text in upper case, all else left out: letters whose upper case is two, of which one is a base, too."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


def segments(seq: Column) -> Column:
    """The runs of A, C, G, T of a sequence; k-mers never cross other characters."""
    return F.split(F.upper(seq), "[^ACGT]+")


def kmer_positions(d: Column, k: int) -> Column:
    """0, 1, ... for every k-mer of a digit string (null if there is none)."""
    return F.when(F.length(d) >= k, F.sequence(F.lit(0), F.length(d) - k))


def kmer_at(forward: Column, backward: Column, position: Column, k: int) -> Column:
    """Canonical k-mer at a position of a read; forward and backward are the binary digits of both strands."""
    n = F.length(forward)
    return F.least(F.substring(forward, position + 1, F.lit(k)), F.substring(backward, n - position - k + 1, F.lit(k)))


def mmers(d: Column, k: int, m: int) -> list[Column]:
    """All canonical m-mers of a k-mer, one column each (generated code, no lambda)."""
    rc = reverse_complement_digits(d)
    return [F.least(F.substring(d, j + 1, m), F.substring(rc, k - j - m + 1, m)) for j in range(k - m + 1)]


def valid_minimizer(mmer: Column) -> Column:
    """Whether AA occurs nowhere behind the first base."""
    return F.instr(F.substring(mmer, 2, 64), "00") == 0


def minimizer(d: Column, k: int, m: int) -> Column:
    """The least valid canonical m-mer of a k-mer, as digits; all G where none is valid."""
    options = [F.when(valid_minimizer(x), x).otherwise("3" * m) for x in mmers(d, k, m)]
    return F.least(*options) if len(options) > 1 else options[0]


def strand_codes(d: Column) -> Column:
    """A generator of one row: a k-mer (k up to 31) and its reverse complement as numbers.

    Behind a generator the numbers are columns of their own; as plain
    expressions they would be evaluated again for every m-mer.
    """
    return F.explode_outer(F.array(F.struct(code(d).alias("forward"), code(reverse_complement_digits(d)).alias("backward"))))


def minimizer_of_codes(forward: Column, backward: Column, k: int, m: int) -> Column:
    """The minimizer as a number, by shifts of both strands' numbers."""
    whole = (1 << 2 * m) - 1
    pairs = sum(1 << 2 * p for p in range(m - 2))  # one bit for each two neighbouring bases behind the first
    options = []
    for j in range(k - m + 1):
        x = F.least(F.shiftright(forward, 2 * (k - m - j)).bitwiseAND(F.lit(whole)), F.shiftright(backward, 2 * j).bitwiseAND(F.lit(whole)))
        other = x.bitwiseOR(F.shiftright(x, 1))  # even bits: bases other than A
        options.append(F.when(other.bitwiseOR(F.shiftright(other, 2)).bitwiseAND(F.lit(pairs)) == pairs, x).otherwise(F.lit(whole)).cast("bigint"))
    return F.least(*options) if len(options) > 1 else options[0]
