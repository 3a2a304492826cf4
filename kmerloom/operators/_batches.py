"""K-mers of Arrow batches of reads, as numbers in numpy vectors, a block at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The code of characters other than A, C, T, G.
OTHER = 4
#: K-mers looked at together.
BLOCK = 1 << 20
#: As many of them have all their numbers in a core's own cache.
CACHED = 1 << 15

DIGIT = np.full(256, OTHER, np.uint8)
for _c, _d in zip("ACTGactg", (0, 1, 2, 3) * 2, strict=True):
    DIGIT[ord(_c)] = _d
#: Every other character.
NO_BASE = bytes(np.flatnonzero(DIGIT == OTHER).astype(np.uint8))


def joined(seqs: pa.Array, clean: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(digits, first): the digits of all sequences, one OTHER between two, and where each begins. clean: of what `dna.clean` leaves of them."""
    texts = [t or b"" for t in seqs.cast(pa.binary()).to_pylist()]
    if clean:
        texts = [t.translate(None, NO_BASE) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    return DIGIT[np.frombuffer(b"-".join(texts), np.uint8)], first


def rolling(d: np.ndarray, width: int, backward: bool = False, kind=np.uint64) -> np.ndarray:
    """Numbers of every `width` neighbouring digits (up to 32, half as many as the kind has bits), the first most significant, or least if backward; by doubling."""

    def join(a, size, b, more):
        n = len(d) - size - more + 1
        a, b = a[:n], b[size : size + n]
        return a | b << kind(2 * size) if backward else a << kind(2 * more) | b

    out, have, power, size = None, 0, d.astype(kind), 1
    while size <= width:
        if width & size:
            out, have = (power, size) if out is None else (join(power, size, out, have), size + have)
        if 2 * size <= width:
            power = join(power, size, power, size)
        size *= 2
    return out


def canonical_words(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """64-bit words (as `hashing.pack` gives them, least significant first) of the canonical k-mer at each place."""
    n = len(codes) - k + 1
    up = codes & 3
    ahead, back = [], []
    for i, end in enumerate(range(k, 0, -32)):
        width = min(32, end)
        ahead.append(rolling(up, width)[end - width : end - width + n])
        back.append(rolling(up ^ 2, width, True)[32 * i : 32 * i + n])
    if len(ahead) == 1:
        return [np.minimum(ahead[0], back[0])]
    less, tie = np.zeros(n, bool), np.ones(n, bool)
    for a, b in zip(reversed(ahead), reversed(back), strict=True):
        less |= tie & (a < b)
        tie &= a == b
    return [np.where(less, a, b) for a, b in zip(ahead, back, strict=True)]


def kmers(seqs: pa.Array, k: int, block: int = BLOCK, clean: bool = False):
    """(rows, words, digits, whole), some k-mers at a time: the row and canonical words of every k-mer of A, C, G, T.

    digits are those of the block, whole says at which of its places a k-mer is.
    clean: other characters are left out, and end no run.
    """
    codes, first = joined(seqs, clean)
    last = len(codes) - k + 1
    for at in range(0, last, block):
        d = codes[at : at + block + k - 1]
        n = len(d) - k + 1
        wrong = np.concatenate([[0], np.cumsum(d == OTHER, dtype=np.int32)])
        whole = wrong[k:] == wrong[:-k]
        low, high = np.searchsorted(first, at, side="right") - 1, np.searchsorted(first, at + n)
        edges = np.concatenate([[at], first[low + 1 : high], [at + n]])
        rows = np.repeat(np.arange(low, high), np.diff(edges))[whole]
        if len(rows):
            yield rows, [w[whole] for w in canonical_words(d, k)], d, whole


def gathered(parts, least: int = BLOCK):
    """The same numbers in fewer arrays, of as many numbers at least but for the last."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def tally(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often) of numbers below a bound."""
    if bound <= 4 * len(keys):
        n = np.bincount(keys, minlength=1)
        found = np.flatnonzero(n)
        return found, n[found]
    return np.unique(keys, return_counts=True)
