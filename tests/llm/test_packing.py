import zlib

import numpy as np
import pytest

from kmerloom.llm import packing

from . import helpers as H

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = ["", " ", "a", " a", "a ", "two  spaces", "three   spaces", "tab\there", "line\n\nend\n", "x \n y", " lead", "don't they'll I'M", "naïve café 123 4567 !!! ###%%%", "字 漢字   wide \xa0nbsp", "<|endoftext|> inside <|endoftext|>", "🙂🙂 emoji", "\r\n windows \r\n", "end   ", "\x1c odd \x85 controls"]


def test_ids_equal_the_tokenizer(tokenizer):
    e = packing.PieceEncoder(PATH, memo=5)
    assert e.ranked is not None
    for texts in (TEXTS, [H.prose(500, 1), *TEXTS], TEXTS):
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert e.encode(texts) == want


def test_pieces_cover_every_text_once(spark, tokenizer):
    rows = [(i, H.prose(n, i)) for i, n in enumerate([1, 5, 300, 900, 3000, 40, 41, 42] * 6)] + H.ODD
    got = packing.pack(H.documents(spark, rows, extra=True).repartition(3), PATH).collect()
    ids_of = {}
    for i, t in rows:
        ids_of.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, pieces in by_doc.items():
        assert sum(r["length"] for r in pieces) == sum(map(len, ids_of[i]))
        for r in pieces:
            fits = [x for x in ids_of[i] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
            assert fits
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0


def slow_level(counts, size, window):
    """The level whose choice gives the least sum of squares, by trying all."""
    best = None
    for h in range(window - size + 1):
        if h and not counts[h]:
            continue
        c = counts.copy()
        if h:
            c[h] -= 1
        if h + size < window:
            c[h + size] += 1
        total = int((c[1:] ** 2).sum())
        if best is None or total < best[0] or (total == best[0] and h > best[1]):
            best = (total, h)
    return best[1]


def test_levels_are_those_of_least_squares():
    p = packing.Packer(0, window=16)
    r = np.random.default_rng(2)
    for k in range(300):
        n = int(r.integers(1, 16))
        assert p._level(n) == slow_level(p.counts[:17], n, 16)
        p.add(k, b"\1\0\0\0" * n)
        assert p.n_open == p.counts.sum() == sum(map(len, p.open))


def test_open_windows_are_bounded():
    p = packing.Packer(0, window=64, max_open=5)
    for k in range(400):
        p.add(k, b"\1\0\0\0" * (1 + k * 37 % 63))
        assert p.n_open <= 5
    p.flush()
    assert sum(r[2] for r in p.rows) == sum(1 + k * 37 % 63 for k in range(400))


def test_empty_table(spark):
    assert packing.pack(H.documents(spark, []), PATH).count() == 0
