"""Sum-of-squares online packing of documents into token windows.

Every task packs the documents of its own input partition: there is no
shuffle, and memory holds one Arrow batch and the open windows. A document
longer than a window fills whole windows first; its rest goes to the fill
level that makes the sum of squared counts of partly filled windows least
(ties: the fuller window), tracked in an array by level. At the end of a
partition, or when more than `max_open` windows are open, the open windows
are joined and cut into full ones, and what is left is cut at powers of two,
which need no padding. How many tokens that takes depends on the size of the
input's partitions: about a million tokens of each at most.

Defined results: a null or empty text is one token (the end id); a text longer
than windows fills several; a null doc_id stays null; repeated rows are packed
one by one; an empty table gives no rows; other columns are ignored. Sequence
ids are unique over the table, not consecutive.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

WINDOW = 1024
END_ID = 0
MAX_OPEN = 4096
#: Pieces of text of which a worker remembers the ids.
MEMO = 200_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NEAR_SPACES = re.compile(r"\s\s|^\s|\s$")


#: The pre-tokeniser pattern of byte-level vocabularies, and (below) their alphabet.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranked(tokenizer):
    """An encoder of the same ids by merge ranks, faster for short texts; None if the vocabulary's ids are not in merge order."""
    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if None in made or made != sorted(made):
        return None
    of, added = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(of[c] for c in t): k for t, k in vocab.items() if t not in added}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class PieceEncoder:
    """Ids of whole texts from ids of their space-separated pieces.

    The byte-level pre-tokeniser always starts a token at a single space
    between two other characters, so such pieces can be encoded apart and
    remembered; when there are too many, those that came again are kept. A text
    with a space amid other white space, or with a special token's string, is
    encoded whole.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.memo, self.known, self.again = Tokenizer.from_file(path), memo, {}, set()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = ranked(self.tokenizer)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self._ids(texts)
        encode = self.ranked.encode_ordinary
        return [array("I", encode(t)).tobytes() for t in texts]

    def _look_up(self, used: set[str]) -> None:
        """Ids of pieces behind a space; None for those that can't be encoded apart."""
        new = used.difference(self.known)
        met = used - new
        self.again |= met
        if len(self.known) + len(new) > self.memo:
            kept = self.again if len(self.again) < 0.7 * self.memo else met
            self.known, self.again = {p: self.known[p] for p in kept}, set()
        wrong = {p for p in new if not p.isalnum() and (not p or _NEAR_SPACES.search(p))}
        self.known.update(dict.fromkeys(wrong))
        new = list(new - wrong)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.known.update(zip(part, self._pieces([" " + p for p in part]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split(" ") for t in texts]
        used: set[str] = set()
        for p in split:
            used.update(p[1:])
        self._look_up(used)
        first = self._pieces([p[0] for p in split])
        known, out, whole = self.known.__getitem__, [], []
        for k, (t, p) in enumerate(zip(texts, split, strict=True)):
            parts = None if any(a in t for a in self.added) or (len(p) > 1 and not p[0]) or _NEAR_SPACES.search(p[0]) else list(map(known, p[1:]))
            if parts is None or None in parts:
                whole.append(k)
                out.append(b"")
            else:
                out.append(first[k] + b"".join(parts))
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


class Packer:
    """Places (doc_id, total, start, ids) pieces; `rows` gathers finished ones."""

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.next_id = window, max_open, first_sequence
        self.counts = np.zeros(window + 1, np.int64)  # partly filled windows by fill level
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        sequence, at = self.next_id, 0
        self.next_id += 1
        for doc, total, start, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, sequence, at))
            at += n

    def _level(self, size: int) -> int:
        """The fill level for a piece of `size`, 0 for a new window."""
        n, top = self.counts, self.window - size
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2  # from level h to h + size
        change[top] = 1 - 2 * n[top]  # a full window is no longer counted
        change[n[: top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        return top - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        total, full = len(ids) // 4, self.window * 4
        whole = len(ids) // full * full
        for at in range(0, whole, full):
            self._emit([(doc, total, at // 4, ids[at : at + full])])
        if whole == len(ids):
            return
        rest = ids[whole:]
        size = len(rest) // 4
        level = self._level(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((doc, total, whole // 4, rest))
        if level + size == self.window:
            self._emit(pieces)
            return
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.flush()

    def flush(self) -> None:
        """Join the open windows, fullest first, cut into full ones; cut the rest at powers of two."""
        left = [p for level in range(self.window, 0, -1) for pieces in self.open[level] for p in pieces]
        total = sum(len(p[3]) for p in left) // 4
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        stream, at = iter(left), None
        for size in sizes:
            pieces = []
            while size:
                doc, n, start, ids = at or next(stream)
                take = min(size, len(ids) // 4)
                pieces.append((doc, n, start, ids[: 4 * take]))
                at = (doc, n, start + take, ids[4 * take :]) if 4 * take < len(ids) else None
                size -= take
            self._emit(pieces)
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0


def encoder_of(path: str) -> PieceEncoder:
    """The worker's encoder. This module itself is sent with each task, so it is kept in one that lives as long as the worker."""
    held = sys.modules.setdefault("kmerloom_worker", ModuleType("kmerloom_worker")).__dict__
    if ("encoder", path) not in held:
        held["encoder", path] = PieceEncoder(path)
    return held["encoder", path]


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `window` tokens."""

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 40, window, max_open)
        encoder, end = encoder_of(tokenizer_path), np.array([end_id], "<u4").tobytes()

        def out():
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*packer.rows, strict=True)) or [[] for _ in names]
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for k in range(0, len(ids), 500):
                for doc, tokens in zip(ids[k : k + 500], encoder.encode(texts[k : k + 500].to_pylist()), strict=True):
                    packer.add(doc, tokens + end)
                if len(packer.rows) > 5000:
                    yield out()
        packer.flush()
        yield out()
        U.trim()

    return docs.select("doc_id", U.text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(U.table(spark, sf_dir, "documents").select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.json")))
