"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a pre-token that is a vocabulary entry as a whole is found by a minimal perfect hash (levels of bit sets in which every key finally
has a place of its own; the rank of its bit is its slot, and the entry in the slot is compared with the pre-token). Tier two: other pre-tokens
are merged from their bytes: a heap holds the ranks of neighbouring pairs, the bytes form a linked list, and the pair of lowest rank, the
leftmost of equals, is joined until none is in the vocabulary. Ranks of joined pairs come from the same hash.

Ids of pre-tokens that were met lately are remembered, about MEMO a worker. Ids are little-endian unsigned 32-bit numbers in a binary column.

Defined cases: null or empty text: no ids, and no bytes when decoded. Repeated rows get equal ids. Lone surrogates can't occur in a Spark
string. Special tokens are ordinary text. An id that is not in the vocabulary is an error when decoding.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, in_batches, portions

MEMO = 800_000  # pre-tokens whose ids a worker remembers
_MASK = (1 << 64) - 1
_GOLDEN = 0x9E3779B97F4A7C15
_worker: dict = {}


class PerfectHash:
    """Minimal perfect hash of distinct byte strings; ``slot`` gives a number below their count, meaningful for the strings themselves."""

    def __init__(self, keys: list[bytes]):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        self.sizes, self.ranks, base = [], [], 0
        while len(hashes):
            size = 2 * len(hashes)
            at = self._mixed(hashes, len(self.sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.sizes.append(size)
            self.ranks.append(np.where(alone, base + np.cumsum(alone) - 1, -1).tolist())
            base += int(alone.sum())
            hashes = hashes[~alone[at.astype(np.int64)]]
            if len(self.sizes) > 200:
                raise ValueError("two keys are the same")

    @staticmethod
    def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hashes + np.uint64(level * _GOLDEN & _MASK)) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))

    def slot(self, key: bytes) -> int:
        """-1 if no level has a place for it."""
        h = xxhash.xxh3_64_intdigest(key)
        for level, size in enumerate(self.sizes):
            x = (h + level * _GOLDEN) * 0xD6E8FEB86659FD93 & _MASK
            rank = self.ranks[level][(x ^ x >> 32) % size]
            if rank >= 0:
                return rank
        return -1


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        entries = {int(rank): base64.b64decode(token) for token, rank in pairs}
        self.entries = entries
        self.hash = PerfectHash(list(entries.values()))
        self.slots: list = [None] * len(entries)
        for rank, token in entries.items():
            self.slots[self.hash.slot(token)] = (token, rank)
        self.bytes = [self.rank(bytes([b])) for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, int] = {}  # ranks of pairs of ids that were asked for, at most MEMO
        self.recent = Recent(lambda tokens: list(map(self._token, tokens)), MEMO)

    def rank(self, token: bytes) -> int:
        slot = self.hash.slot(token)
        if slot >= 0:
            found, rank = self.slots[slot]
            if found == token:
                return rank
        return -1

    def _asked(self, key: int) -> int:
        """Rank of a pair of ids that isn't remembered."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        found = self.pairs[key] = self.rank(self.entries[key >> 20] + self.entries[key & 0xFFFFF])
        return found

    def merged(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary. Heap entries are rank << 32 | place; one is out of date if the pair that now
        begins at its place has another rank."""
        ids, size, known, asked = [self.bytes[b] for b in token], len(token), self.pairs.get, self._asked
        ranks = []
        for a, b in zip(ids, ids[1:]):
            rank = known(key := a << 20 | b)
            ranks.append(asked(key) if rank is None else rank)
        ranks.append(-1)
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            entry = heappop(heap)
            i, joined = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != joined:
                continue
            j = after[i]
            ids[i], ids[j], ranks[i], ranks[j] = joined, -1, -1, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                rank = known(key := joined << 20 | ids[k])
                ranks[i] = rank = asked(key) if rank is None else rank
                if rank >= 0:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = known(key := ids[h] << 20 | joined)
                ranks[h] = rank = asked(key) if rank is None else rank
                if rank >= 0:
                    heappush(heap, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def _token(self, token: str) -> bytes:
        data = token.encode("utf-8")
        rank = self.rank(data)
        return np.array([rank] if rank >= 0 else self.merged(data), "<u4").tobytes()

    def encode(self, given: list[str]) -> list[bytes]:
        """Ids of each text."""
        return [ids for some in portions(given) for ids in self.recent.joined(list(map(self.pattern.findall, some)))]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _worker:
        _worker[path, pattern] = Vocabulary(path, pattern)
    return _worker[path, pattern]


def _mapped(rows: DataFrame, given: str, made: str, empty: str | bytes, fn) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array(fn([x or empty for x in batch.column("_given").to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), out], ["row", "made"])

    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != made]).alias("_row"), F.col(f"`{given}`").alias("_given"))
    done = in_batches(packed, run, f"row {packed.schema['_row'].dataType.simpleString()}, made binary")
    return done.select(*[F.col(f"row.`{c}`") for c in rows.columns if c != made], F.col("made").alias(made))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns of ``docs``, with the binary column ``ids``, in place of a column of that name."""
    return _mapped(docs, text, ids, "", lambda given: _vocabulary(path, pattern).encode(given))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All rows and columns, with the bytes of the ids as binary column ``decoded``."""
    return _mapped(rows, ids, decoded, b"", lambda given: list(map(_vocabulary(path, pattern).decode, given)))
