"""Best-fit packing planned over a histogram of lengths.

Texts become token ids and a closing id, and only what is longer than a sequence is cut. The plan is made from the counts of each length
(at most ``capacity`` numbers): lengths from the longest down, each into the fullest sequences that still have room, a whole group of equal
sequences at a time. A plan is a list of runs: so many pieces of one length, so many to a sequence, from this sequence and offset on. Pieces
then take their slots by rank within their length: a local rank in the partition that made them, plus the number of equal lengths in earlier
partitions. No group of pieces ever meets in one task, and the order within a length is free.

Defined cases: null or empty text: only the closing id, length 1. Repeated rows are packed as often as they occur. Empty table: no rows.
Other columns of the pieces are carried along. A piece of length 0 or above the capacity is an error.
"""
from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, portions, stash, texts

CAPACITY = 4096
CLOSING = 1
MEMO = 400_000  # pre-tokens whose ids a worker remembers
LONG = 64  # bytes of the longest pre-token that is remembered
PORTION = 1 << 22  # characters that are split together
# Fixed value: how the tokenizer file splits normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAILS = ("s", "t", "re", "ve", "m", "ll", "d")  # after an apostrophe, in PATTERN
SHORT = 4096  # texts of fewer characters together are split one by one
WHITE, LETTER, NUMBER, OTHER = range(4)
FAR = re.compile("[^\0-\u024f\u2000-\u206f]")  # no letter below has other cases or compositions in one version of Unicode than in the next


def _plain_pattern() -> re.Pattern:
    """PATTERN for ``re``, which is faster, with its classes written out; for text without characters above U+FFFF."""

    signs = "".join(map(chr, range(0x10000)))

    def listed(kind: str) -> str:
        return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{kind}+", signs))

    letter, number, white = listed(r"\p{L}"), listed(r"\p{N}"), listed(r"\s")
    return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{white}{letter}{number}]+")


def _kinds() -> np.ndarray:
    """What PATTERN takes each code point for: WHITE, LETTER, NUMBER or OTHER."""
    signs = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(signs), OTHER, np.uint8)
    for kind, listed in ((WHITE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for m in regex.finditer(f"{listed}+", signs):
            kinds[m.start():m.end()] = kind
    return kinds


def _byte_signs() -> np.ndarray:
    """The character by which the vocabulary writes each byte; a space stays one, as it parts pre-tokens and is in none."""
    plain, other = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    signs = np.array([b if b in plain else next(other) for b in range(256)], "<u2")
    signs[ord(" ")] = ord(" ")
    return signs


class WordIds:
    """Ids of texts by a tokenizer that normalises (NFC, lower case), drops white space, splits by PATTERN and marks the last id of each
    pre-token. Pre-tokens that were met before are not encoded again; new ones are encoded together, one space apart, and their ids parted
    at the marked ones. Texts that normalisation may split otherwise, or with a special token, are encoded by the tokenizer as a whole.
    Many texts are split together: arrays of the kinds of their characters show where pre-tokens begin, Arrow numbers the distinct ones, only
    those are looked up, and the ids of all are taken by number."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.parted = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parted.normalizer, self.parted.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.plain, self.wide = regex.compile(PATTERN), _plain_pattern(), re.compile("[\U00010000-\U0010ffff]")
        self.kinds, self.byte_signs = _kinds(), _byte_signs()
        self.tokens, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())  # what is remembered,
        self.used, self.calls = np.zeros(0, np.int64), 0  # and by which call it was needed last

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text that needs no normalisation."""
        return (self.plain if text.isascii() or not self.wide.search(text) else self.pattern).findall(text)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _made(self, tokens: list[str]) -> pa.LargeBinaryArray:
        joined = " ".join(tokens)
        near = not FAR.search(joined) and joined == joined.lower()  # then normalisation changes nothing, and the spaces are where PATTERN splits
        if near:
            joined = self.byte_signs[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.parted.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        else:
            ids = self._ids(joined)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(tokens):
            return pa.array([self._ids(t).tobytes() for t in tokens], pa.large_binary())
        offsets = np.concatenate([[0], 4 * ends])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])

    def _lower(self, text: str) -> str | None:
        """The text in lower case where that and splitting can come before normalisation, else None."""
        if any(t in text for t in self.special):
            return None
        lower = text if "\u03a3" in text else text.lower()  # the tokenizer has no final sigma
        if text.isascii() or "\u0130" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower):
            return lower
        return None

    def split_all(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The pre-tokens of texts that need no normalisation, one after the other, and how many of them come before each text and in all."""
        if sum(map(len, texts)) < SHORT:
            each = list(map(self.split, texts))
            return pa.array(list(itertools.chain(*each)), pa.string()), np.cumsum([0, *map(len, each)])
        joined = "\n".join([*texts, "\n\n"])  # white space parts pre-tokens; at the end there is enough for the longest tail
        narrow = joined.isascii()
        signs = np.frombuffer(joined.encode("ascii"), np.uint8) if narrow else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = self.kinds[signs]
        solid = kinds != WHITE
        new = solid.copy()
        new[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        quotes = np.flatnonzero(new & (signs == ord("'")))
        for tail in TAILS:
            found = quotes
            for k, sign in enumerate(tail, 1):
                found = found[signs[found + k] == ord(sign)]
            new[found + 1] = False
            after = found + len(tail) + 1
            new[after[kinds[after] == LETTER]] = True
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        before = np.searchsorted(np.flatnonzero(new), begins)
        starts, data = np.flatnonzero(new[solid]), signs[solid].tobytes()
        if not narrow:
            data = data.decode("utf-32-le").encode()
            starts = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)[starts]
        offsets = np.append(starts, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), before

    def _known(self, tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids that are known, and of each of the tokens where its ids begin and end there. Tokens that were not met lately are encoded."""
        if not len(tokens):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = tokens.dictionary_encode()
        keys, self.calls = coded.dictionary, self.calls + 1
        place = pc.index_in(keys, value_set=self.tokens)
        missing = keys.filter(place.is_null())
        if len(missing):
            self.tokens, self.ids = pa.concat_arrays([self.tokens, missing]), pa.concat_arrays([self.ids, self._made(missing.to_pylist())])
            self.used = np.concatenate([self.used, np.zeros(len(missing), np.int64)])
        place = place.fill_null(-1).to_numpy().copy()
        place[place < 0] = np.arange(len(self.tokens) - len(missing), len(self.tokens))
        self.used[place] = self.calls
        offsets = np.frombuffer(self.ids.buffers()[1], np.int64, len(self.ids) + 1) // 4
        data, at = np.frombuffer(self.ids.buffers()[2], "<u4"), place[coded.indices.to_numpy()]
        keep = pc.binary_length(self.tokens).to_numpy() <= LONG
        if len(keep) > MEMO:
            keep &= self.used >= np.partition(self.used, -(MEMO // 2))[-(MEMO // 2)]
            keep &= np.cumsum(keep[::-1])[::-1] <= MEMO
        if not keep.all():
            self.tokens, self.ids, self.used = self.tokens.filter(keep), self.ids.filter(keep), self.used[keep]
        return data, offsets[at], offsets[at + 1]

    def __call__(self, given: list[str]) -> list[bytes]:
        out = []
        for some in portions(given, PORTION):
            lower = [self._lower(t) for t in some]
            groups = [[i for i, t in enumerate(lower) if t is not None and t.isascii() == narrow] for narrow in (True, False)]  # ASCII needs no decoding
            parts = [self.split_all([lower[i] for i in group]) for group in groups]
            data, first, last = self._known(pa.concat_arrays([tokens for tokens, _ in parts]))
            ends = np.concatenate([[0], np.cumsum(last - first)])
            ids = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], last - first)]
            made, start = {}, 0
            for group, (tokens, before) in zip(groups, parts):
                made.update(zip(group, itertools.pairwise(ends[before + start].tolist())))
                start += len(tokens)
            out += [ids[slice(*made[i])].tobytes() if i in made else self._ids(t).tobytes() for i, t in enumerate(some)]
        return out


@functools.cache
def _words(path: str) -> WordIds:
    """One for all tasks of a worker. A function of the module finds it again, while a global of a nested function comes anew with each task."""
    return WordIds(path)


class _Places:
    """(part, rank) of pieces: their partition, and their rank among those of their length that it made."""

    KIND = "struct<part: long, rank: long>"

    def __init__(self, capacity: int):
        self.part, self.before = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

    def __call__(self, lengths: np.ndarray) -> pa.StructArray:
        order = np.argsort(lengths, kind="stable")
        inside = np.empty(len(lengths), np.int64)
        inside[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
        ranks = inside + self.before[lengths]
        self.before += np.bincount(lengths, minlength=len(self.before))
        return pa.StructArray.from_arrays([pa.array(np.full(len(ranks), self.part)), pa.array(ranks)], ["part", "rank"])


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, place) of all texts; ids are little-endian unsigned 32-bit numbers, place is for ``pack``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        closing, width, places = np.array([CLOSING], "<u4").tobytes(), 4 * capacity, _Places(capacity)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words(batch.column("text").to_pylist())):
                ids += closing
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, part)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*made, places(made[3].to_numpy())], ["doc_id", "piece", "start", "length", "ids", "place"])

    return in_batches(texts(docs), run, f"doc_id long, piece int, start long, length long, ids binary, place {_Places.KIND}")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces to a sequence, offset), by length and rank."""
    runs, sequences = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, how many)
    left: list[int] = []  # the keys of room, ascending

    def keep(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in room:
                room[space] = []
                insort(left, space)
            room[space].append((first, many))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids doesn't fit")
        rank, todo = 0, counts[length]
        while todo:
            i = bisect_left(left, length)
            if i == len(left):
                first, many, space = sequences, -(-todo // (capacity // length)), capacity
                sequences += many
            else:
                space = left[i]
                first, many = room[space].pop()
                if not room[space]:
                    del room[space], left[i]
            each = min(space // length, todo)
            full = min(many, todo // each)
            runs.append((length, rank, first, each, capacity - space))
            keep(space - each * length, first, full)
            keep(space, first + full, many - full)
            rank, todo = rank + full * each, todo - full * each
    return sorted(runs)


def pack(pieces: DataFrame, capacity: int = CAPACITY, place: str | None = None) -> DataFrame:
    """All rows and columns of ``pieces`` (with a long ``length``), with sequence_id and offset. ``place`` names a column of places made with the
    pieces, which then stays behind; a task that tokenizes needs no second worker for them, which would learn the pre-tokens once more."""
    carried = [c for c in pieces.columns if c != place]
    columns = [F.col(f"row.`{c}`") for c in carried]
    known = [F.col(f"`{place}`").alias("place")] if place else []
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("length").cast("long").alias("length"), *known)
    kind = rows.schema["row"].dataType.simpleString()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(capacity)
        for batch in batches:
            found = places(batch.column("length").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], ["row", "length", "place"])

    rows = rows if place else in_batches(rows, ranked, f"row {kind}, length long, place {_Places.KIND}")
    held = stash(rows.select("row", "length", "place.part", "place.rank"))
    sizes = held.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    placed = held.join(bases, ["part", "length"]).select("row", "length", (F.col("rank") + F.col("base")).alias("rank"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            sequence, nth = np.divmod(rank - run[:, 1], run[:, 3])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(run[:, 2] + sequence), pa.array(run[:, 4] + nth * length)], ["row", "sequence_id", "offset"])

    return in_batches(placed, slots, f"row {kind}, sequence_id long, offset long").select(*columns, "sequence_id", "offset")
