"""Repeated passages by a sparse suffix array.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else. Sorting the suffixes that start at each byte would move
every text a hundred times, so only anchored suffixes are sorted at first: of the GRAM-byte strings within each window of LENGTH bytes, the one
with the smallest hash is the window's anchor, and windows that are equal have their anchor at the same place. Windows in a row that
share an anchor are a zone; its suffix is written as tokens: the fingerprint of the anchor's GRAM bytes and that of the whole zone.

Suffixes are spread by ranges of their leading tokens, between splitters that Spark samples; ties are split by place, so that no passage, however
frequent, fills a bucket. Each bucket is sorted by multikey quicksort and neighbours are compared; runs that may go on in the next bucket are
compared by the first and last suffix of each bucket. Equal zones are repeated as a whole. Where zones share an anchor but differ, one zone
of each kind is taken apart: the suffixes of all its windows, as tokens of anchor and LENGTH-byte string, are sorted and compared in the same
way. Fingerprints are of 64 bits each from independent hashes; two tokens of a suffix make 128.

Defined cases: null or empty text and texts shorter than LENGTH bytes: nothing is removed. A repeated row repeats all its strings, so that
both lose them. Matches never cross documents. A text that repeats itself (aaaa...) loses all strings that occur twice. Long texts are read
in blocks; a zone that is cut by a block is settled window by window.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_batches, squeezed, stash, texts, unsqueezed

LENGTH = 400
GRAM = 200
BLOCK = 100_000  # windows looked at together
BUCKET = 400_000  # suffixes in a bucket, about
SMALL = 512
_PLACE = (1 << 18) - 1
_WIDTH = LENGTH - GRAM + 1  # GRAM-byte strings in a window


class Rolling:
    """Fingerprints of byte strings from prefix sums, so that equal strings have equal ones wherever they stand."""

    def __init__(self, seed: int):
        drawn = np.random.default_rng(seed)
        self.byte = drawn.integers(0, 2**64, 256, np.uint64)
        self.base = int(drawn.integers(0, 2**62)) << 2 | 1
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers[0]) <= len(data):
            for i, base in enumerate((self.base, pow(self.base, -1, 1 << 64))):
                steps = np.full(2 * len(data) + 2, base, np.uint64)
                steps[0] = 1
                self.powers[i] = np.multiply.accumulate(steps)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.powers[0][:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.powers[1][starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ANCHORS, WINDOWS = Rolling(1), Rolling(2)


def zones(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor token, zone token) of all zones of a text, as int64."""
    out = [(np.zeros(0, np.int64),) * 4]
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[at:at + BLOCK + LENGTH - 1]
        grams, windows = len(part) - GRAM + 1, len(part) - LENGTH + 1
        place = np.arange(grams)
        token = ANCHORS.of(ANCHORS.sums(part), place, place + GRAM)
        rank = token & ~np.uint64(_PLACE) | (_PLACE - place).astype(np.uint64)  # of equal ones the last
        rows = -(-grams // _WIDTH)
        full = np.full(rows * _WIDTH, 2**64 - 1, np.uint64)
        full[:grams] = rank
        grid = full.reshape(rows, _WIDTH)
        ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(grid, axis=1).ravel()
        least = np.minimum(ahead[:windows], behind[_WIDTH - 1:_WIDTH - 1 + windows])
        anchor = _PLACE - (least & np.uint64(_PLACE)).astype(np.int64)
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [windows - 1]])
        whole = WINDOWS.of(WINDOWS.sums(part), first, last + LENGTH)
        shape = ((last - first) << 32 | anchor[first] - first).astype(np.uint64)
        out.append((first + at, last + at, token[anchor[first]].view(np.int64), mixed(whole + shape * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def quicksorted(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their tokens: multikey quicksort, which splits into less, equal and greater by one token and goes on to the next token
    among equal ones only. Short stretches are sorted directly."""
    order = np.arange(len(tokens[0]))
    work = [(0, len(order), 0)]
    while work:
        low, high, depth = work.pop()
        part = order[low:high]
        if high - low <= SMALL or depth == len(tokens) - 1:
            order[low:high] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        values = tokens[depth][part]
        pivot = np.sort(values[[0, len(values) // 2, -1]])[1]
        less, equal = values < pivot, values == pivot
        order[low:high] = np.concatenate([part[less], part[equal], part[~less & ~equal]])
        a = low + int(less.sum())
        b = a + int(equal.sum())
        work += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


_COLUMNS = ("lead", "next", "doc_id", "h", "first", "last", "anchor")


def _buckets(rows: DataFrame, count: int) -> DataFrame:
    """Rows (lead, next, doc_id, h, first, last, anchor) whose lead occurs again in their bucket, or may do so in another, with what their
    bucket shows: again (both tokens occur twice), mixed (equal leads have several nexts) and head (first of its tokens)."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BUCKET))
    spread = rows.repartitionByRange(n, "lead", "next", "doc_id", "h", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        columns = {c: table.column(c).to_numpy() for c in _COLUMNS}
        order = quicksorted([columns[c] for c in ("lead", "next", "doc_id", "h", "first")])
        columns = {c: v[order] for c, v in columns.items()}
        lead, nxt, size = columns["lead"], columns["next"], len(order)
        new_lead = np.concatenate([[True], lead[1:] != lead[:-1]])
        new = new_lead | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        of_lead, of_both = np.cumsum(new_lead) - 1, np.cumsum(new) - 1
        leads, both = np.bincount(of_lead), np.bincount(of_both)
        kinds = np.bincount(of_lead[new])
        edge = (of_lead == 0) | (of_lead == of_lead[-1])
        keep = np.flatnonzero((leads[of_lead] > 1) | edge)
        part = np.full(size, TaskContext.get().partitionId())
        made = {**columns, "again": both[of_both] > 1, "mixed": kinds[of_lead] > 1, "head": new, "begins": of_both == 0, "ends": of_both == of_both[-1], "edge": edge, "part": part}
        for i in range(0, len(keep), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[keep[i:i + 100_000]]) for v in made.values()], list(made))

    schema = ", ".join([f"{c} long" for c in _COLUMNS] + [f"{c} boolean" for c in ("again", "mixed", "head", "begins", "ends", "edge")] + ["part long"])
    found = stash(in_batches(spread.select(*_COLUMNS), run, schema))
    ends = {r["part"]: r for r in found.where("edge").groupBy("part").agg(
        F.min_by(F.struct("lead", "next"), F.struct("lead", "next")).alias("low"), F.max_by(F.struct("lead", "next"), F.struct("lead", "next")).alias("high")).collect()}
    parts = sorted(ends)  # two suffixes for each bucket
    none = (None, None)
    lows, highs = ([none, *[tuple(ends[p][side]) for p in parts], none] for side in ("low", "high"))
    near = spark.createDataFrame([(p, *highs[i], *lows[i + 2]) for i, p in enumerate(parts)],
                                 "part long, lead_before long, next_before long, lead_after long, next_after long")
    before, after = F.col("lead") == F.col("lead_before"), F.col("lead") == F.col("lead_after")
    beyond = F.col("begins") & before & (F.col("next") == F.col("next_before")) | F.col("ends") & after & (F.col("next") == F.col("next_after"))
    return found.join(F.broadcast(near), "part").select(
        *_COLUMNS, (F.col("again") | F.coalesce(beyond, F.lit(False))).alias("again"), (F.col("mixed") | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).alias("mixed"), "head")


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(_COLUMNS))


_ROWS = ", ".join(f"{c} long" for c in _COLUMNS)


def _zone_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text"))):
                first, last, anchor, zone = zones(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
                if len(first):
                    out.append([anchor, zone, np.full(len(first), doc_id), np.full(len(first), h), first, last, anchor])
            if out:
                yield _batch([np.concatenate(c) for c in zip(*out)])

    return in_batches(docs, run, _ROWS)


def _window_rows(docs: DataFrame) -> DataFrame:
    """One row for each window of the zones of the column ``taken``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, hs, frames, all_taken = (batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "taken"))
            for doc_id, h, text, taken in zip(doc_ids, hs, unsqueezed(frames), all_taken):
                data, out, held = np.frombuffer(text, np.uint8), [], 0
                for zone in taken:
                    a, b = zone["first"], zone["last"]
                    place = np.arange(b - a + 1)
                    token = WINDOWS.of(WINDOWS.sums(data[a:b + LENGTH]), place, place + LENGTH).view(np.int64)
                    size = len(place)
                    out.append([np.full(size, zone["lead"]), token, np.full(size, doc_id), np.full(size, h), place + a, place + a, np.full(size, zone["lead"])])
                    held += size
                    if held > 50_000:
                        yield _batch([np.concatenate(c) for c in zip(*out)])
                        out, held = [], 0
                if out:
                    yield _batch([np.concatenate(c) for c in zip(*out)])

    return in_batches(docs, run, _ROWS)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, first, last): stretches of windows that occur elsewhere, of rows (doc_id, h, text); doc_id and h together are the row."""
    every = stash(_zone_rows(docs))
    shared = stash(_buckets(every, every.count()))
    forget(every)
    whole = shared.where("again").select("doc_id", "h", "first", "last")
    taken = shared.where("mixed AND head").groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last", "lead")).alias("taken"))
    windows = stash(_window_rows(squeezed(docs).join(taken, ["doc_id", "h"]).select("doc_id", "h", "text", "taken")))
    single = _buckets(windows, windows.count()).where("again").select("doc_id", "h", "first", "last")
    return whole.union(single)


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the LENGTH-byte strings that start at windows starts..ends."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends + LENGTH, -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept is what is left, as bytes."""
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), "text", F.col("doc_id").alias("id"))
    spans = repeated_windows(rows.select("doc_id", "h", "text")).groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for data, found in zip(unsqueezed(batch.column("text").to_pylist()), batch.column("spans").to_pylist()):
                starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if found:
                    starts, ends = merged(np.array([s["first"] for s in found]), np.array([s["last"] for s in found]), len(data))
                gaps = zip([0, *ends.tolist()], [*starts.tolist(), len(data)])
                for column, value in zip(out, (len(data), int((ends - starts).sum()), len(starts), b"".join([data[a:b] for a, b in gaps]))):
                    column.append(value)
            made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = squeezed(rows).join(spans, ["doc_id", "h"], "left").select("id", "text", "spans")
    return in_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
