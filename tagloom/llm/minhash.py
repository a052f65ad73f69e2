"""Document fingerprints by MinHash.

A text is its set of shingles of SHINGLE words. PERMUTATIONS universal hash functions (a * x + b modulo 2**64, high bits) are applied to the
shingle hashes in vectorised numpy; the minimum of each, cut to 16 bits, is one component of the fingerprint. The share of equal components
estimates the Jaccard similarity of two sets. For near-duplicates, bands of the fingerprint are joined in Spark and candidates are verified
by the Jaccard similarity of the shingle sets.

Defined cases: fewer words than SHINGLE: the whole sequence is the only shingle. No word (null, empty, white space): a fingerprint of its
own, which equals that of other texts without words and differs from all others. Repeated shingles count once, by the nature of a minimum.
Equal texts have equal fingerprints. An empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, squeezed, stash, texts, unsqueezed
from .graph import components

PERMUTATIONS = 128
SHINGLE = 5
BANDS = 32  # of 4 components each
SIMILARITY = 0.8
BUCKET = 1024
_STEP = 2048  # shingles whose permutations are made at a time
_drawn = np.random.default_rng(5)
_A = _drawn.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _drawn.integers(0, 2**64, PERMUTATIONS, np.uint64)
_BYTE = _drawn.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> np.ndarray:
    """Hash of each word, by prefix sums of a polynomial, so that equal words have equal hashes wherever they stand."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingles(text: str) -> np.ndarray:
    """Hash of each shingle, in order, repeats included."""
    w = words(text)
    n = max(1, len(w) - SHINGLE + 1) if len(w) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        out = out * np.uint64(_BASE) + w[k:k + n]
    return _mixed(out)


def signature(text: str) -> np.ndarray:
    """PERMUTATIONS components of 16 bits."""
    found = shingles(text)
    least = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), _STEP):
        np.minimum(least, (found[i:i + _STEP, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u2") if len(found) else np.full(PERMUTATIONS, 0xFFFF, "<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fingerprint"])

    return in_batches(texts(docs), run, "doc_id long, fingerprint binary")


def edited(text: str, following: str) -> str:
    """The last third of a text's code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _edit(doc_id, text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    new = edited(text, following)
    changed = mine if new == text else signature(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), mine.tobytes(), changed.tobytes(), likeness(mine, changed), likeness(mine, theirs))


def with_edits(docs: DataFrame) -> DataFrame:
    """Of every row its fingerprint, that of its edited text and their likenesses; the next document is that of the next smaller doc_id
    (null last; of equal ids, by a hash of the text), after the last the first.

    Rows are spread by ranges of doc_id and pass their task in order, so that a row meets the next one where it stands. Only the last row
    of a task has to wait for the first row of the next task; these pairs are joined afterwards, two rows for each task.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = squeezed(texts(docs).withColumn("h", F.xxhash64("text"))).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, names = TaskContext.get().partitionId(), None, [f.split(" ")[0] for f in _EDITS.split(", ")]

        def rows_of(made: list[tuple], role: str | None, text: str | None) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            cells = [pa.array(c, t) for c, t in zip(zip(*made), kinds)]
            extra = [pa.array([part] * len(made), pa.int32()), pa.array([role] * len(made), pa.string()), pa.array([text] * len(made), pa.string())]
            return pa.RecordBatch.from_arrays([*cells, *extra], [*names, "part", "role", "text"])

        for batch in batches:
            made = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), unsqueezed(batch.column("text").to_pylist())):
                text = data.decode("utf-8")
                now = (doc_id, text, signature(text))
                if held is None:
                    yield rows_of([(doc_id, None, None, now[2].tobytes(), None, None, None)], "first", text)
                else:
                    made.append(_edit(*held, *now[1:]))
                held = now
            if made:
                yield rows_of(made, None, None)
        if held is not None:
            yield rows_of([(held[0], None, None, held[2].tobytes(), None, None, None)], "last", held[1])

    done = stash(in_batches(rows, run, f"{_EDITS}, part int, role string, text string"))
    parts = sorted(r["part"] for r in done.where("role = 'last'").select("part").collect())  # one number for each task
    following = [(a, b) for a, b in zip(parts, parts[1:] + parts[:1])]
    after = done.sparkSession.createDataFrame(following, "part int, next int")
    lasts = done.where("role = 'last'").join(after, "part")
    firsts = done.where("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                mine, theirs = (np.frombuffer(r[c], "<u2") for c in ("fingerprint", "next_fingerprint"))
                names = [f.split(" ")[0] for f in _EDITS.split(", ")]
                made = dict(zip(names, _edit(r["doc_id"], r["text"], mine, r["next_text"], theirs)))
                yield pa.RecordBatch.from_pylist([made], pa.schema(
                    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
                     ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    waited = in_batches(lasts.join(firsts, "next").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"), settle, _EDITS)
    return done.where("role is null").drop("part", "role", "text").union(waited)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands, shingles): the shingle set as sorted numbers, a digest of it, and the bands of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("text").to_pylist()
            found = [np.unique(shingles(t)).tobytes() for t in given]
            bands = [signature(t).view("<i8").tolist() for t in given]
            cells = [pa.array([hashlib.blake2b(s, digest_size=16).hexdigest() for s in found]), pa.array(bands, pa.list_(pa.int64())), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells], ["doc_id", "digest", "bands", "shingles"])

    return in_batches(texts(docs), run, "doc_id long, digest string, bands array<long>, shingles binary")


def bucket_links(names: list[str], sets: list[np.ndarray]) -> list[tuple[str, str]]:
    """Links of sets whose Jaccard similarity is at least SIMILARITY, at most one fewer than there are sets; sets that are linked already
    are not compared."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i]))
    parent, out = list(range(len(sets))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for place, i in enumerate(order):
        for j in reversed(order[:place]):
            if len(sets[j]) < SIMILARITY * len(sets[i]):
                break
            if root(i) != root(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
                    out.append((names[i], names[j]))
    return out


def _in_buckets(rows: DataFrame) -> DataFrame:
    """Links within each key of (key, digest, shingles) rows; one bucket at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = {}, None

        def links() -> pa.RecordBatch:
            found = bucket_links(list(held), list(held.values()))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, digest, data in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "shingles"))):
                if key != at:
                    if len(held) > 1:
                        yield links()
                    held, at = {}, key
                held[digest] = np.frombuffer(data, np.uint64)
        if len(held) > 1:
            yield links()

    return in_batches(rows.repartition("key").sortWithinPartitions("key"), run, "a string, b string")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every row: group_id is the smallest doc_id that verified links lead to.

    Equal shingle sets are one node. Nodes that share a band of four components are candidates; only nodes of shared bands are moved
    with their sets. A band that more than BUCKET nodes share is cut by a second band: nodes of similarity 0.8 share another of the 31 all
    but surely. Within a bucket sets are verified, and links that join nothing new are not reported."""
    sets = stash(_sets(docs))
    nodes = stash(sets.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("shingles").alias("shingles")))
    wide = nodes.where(F.length("shingles") > 0)
    keyed = wide.select("digest", F.posexplode("bands").alias("band", "part")).select("digest", F.xxhash64("band", "part").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stash(keyed.join(sizes, "key"))
    few = shared.where(F.col("size") <= BUCKET).select("digest", "key")
    crowded = shared.where(F.col("size") > BUCKET).join(wide.select("digest", F.posexplode("bands").alias("band", "part")), "digest") \
        .where(F.col("key") != F.xxhash64("band", "part")).select("digest", F.xxhash64("key", "band", "part").alias("key"))
    links = _in_buckets(few.union(crowded).join(wide.select("digest", "shingles"), "digest").select("key", "digest", "shingles"))
    joined = components(links)
    ids = joined.join(nodes, joined.node == nodes.digest).select("digest", "root", "least")
    smallest = ids.groupBy("root").agg(F.min("least").alias("group"))
    of = nodes.select("digest", "least").join(ids.join(smallest, "root").select("digest", "group"), "digest", "left")
    return sets.join(of, "digest").select("doc_id", F.coalesce("group", "least").alias("group_id"))
