"""SimHash near-duplicates, compared through pivot distance tables.

A fingerprint has 64 bits. Texts link when their fingerprints differ in at most DISTANCE bits; equal fingerprints are one node.

Candidates come from blocks: the 64 bits are cut into 6 blocks, and two fingerprints that differ in 3 bits agree in at least 3 whole
blocks, so every link shares one of 20 keys of about 32 bits. In a bucket of one key the Hamming distances of all members to PIVOTS
reference fingerprints are tabled once; a pair is discarded as soon as two distances to one pivot differ by more than DISTANCE (the
triangle inequality), and what survives is verified bit by bit. Members that are linked already are not reported again: a bucket of m
gives at most m - 1 links, which join the same documents as all of its links do. A bucket of more than BUCKET members is cut again by the
bits that its key leaves free, so a bucket never holds more than 2**17 fingerprints, whatever the number of documents.

Defined cases: no word (null, empty, white space): fingerprint 0, linked like any other. Fewer than 3 words: the whole sequence is the only
shingle. Repeated shingles count as often as they occur. Repeated rows share a fingerprint and so a component. An empty table gives an empty
table. A component all of whose ids are null has a null id.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stash
from .graph import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
BLOCKS = 6
PIVOTS = 32
BUCKET = 2048
_STEP = 65536  # shingles whose bits are counted at a time


def fingerprint(text: str | None) -> int:
    """Of one text, unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII white space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[:1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        bits = np.array(hashes[i:i + _STEP], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row as struct ``row``, its doc_id as ``id``, and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("row").field("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(found.view(np.int64))], ["row", "id", "fp"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return in_batches(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, id long, fp long")


def _masks(bits: list[int]) -> list[int]:
    """Signed masks of each choice of BLOCKS - DISTANCE blocks of the given bits."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, BLOCKS)]
    chosen = [sum(some) for some in combinations(blocks, BLOCKS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


TABLES = _masks(list(range(64)))
FINER = [[m | n for n in _masks([b for b in range(64) if not m >> b & 1])] for m in TABLES]  # by table, for crowded buckets


def _keys(masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")


def _pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, PIVOTS, np.uint64)


def bucket_links(members: np.ndarray) -> list[tuple[int, int]]:
    """Links of distinct fingerprints (uint64), at most one fewer than there are members."""
    pivots = _pivots()
    table = np.bitwise_count(members[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    members, table = members[order], table[order]
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    last = np.searchsorted(table[:, 0], table[:, 0] + DISTANCE, "right")
    for i in range(len(members) - 1):
        near = table[i + 1:last[i]]
        left = np.flatnonzero(np.abs(near - table[i]).max(axis=1, initial=0) <= DISTANCE) + i + 1
        for j in left[np.bitwise_count(members[left] ^ members[i]) <= DISTANCE].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((int(members[i]), int(members[j])))
    return out


def _in_buckets(rows: DataFrame) -> DataFrame:
    """Links of (t, key, fp) rows within each (t, key). Rows arrive sorted, so one bucket at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def links() -> pa.RecordBatch:
            found = np.array(bucket_links(np.unique(np.concatenate(held)).view(np.uint64)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            t, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp"))
            cuts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(t)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at != (t[a], key[a]):
                    if sum(map(len, held)) > 1:
                        yield links()
                    held, at = [], (t[a], key[a])
                held.append(fp[a:b])
        if sum(map(len, held)) > 1:
            yield links()

    return in_batches(rows.repartition("t", "key").sortWithinPartitions("t", "key"), run, "a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that give the same components as all pairs within DISTANCE bits."""
    keyed = nodes.select("fp", _keys(TABLES)).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(keyed.join(sizes, ["t", "key"]))
    found = _in_buckets(shared.where(F.col("n") <= BUCKET).drop("n"))
    crowded = shared.where(F.col("n") > BUCKET)
    tables = [r["t"] for r in crowded.select("t").distinct().collect()]  # 20 at most
    for t in tables:
        finer = crowded.where(F.col("t") == t).select("fp", _keys(FINER[t])).select("k.t", "k.key", "fp").distinct()
        found = found.union(_in_buckets(finer))
    return found


def classes(marked: DataFrame) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of (id, fp) rows; component_id is the smallest id of all linked fingerprints."""
    least = stash(marked.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    ids = joined.join(least, "fp").select("fp", "root", "least")
    smallest = ids.groupBy("root").agg(F.min("least").alias("component"))
    of = ids.select("fp", "root").join(smallest, "root").select("fp", "component")
    return least.join(of, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = stash(fingerprints(docs.select("doc_id", "text")).select("id", "fp"))
    return marked.join(classes(marked), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def first_rows(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id, null last; of several such rows, one. All columns of ``docs``."""
    marked = stash(fingerprints(docs).withColumn("n", F.monotonically_increasing_id()))
    nodes = marked.select("id", "fp", "n")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("n"))
    by_class = nodes.groupBy("fp").agg(F.min(rank).alias("first"))
    kept = by_class.join(classes(nodes), "fp").groupBy("component_id").agg(F.min("first").alias("first")).select("first.n")
    return marked.join(kept, "n", "left_semi").select(*[F.col(f"row.`{c}`") for c in docs.columns])
