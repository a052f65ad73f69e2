"""Distance of pool vectors to positive and negative references."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..session import cut_lineage

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]
BLOCK = 1024  # references of a tile, about
ROWS = 2048  # rows of a tile at most
GATHER = 256  # distances of one record that may travel
RESIDENT = 64 << 20  # bytes of all references up to which a task holds them
HELD = 4 << 20  # bytes of rows that meet them together, about
SPREAD = 1 << 24  # distances that are worth a group of their own, as long as some cores would idle
CELLS = 2_000_000  # distances of a group worked on at once
LEAF, DIRECT = 16, 1 << 16  # lines of a box, and its distances, from which on it is cut again
BINS = 256  # value ranges counted for one record in a pass


def _joined(vectors: pa.Array | pa.ChunkedArray) -> bytes:
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    return np.asarray(flat, dtype=np.float64).tobytes()


def _reference_block(table: pa.Table) -> pa.Table:
    role, block = table.column("role")[0].as_py(), table.column("block")[0].as_py()
    ids = pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type))
    return pa.table([pa.array([role]), pa.array([block], pa.int32()), ids, pa.array([_joined(table.column("embedding"))], pa.binary())],
                    names=["role", "block", "heads", "matrix"])


def _row_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, at most ROWS side by side in one row."""
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            b = whole.slice(k, ROWS)
            listed = [pa.array([b.column(c).to_pylist()], pa.list_(b.schema.field(c).type)) for c in ("id", "role", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*listed, pa.array([_joined(b.column("embedding"))], pa.binary())], ["id", "role", "lo", "hi", "rows"])


def _distances(t: dict, metric: Metric) -> np.ndarray:
    """Distances of a tile. What does not count is NaN: a reference to itself, and negatives for rows outside the pool."""
    shape = lambda b, n: np.frombuffer(b, np.float64).reshape(n, -1)
    d = np.array(metric(shape(t["rows"], len(t["id"])), shape(t["matrix"], len(t["heads"]))), dtype=np.float64)
    if t["head_role"] == "neg":
        d[[r != "pool" for r in t["role"]]] = np.nan
    else:
        at = {h: j for j, h in enumerate(t["heads"])}
        for i, (key, role) in enumerate(zip(t["id"], t["role"])):
            if role == "ref" and key in at:
                d[i, at[key]] = np.nan
    return d


def _gathered(metric: Metric, id_type: pa.DataType):
    """Distances between lo and hi to references, in order; the smallest distance to a negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                d, n = _distances(t, metric), len(t["id"])
                if t["head_role"] == "neg":
                    low = np.fmin.reduce(d, axis=1)
                    values, neg = [[]] * n, [None if np.isnan(x) else x for x in low.tolist()]
                else:
                    ok = (d >= np.asarray(t["lo"])[:, None]) & (d <= np.asarray(t["hi"])[:, None])
                    values, neg = [d[i, ok[i]] for i in range(n)], [None] * n
                yield pa.RecordBatch.from_arrays([pa.array(t["id"], id_type), pa.array(values, pa.list_(pa.float64())), pa.array(neg, pa.float64())], ["id", "v", "neg"])

    return run


def _binned(metric: Metric, id_type: pa.DataType):
    """How many distances fall into each part of lo..hi, with the smallest and the largest; an endless range has one part for all finite ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                d, lo, hi = _distances(t, metric), np.asarray(t["lo"])[:, None], np.asarray(t["hi"])[:, None]
                row, col = np.nonzero((d >= lo) & (d <= hi))
                v, lo, hi = d[row, col], lo[row, 0], hi[row, 0]
                part = 1 + np.isposinf(v) - np.isneginf(v)  # of an endless range
                ends = np.isfinite(lo) & np.isfinite(hi)
                share = (v[ends] / 2 - lo[ends] / 2) / np.maximum(hi[ends] / 2 - lo[ends] / 2, np.finfo(float).tiny)  # halves: no overflow
                part[ends] = np.minimum(BINS - 1, share * BINS).astype(np.int64)
                key = row * BINS + part
                order = np.lexsort((v, key))
                key, v = key[order], v[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                n = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(t["id"], id_type).take(pa.array(key[first] // BINS)), pa.array(key[first] % BINS), pa.array(n),
                                                  pa.array(v[first]), pa.array(v[first + n - 1])], ["id", "part", "n", "low", "high"])

    return run


def _tiles(rows: DataFrame, heads: DataFrame, blocks: int) -> DataFrame:
    """Every tile of rows next to every block of references: an equi-join on the number of the block, which Spark broadcasts if the references
    are small and splits where a block meets many tiles."""
    listed = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in ("id", "role", "lo", "hi"))
    packed = rows.select("id", "role", "lo", "hi", "embedding").mapInArrow(_row_tiles, listed + ", rows binary")
    return packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(heads, "block")


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as lines; a null vector is a line of NaN."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    out = np.full((len(flat), width), np.nan)
    some = np.asarray(flat.is_valid())
    out[some] = np.asarray(flat.drop_null().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    return out


def _middle(d: np.ndarray) -> np.ndarray:
    """Median of each line without its NaNs; NaN for a line without values."""
    n = d.shape[1] - np.isnan(d).sum(1)
    out = np.full(len(d), np.nan)
    for k in np.unique(n[n > 0]):
        at = np.flatnonzero(n == k)
        part = np.partition(d[at], ((k - 1) // 2, k // 2), axis=1)  # NaN comes last
        out[at] = (part[:, (k - 1) // 2] + part[:, k // 2]) / 2
    return out


def _ranked(v: np.ndarray, heads: np.ndarray, low: int, high: int, metric: Metric) -> np.ndarray:
    """Of each line of ``v`` its distances to ``heads`` of ranks ``low`` to ``high`` (from 0), exact, for finite numbers and a metric with the triangle inequality.

    Lines lie in a tree of boxes. A line at most r from a middle m has distances that differ from those of m by at most r, and so do those of a
    rank; heads whose distance to m is more than 2 r away from those ranks are surely below or above, for all lines of the box and the
    boxes in it, and are looked at no more. Equal lines are one box of no extent, compared once.
    """
    out = np.empty((len(v), high - low + 1))
    slack = 1e-9 * v.shape[1] * (np.abs(v).max(initial=0) + np.abs(heads).max(initial=0))  # above the rounding of distances
    boxes = [(np.arange(len(v)), heads, 0)]
    while boxes:
        at, some, below = boxes.pop()
        p = v[at]
        least, most = p.min(0), p.max(0)
        same = bool((least == most).all())
        if not same and len(at) > LEAF and len(at) * len(some) > DIRECT:
            middle = ((least + most) / 2)[None, :]
            reach = 2 * metric(middle, p).max() + slack
            d = metric(middle, some)[0]
            ends = np.partition(d, (low - below, high - below))[[low - below, high - below]]
            under = d < ends[0] - reach
            some, below = some[~under & (d <= ends[1] + reach)], below + int(under.sum())
            order = np.argpartition(p[:, (most - least).argmax()], len(at) // 2)
            boxes += [(at[part], some, below) for part in (order[: len(at) // 2], order[len(at) // 2 :])]
            continue
        ranks = np.arange(low - below, high - below + 1)
        if same:
            out[at] = np.partition(metric(p[:1], some)[0], ranks)[ranks]
            continue
        step = max(1, CELLS // len(some))
        for k in range(0, len(at), step):
            out[at[k : k + step]] = np.partition(metric(p[k : k + step], some), ranks, axis=1)[:, ranks]
    return out


def _middle_of(v: np.ndarray, heads: np.ndarray, own: np.ndarray, metric: Metric) -> np.ndarray:
    """Median distance of each line to ``heads``, without the one that ``own`` names (-1: none), by ``_ranked``."""
    n = len(heads)
    low, high = max(0, (n - 2) // 2), min(n - 1, (n - 1) // 2 + 1)
    x = _ranked(v, heads, low, high, metric)
    out = (x[:, (n - 1) // 2 - low] + x[:, n // 2 - low]) / 2
    mine = np.flatnonzero(own >= 0)
    if len(mine) and n == 1:
        out[mine] = np.nan
    elif len(mine):
        d = np.array([metric(v[k : k + 1], heads[own[k] : own[k] + 1])[0, 0] for k in mine])
        rest = lambda rank: np.where(d <= x[mine, rank - low], x[mine, min(rank + 1, high) - low], x[mine, rank - low])
        out[mine] = (rest((n - 2) // 2) + rest((n - 1) // 2)) / 2
    return out


def _whole(metric: Metric, carry: tuple[str, ...]):
    """Rows of a group with their scores against all references. Rows that share an id share their distances, and each comes once for each of them."""

    def run(rows: pa.Table, heads: pa.Table) -> pa.Table:
        sides = {}
        for side in ("ref", "neg"):
            listed = [h for h in sorted(heads.select(["head_role", "block", "heads", "matrix"]).to_pylist(), key=lambda h: h["block"]) if h["head_role"] == side]
            names = [x for h in listed for x in h["heads"]]
            sides[side] = names, np.frombuffer(b"".join(h["matrix"] for h in listed), np.float64).reshape(len(names), -1) if names else None
        (refs, matrix), (negs, away) = sides["ref"], sides["neg"]
        known = {h: j for j, h in enumerate(refs)}
        matrix = np.zeros((0, 1)) if matrix is None else matrix
        v = _matrix(rows.column("embedding"), matrix.shape[1])
        column = rows.column("id").combine_chunks()
        given = np.asarray(column.is_valid())
        coded = column.dictionary_encode()
        codes = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        times = np.ones(len(codes), np.int64)
        times[given] = np.bincount(codes[given])[codes[given]]
        pool, ref = (np.asarray(pc.fill_null(pc.equal(rows.column("role"), side), False)) for side in ("pool", "ref"))
        own = np.full(len(codes), -1)
        mine = np.flatnonzero(ref & given)
        own[mine] = [known.get(x, -1) for x in column.take(pa.array(mine)).to_pylist()]
        scores, lows = np.full(len(codes), np.nan), np.full(len(codes), np.nan)
        step = max(1, CELLS // max(1, len(refs), len(negs)))

        def distances(at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            d = np.array(metric(v[at], matrix), dtype=np.float64)
            d[np.flatnonzero(own[at] >= 0), own[at][own[at] >= 0]] = np.nan
            if not negs:
                return d, None
            e = np.array(metric(v[at], away), dtype=np.float64)
            e[~pool[at]] = np.nan
            return d, e

        alone = given & (times == 1)
        near = np.zeros(len(codes), bool)
        if getattr(metric, "triangle", False) and refs and np.isfinite(matrix).all() and (not negs or np.isfinite(away).all()):
            near = alone & np.isfinite(v).all(1)
            at = np.flatnonzero(near)
            scores[at] = _middle_of(v[at], matrix, own[at], metric)
            at = np.flatnonzero(near & pool)
            if negs:
                lows[at] = _ranked(v[at], away, 0, 0, metric)[:, 0]
        rest = np.flatnonzero(alone & ~near)
        for k in range(0, len(rest), step):
            at = rest[k : k + step]
            d, e = distances(at)
            scores[at] = _middle(d)
            if negs:
                lows[at] = np.fmin.reduce(e, axis=1)
        shared = np.flatnonzero(given & (times > 1))
        shared = shared[np.argsort(codes[shared], kind="stable")]
        for at in np.split(shared, np.flatnonzero(np.diff(codes[shared])) + 1) if len(shared) else ():
            d, e = distances(at)
            scores[at] = _middle(d.reshape(1, -1))[0]
            if negs:
                lows[at] = np.fmin.reduce(np.fmin.reduce(e, axis=1))
        null = lambda x: pa.array(x, pa.float64(), from_pandas=True)
        found = rows.select(["id", "role", *carry]).append_column("score", null(scores)).append_column("neg_score", null(lows))
        return found if (times == 1).all() else found.take(pa.array(np.repeat(np.arange(len(times)), times)))

    return run


def ref_scores(features: DataFrame, metric: Metric = cosine, size: int = BLOCK, carry: tuple[str, ...] = (), gather: int = GATHER,
               resident: int = RESIDENT) -> DataFrame:
    """id, role, carried columns, score = median distance to the references, neg_score = smallest distance to a negative.

    References are compared with the *other* references; without references every score is null. ``features``: id, role (pool, ref or neg),
    embedding. References of up to ``resident`` bytes go to every group of rows, which settles its rows some at a time; with a metric marked
    ``triangle`` by boxes of rows, each of which leaves most references out. Of more, blocks of about
    ``size`` references meet tiles of rows, and no task holds more than one of each. The median is then exact without
    an array of all distances: while more than ``gather`` of a record's distances may be the median, a pass counts them by value range and keeps
    the range that holds the middle ranks; then the few that are left travel and are sorted. Equal distances end a range at once.
    """
    id_type = pa.string() if features.schema["id"].dataType.simpleString() == "string" else pa.int64()
    kept, id_sql = features.where(F.col("role") != "neg"), features.schema["id"].dataType.simpleString()
    marked = features.where((F.col("role") != "pool") & F.col("embedding").isNotNull())
    counted = features.groupBy("role").agg(F.count("*").alias("all"), F.count("embedding").alias("n"), F.max(F.size("embedding")).alias("width")).collect()  # a few roles
    sizes = {r["role"]: r["n"] for r in counted if r["role"] is not None and r["role"] != "pool" and r["n"]}
    null = F.lit(None).cast("double")
    if not sizes.get("ref"):
        return kept.select("id", "role", *carry, null.alias("score"), null.alias("neg_score"))
    blocks = -(-max(sizes.values()) // size)
    numbered = marked.select("id", "role", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    heads = cut_lineage(numbered.groupBy("role", "block").applyInArrow(_reference_block, f"role string, block int, heads array<{id_sql}>, matrix binary"))
    heads = heads.withColumnRenamed("role", "head_role")
    some = [r for r in counted if r["role"] is not None and r["role"] != "neg"]
    all_rows, width = sum(r["all"] for r in some), max((r["width"] or 0 for r in some), default=0)
    if sum(sizes.values()) * width * 8 <= resident:
        spread = min(4 * features.sparkSession.sparkContext.defaultParallelism, all_rows * sum(sizes.values()) // SPREAD)
        groups = max(1, spread, all_rows * width * 8 // HELD)
        rows = kept.select("id", "role", *carry, "embedding", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")).repartition(groups, "g")
        every = heads.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")
        kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in ("id", "role", *carry))
        return rows.groupBy("g").cogroup(every.groupBy("g")).applyInArrow(_whole(metric, carry), f"{kinds}, score double, neg_score double")
    refs = heads.where("head_role = 'ref'")
    all_values = [F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")]
    state = kept.select("id", "role", "embedding", *all_values, F.lit(sizes["ref"]).cast("long").alias("left"), F.lit(None).cast("long").alias("k1"),
                        F.lit(None).cast("long").alias("k2"), null.alias("v1"), null.alias("v2"))
    most = sizes["ref"]
    while most > gather:
        wide = state.where((F.col("left") > gather) & (F.col("v1").isNull() | F.col("v2").isNull()))
        parts = _tiles(wide, refs, blocks).mapInArrow(_binned(metric, id_type), f"id {id_sql}, part long, n long, low double, high double") \
            .groupBy("id", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        state = cut_lineage(_narrowed(state, parts, gather))
        most = state.where(F.col("v1").isNull() | F.col("v2").isNull()).agg(F.max("left")).first()[0] or 0
    open_ = state.withColumn("hi", F.when(F.col("v1").isNotNull() & F.col("v2").isNotNull(), F.lit(float("-inf"))).otherwise(F.col("hi")))  # settled: no values
    found = _tiles(open_, heads, blocks).mapInArrow(_gathered(metric, id_type), f"id {id_sql}, v array<double>, neg double")
    found = found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("v"))).alias("v"), F.min("neg").alias("neg_score"))
    at = lambda k, half: F.get("v", F.coalesce(k, half).cast("int"))
    low = F.coalesce("v1", at(F.col("k1"), F.floor((F.size("v") - 1) / 2)))
    high = F.coalesce("v2", at(F.col("k2"), F.floor(F.size("v") / 2)))
    scores = state.select("id", "k1", "k2", "v1", "v2").join(found, "id").select("id", ((low + high) / 2).alias("score"), "neg_score")
    return _attached(kept, carry, scores)


def _attached(kept: DataFrame, carry: tuple[str, ...], scores: DataFrame) -> DataFrame:
    return kept.select("id", "role", *carry).join(scores, "id", "left")


def _narrowed(state: DataFrame, parts: DataFrame, gather: int) -> DataFrame:
    """The state after a pass: the middle ranks k1 and k2 among the values left, the range that holds them, or their values."""
    order = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    ranked = parts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("id")))
    ranked = ranked.join(state.select("id", "k1", "k2"), "id").withColumns({
        "k1": F.coalesce("k1", F.floor((F.col("total") - 1) / 2)), "k2": F.coalesce("k2", F.floor(F.col("total") / 2))})
    inside = lambda k: (F.col(k) >= F.col("before")) & (F.col(k) < F.col("before") + F.col("n"))
    known = lambda k: F.when(inside(k), F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col(k) == F.col("before"), F.col("low"))
                             .when(F.col(k) == F.col("before") + F.col("n") - 1, F.col("high")))
    hit = ranked.where(inside("k1") | inside("k2")).withColumns({"v1": known("k1"), "v2": known("k2")})
    still = F.when((inside("k1") & F.col("v1").isNull()) | (inside("k2") & F.col("v2").isNull()), F.struct("low", "high", "n", "before"))
    best = hit.withColumn("range", still).groupBy("id").agg(F.max("v1").alias("w1"), F.max("v2").alias("w2"), F.max("range").alias("range"),
                                                           F.max("k1").alias("j1"), F.max("k2").alias("j2"))
    off = F.coalesce("range.before", F.lit(0))
    none = F.col("j1").isNull() & F.col("v1").isNull() & (F.col("left") > gather)  # no distance at all
    return state.join(best, "id", "left").select(
        "id", "role", "embedding", F.coalesce("range.low", "lo").alias("lo"), F.coalesce("range.high", "hi").alias("hi"), F.when(none, 0).otherwise(F.coalesce("range.n", "left")).alias("left"),
        F.coalesce(F.col("j1") - off, "k1").alias("k1"), F.coalesce(F.col("j2") - off, "k2").alias("k2"), F.coalesce("v1", "w1").alias("v1"), F.coalesce("v2", "w2").alias("v2"))
