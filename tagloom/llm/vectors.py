"""Near duplicates among embeddings: PCA-ordered, tiled comparison that stops where the cosine can no longer reach the threshold.

Equal vectors become one row with a count first. The others are turned into the axes of their own second moments, strongest first, so that a
few leading coordinates hold as much of every product as can be had. A k-d tree over those coordinates cuts the vectors into cells, crowded
cells are cut into tiles by hash, and two tiles meet in one task unless the boxes of their cells lie too far apart for any pair. In a task
the products of the leading coordinates come first; the rest of a product is at most the product of the two suffix norms (Cauchy-Schwarz), so
almost every pair stops there, and what is left is settled in double precision. The axes and the tree only decide the order of the work: links
are exact whatever they are.

A task gives, for each vector with links, their number and one link to the representative of its group inside the two tiles: never a list of
pairs, so a hot group of near copies costs comparisons but no rows. Vectors that lie in all directions alike (as noise does) have boxes that
exclude little, and the comparisons then grow with the square of the distinct vectors, at some ten nanoseconds for a pair.

Defined cases: a vector that is null, empty, zero, or holds a null or a number that is not finite links with nothing, as does a row without
vec_id; vectors of different lengths never link; equal rows are copies of each other and link; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stash
from .graph import components

THRESHOLD = 0.95
TILE = 8192  # vectors of one tile; a task holds two
CELLS = 1024  # cells of the tree at most, which bounds what the driver sees of them
SAMPLE = 16384  # vectors whose leading coordinates shape the tree
AXES = 8  # leading coordinates of the tree and its boxes
LEAD = 16  # coordinates of the first products
WIDE = 512  # longer vectors are ordered by the weight of their own coordinates, without turning them
SLACK = 1e-4  # above any rounding of products in single precision
NODE = "struct<id:bigint,h:bigint,g:bigint>"


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _units(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors in double precision. Each is scaled by a power of two first, so that no square overflows."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(rows.flatten(), dtype=np.float64).reshape(-1, d)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _moments(d: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d if wide else d * d)
        for b in batches:
            if b.num_rows:
                u = _units(b.column(0), d)
                total += (u * u).sum(0) if wide else (u.T @ u).ravel()
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int64), "v": total})

    return run


def axes(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthogonal axes as columns, strongest first, from the second moments of all ``vectors`` of length d."""
    wide = d > WIDE
    sums = vectors.mapInArrow(_moments(d, wide), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # d, or d x d numbers
    m = np.zeros(d if wide else d * d)
    m[sums["at"]] = sums["v"]
    if wide:
        return np.eye(d)[:, np.argsort(-m, kind="stable")]
    m = m.reshape(d, d)
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


def _tree(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of every inner node, level by level, each at the median of its widest axis."""
    axis, cut, held = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1), {0: points}
    for node in range(2**levels - 1):
        p = held.pop(node)
        if len(p):
            axis[node] = p.std(0).argmax()
            cut[node] = np.median(p[:, axis[node]])
        right = p[:, axis[node]] > cut[node]
        held[2 * node + 1], held[2 * node + 2] = p[~right], p[right]
    return axis, cut


def _seat(tree: tuple[np.ndarray, np.ndarray] | None, basis: np.ndarray, d: int):
    """Adds the cell and the leading coordinates, the norm of the others last. Vectors of another length share 64 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column("d"))
            cell, lead = -1 - sizes.astype(np.int64) % 64, np.zeros((len(sizes), AXES + 1))
            own = np.flatnonzero(sizes == d)
            if len(own):
                x = _units(b.column("v").take(pa.array(own)), d) @ basis
                k = min(AXES, d)
                lead[own, :k] = x[:, :k]
                lead[own, AXES] = np.sqrt((x[:, k:] ** 2).sum(1))
                at = np.zeros(len(own), np.int64)
                if tree is not None:
                    for _ in range(int(np.log2(len(tree[0]) + 1))):
                        at = 2 * at + 1 + (x[np.arange(len(x)), tree[0][at]] > tree[1][at])
                    at -= len(tree[0])
                cell[own] = at
            lists = pa.ListArray.from_arrays(np.arange(0, lead.size + 1, AXES + 1, dtype=np.int32), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), lists], [*b.schema.names, "cell", "lead"])

    return run


def _meetings(boxes, tile: int, threshold: float) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(cell, its tiles, [(partner cell, its tiles)]) with partners of the same or a higher place that may hold a pair."""
    cell, tiles = boxes["cell"].to_numpy(), np.ceil(boxes["n"].to_numpy() / tile).astype(int)
    low, high = (boxes[[f"{side}{k}" for k in range(AXES + 1)]].to_numpy() for side in ("lo", "hi"))
    far = 2 - 2 * threshold + SLACK  # largest squared distance of unit vectors with that cosine
    found = []
    for i in range(len(cell)):
        apart = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i]))
        same = (cell[i:] >= 0) & (cell[i] >= 0) | (cell[i:] == cell[i])
        near = i + np.flatnonzero(((apart**2).sum(1) <= far) & same)
        found.append((int(cell[i]), int(tiles[i]), [(int(cell[j]), int(tiles[j])) for j in near]))
    return found


def _masks(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, step: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, i, j) of linked pairs for blocks of rows of a."""

    def turned(u: np.ndarray, cut: int) -> np.ndarray:
        x = u @ basis
        return np.hstack([x[:, :cut], np.sqrt((x[:, cut:] ** 2).sum(1))[:, None]]).astype(np.float32)

    cut = min(LEAD, a.shape[1])
    more = min(2 * cut, a.shape[1])
    (a1, a2), (b1, b2) = ((turned(u, cut), turned(u, more)) for u in (a, b))  # the suffix norm is one more coordinate: products are bounds
    b1 = np.ascontiguousarray(b1.T)
    floor = np.float32(threshold - SLACK)
    for k in range(0, len(a), step):
        i, j = np.divmod(np.flatnonzero(a1[k : k + step] @ b1 >= floor), len(b))
        if len(i) * 50 > step * len(b):  # a dense block: all its products at once
            i, j = np.nonzero(a[k : k + step] @ b.T >= threshold)
        else:
            keep = np.concatenate([np.einsum("ij,ij->i", a2[k + i[c : c + 65536]], b2[j[c : c + 65536]]) >= floor for c in range(0, len(i), 65536)] or [[]]).astype(bool)
            i, j = i[keep], j[keep]
            keep = np.concatenate([np.einsum("ij,ij->i", a[k + i[c : c + 65536]], b[j[c : c + 65536]]) >= threshold for c in range(0, len(i), 65536)] or [[]]).astype(bool)
            i, j = i[keep], j[keep]
        yield k, i, j


def _compare(basis: np.ndarray, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        axis = basis if len(basis) == d else np.eye(d)
        second = np.asarray(table.column("side").combine_chunks()) == 1
        order = np.argsort(second, kind="stable")
        u = _units(table.column("v").combine_chunks().take(pa.array(order)), d)
        weight = np.asarray(table.column("w").combine_chunks())[order]
        first = int((~second).sum())
        own = first == len(order)  # a tile with itself
        at = 0 if own else first
        links, root = np.zeros(len(order), np.int64), np.arange(len(order))
        for k, i, j in _masks(u[:first], u[at:], axis, threshold):
            if own:
                i, j = i[i + k != j], j[i + k != j]
            i, j = i + k, j + at
            np.add.at(links, i, weight[j])
            if not own:
                np.add.at(links, j, weight[i])
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            for part in np.split(j, starts[1:]) if len(i) else []:
                mine = i[starts[0]]
                starts = starts[1:]
                known = np.append(root[part], root[mine])
                low = known.min()
                for other in np.unique(known[known != low]):
                    root[root == other] = low
        hit = np.flatnonzero(links)
        ids = [np.asarray(table.column(c).combine_chunks())[order] for c in ("id", "h", "g")]
        node = lambda rows: pa.StructArray.from_arrays([pa.array(x[rows]) for x in ids], ["id", "h", "g"])
        return pa.table({"a": node(hit), "b": node(root[hit]), "n": links[hit]})

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id): for every row how many others have a cosine of ``threshold`` or more, and the smallest vec_id that can
    be reached by such links. ``rows``: vec_id, ``vector`` array of float or double; other columns stay behind."""
    spark = rows.sparkSession
    plain = rows.select(F.col("vec_id").cast("long").alias("id"), F.col(vector).alias("v"))
    plain = plain.withColumn("ok", usable("v") & F.col("id").isNotNull())
    marked = plain.select("id", F.when(F.col("ok"), F.xxhash64("v")).alias("h"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("g"))
    distinct = plain.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    nodes = stash(distinct.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"), "w", F.size("v").alias("d"), "v"))
    common = nodes.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    d, n = common[0]
    mine = nodes.where(F.col("d") == d)
    basis = axes(mine.select("v"), d)
    levels = int(np.clip(np.ceil(np.log2(max(1, n / tile))), 0, np.log2(CELLS)))
    tree = None
    if levels:
        some = mine.orderBy(F.xxhash64("h", "g"), "id").select("v").limit(SAMPLE)
        picked = _units(pa.array(some.toPandas()["v"]), d) @ basis[:, :AXES]
        tree = _tree(picked, levels)
    seats = stash(nodes.mapInArrow(_seat(tree, basis, d), nodes.schema.simpleString()[7:-1] + ", cell bigint, lead array<double>"))
    sides = [f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in range(AXES + 1) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = seats.groupBy("cell").agg(F.count("*").alias("n"), *sides).orderBy("cell").toPandas()  # at most CELLS + 64 rows
    mates = _meetings(boxes, tile, threshold)
    meetings = spark.createDataFrame(mates, "ca long, na int, mates array<struct<cb:long,nb:int>>")
    tiles = spark.createDataFrame([(cell, k) for cell, k, _ in mates], "cell long, k int")
    pairs = meetings.select("ca", "na", F.explode("mates").alias("m")).select("ca", "na", "m.cb", "m.nb")
    pairs = pairs.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.where("ca < cb OR ta <= tb").select("ca", "ta", "cb", "tb")
    place = pairs.select("*", F.lit(0).alias("side"), F.col("ca").alias("cell"), F.col("ta").alias("t")).union(
        pairs.where("ca < cb OR ta < tb").select("*", F.lit(1), "cb", "tb"))
    placed = seats.drop("lead").join(tiles, "cell").withColumn("t", F.pmod(F.xxhash64("h", "g"), F.col("k")).cast("int")).drop("k")
    met = placed.join(place, ["cell", "t"]).select("ca", "ta", "cb", "tb", "side", "id", "h", "g", "w", "d", "v")
    found = stash(met.groupBy("ca", "ta", "cb", "tb", "d").applyInArrow(_compare(basis, threshold), f"a {NODE}, b {NODE}, n bigint"))
    forget(seats)
    linked = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.select("a", "b"))
    known = nodes.select(F.struct("id", "h", "g").alias("a"), "w").join(linked, "a", "left").join(roots.withColumnRenamed("node", "a"), "a", "left")
    known = known.select("a.h", "a.g", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("root.id", "a.id").alias("root"))
    return marked.join(known, ["h", "g"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                                                         F.coalesce("root", "id").alias("component_id"))
