"""Quality by Bradley-Terry pairwise ranking.

A text has FEATURES, all shares and logarithms. Every labelled text is paired with texts of the other label (one of label 1 over one of label 0), and
the weights are those that make the better text win: the logistic loss of feature differences, minimised by Newton's method with sums made in tasks. A text's strength is its
weighted sum of features. The threshold is the quantile of strengths that leaves the known share of label 0 below it; scores are logistic in
the distance to it and are CUT there.

Defined cases: null, empty and white-space texts: the features of the empty text. One label missing, or no labels: all scores are CUT, as nothing
was learned. Equal texts have equal scores. All labelled texts are learned from, and the cut is that of all of them. Long texts are read whole.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import forget, in_batches, stash

SAMPLES = 6000
PARTNERS = 64  # texts of the rarer label in a bucket, about
CELLS = 1 << 20  # pairs looked at together
CUT = 0.7
RIDGE = 1e-3
FEATURES = ("words", "letters", "upper", "marks", "marked_words", "lone_marks", "repeats", "distinct", "compressed", "lines", "word_length", "digits",
            "halves", "few")
_KIND = np.zeros(256, np.uint8)  # 1 space, 2 letter, 3 capital, 4 digit, 5 other mark, 6 stop
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b == 32 or 9 <= _b <= 13 else 3 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" or _b > 127 else 4 if _c.isdigit() else 6 if _c in ".,;:!?'\"-()" else 5


def features(text: str | None) -> list[float]:
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = text.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    space, low, upper, digits, marks, stops = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)[1:].tolist()
    letters = low + upper
    ends = [w[-1] for w in words]
    marked = sum(not c.isalnum() and c not in ".,;:?'\")-" for c in ends)
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    half = n // 2
    return [
        np.log1p(n), letters / size, upper / max(1, letters), np.sqrt(marks / size), np.sqrt(marked / n), np.sqrt(lone / n), np.sqrt(repeats / n),
        len(set(words)) / n ** 0.9, len(zlib.compress(data, 1)) / size, 1 - len(set(lines)) / len(lines), np.log(letters / n + 1), np.sqrt(digits / size),
        len(set(words[:half]) & set(words[half:])) / max(1, half), 1.0 / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = _clipped(rows, self.mean, self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin + np.log(CUT / (1 - CUT)), -40, 40)))


def sample(keyed: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of about SAMPLES rows of each value of ``label``, or all, by the hash ``h`` of the text. ``keyed`` has doc_id and h: no
    text is shuffled to choose."""
    rows = keyed.select("doc_id", "h").join(labels.select("doc_id", F.col(label).cast("int").alias("label")), "doc_id").where("label IN (0, 1)")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("label") == value) & (place < min(1.0, SAMPLES / n)))
    return rows.where(keep).select("doc_id", "label").distinct()


def measured(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``features`` of the column ``text``."""
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.list_(pa.float64()))], ["row", "features"])

    done = in_batches(kept, run, f"row {kept.schema['row'].dataType.simpleString()}, features array<double>")
    return done.select(*[F.col(f"row.`{c}`") for c in keep], "features")


def _clipped(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((rows - mean) / scale, -8, 8)


def _slopes(good: np.ndarray, bad: np.ndarray, many: np.ndarray, few: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of all pairs of good over bad rows, which stand for ``many`` and ``few`` texts: how many, gradient and curvature of the loss, as one line. No
    pair is listed: both follow from the matrix of chances that the worse text wins."""
    width = len(weights)
    n, gradient, curve = 0.0, np.zeros(width), np.zeros((width, width))
    step = max(1, CELLS // max(1, len(bad)))
    for k in range(0, len(good), step):
        g, m = good[k:k + step], many[k:k + step, None] * few[None, :]
        p = 1 / (1 + np.exp(np.clip((g @ weights)[:, None] - (bad @ weights)[None, :], -40, 40)))
        q = m * p * (1 - p)
        p *= m
        cross = g.T @ q @ bad
        n += m.sum()
        gradient -= g.T @ p.sum(1) - bad.T @ p.sum(0)
        curve += (g * q.sum(1)[:, None]).T @ g + (bad * q.sum(0)[:, None]).T @ bad - cross - cross.T
    return np.concatenate([[n], gradient, curve.ravel()])


def _newton(slopes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights at which the loss, whose ``slopes`` are given as by ``_slopes``, is least."""
    width = len(FEATURES)
    weights = np.zeros(width)
    for _ in range(40):
        found = slopes(weights)
        n = max(found[0], 1.0)
        gradient = found[1:width + 1] / n + RIDGE * weights
        curve = found[width + 1:].reshape(width, width) / n + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _nothing() -> Model:
    width = len(FEATURES)
    return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Weights from all preference pairs of a few rows, of label 1 over label 0; ``learn`` does it for a table."""
    good, bad = rows[labels == 1], rows[labels == 0]
    if not len(good) or not len(bad):
        return _nothing()
    both = np.concatenate([good, bad])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    good, bad = _clipped(good, mean, scale), _clipped(bad, mean, scale)
    weights = _newton(lambda w: _slopes(good, bad, np.ones(len(good)), np.ones(len(bad)), w))
    truth = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    return Model(mean, scale, weights, _quantile(np.concatenate([good @ weights, bad @ weights]), truth))


def _quantile(strengths: np.ndarray, truth: np.ndarray) -> float:
    """The quantile of strengths, near the share of label 0, that balances both kinds of error best, in the middle of its gap."""
    order = np.argsort(strengths, kind="stable")
    s, t = strengths[order], truth[order]
    lost = np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())  # of label 1, below the cut
    kept = 1 - np.concatenate([[0], np.cumsum(1 - t)]) / max(1, (1 - t).sum())  # of label 0, above it
    wrong = lost + kept
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    low, high = best[0], best[-1]
    edge = lambda i: s[min(max(i, 0), len(s) - 1)]
    return float(edge(low - 1) + edge(high)) / 2


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Label, how many texts, and features of the rows of each batch."""
    for b in batches:
        yield b.column("label").to_numpy(), b.column("n").to_numpy().astype(float), b.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))


def _totals(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Sum of the lines that ``of`` gives for the batches of each task: one line for each task travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = list(of(batches))
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(lines, axis=0)], pa.list_(pa.float64()))], ["line"])

    return np.sum([r["line"] for r in in_batches(rows, run, "line array<double>").collect()], axis=0)


def _bucket(table: pa.Table) -> pa.Table:
    """The rows of a bucket as one row."""
    (label, n, x), = _parts([table.combine_chunks().to_batches()[0]])
    return pa.table([pa.array([v.astype(np.float64).tobytes()], pa.binary()) for v in (x[label == 1], x[label == 0], n[label == 1], n[label == 0])], names=["good", "bad", "many", "few"])


def _errors(batches: Iterator[pa.RecordBatch], before: dict[int, tuple[float, float, float]], ones: float, zeros: float) -> Iterator[pa.RecordBatch]:
    """The least error of the cuts below each strength of a range, with the strengths around the first and the last such cut."""
    part = TaskContext.get().partitionId()
    if part not in before:
        return
    lost, gone, last = before[part]
    best = (np.inf, 0.0, 0.0)
    for b in batches:
        s, good, bad = (b.column(c).to_numpy().astype(float) for c in ("s", "ones", "zeros"))
        if not len(s):
            continue
        wrong = (lost + np.cumsum(good) - good) / ones + 1 - (gone + np.cumsum(bad) - bad) / zeros
        at = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        below = np.append(last, s[:-1])
        if wrong[at[0]] < best[0] - 1e-12:
            best = (wrong[at[0]], below[at[0]], s[at[-1]])
        elif wrong[at[0]] <= best[0] + 1e-12:
            best = (best[0], best[1], s[at[-1]])
        lost, gone, last = lost + good.sum(), gone + bad.sum(), s[-1]
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in best], ["wrong", "low", "high"])


def _cut(strengths: DataFrame) -> float:
    """As ``_quantile``, over rows (s, label, n) of any number: ranges of strengths are counted, then each looks at its own cuts."""
    counts = strengths.groupBy("s").agg(F.sum(F.col("n") * F.col("label")).alias("ones"), F.sum(F.col("n") * (1 - F.col("label"))).alias("zeros"))
    parts = int(strengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut_lineage(counts.repartitionByRange(parts, "s").sortWithinPartitions("s"))
    each = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.min("s").alias("low"), F.max("s").alias("high"))
    each = sorted(each.collect(), key=lambda r: r["part"])  # one row for each range
    before, ones, zeros, last = {}, 0.0, 0.0, each[0]["low"]
    for r in each:
        before[r["part"]] = ones, zeros, last
        ones, zeros, last = ones + r["ones"], zeros + r["zeros"], r["high"]
    found = ranges.mapInArrow(lambda b: _errors(b, before, ones, zeros), "wrong double, low double, high double").collect() + [(1.0, last, last)]  # all below the cut
    least = min(r[0] for r in found)
    best = [r for r in found if r[0] <= least + 1e-12]
    return (min(r[1] for r in best) + max(r[2] for r in best)) / 2


def learn(features: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """From all rows with doc_id, ``h`` and ``features``, and a table of labels by doc_id.

    Equal texts of one label become one row with a count. Rows are dealt into buckets by the hash of their text, so that a bucket holds about
    PARTNERS texts of the rarer label, and every text is compared with all texts of the other label in its bucket. What reaches the driver: sums of each task.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    rows = stash(features.join(known, "doc_id").groupBy("h", "label").agg(F.first("features").alias("features"), F.count("*").alias("n")))
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return _nothing()
    width = len(FEATURES)
    plain = rows.select("label", "n", "features")
    sums = _totals(plain, lambda batches: (np.append(n @ x, n.sum()) for _, n, x in _parts(batches)))
    mean = sums[:width] / sums[width]
    scale = np.sqrt(_totals(plain, lambda batches: (n @ (x - mean) ** 2 for _, n, x in _parts(batches))) / sums[width]) + 1e-6
    buckets = max(1, min(kinds.values()) // PARTNERS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit("bucket")), F.lit(buckets)))
    packed = stash(dealt.groupBy("bucket").applyInArrow(_bucket, "good binary, bad binary, many binary, few binary"))

    def slopes(weights: np.ndarray) -> np.ndarray:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                for r in b.to_pylist():
                    good, bad = (_clipped(np.frombuffer(r[c]).reshape(-1, width), mean, scale) for c in ("good", "bad"))
                    yield _slopes(good, bad, np.frombuffer(r["many"]), np.frombuffer(r["few"]), weights)

        return _totals(packed, of)

    weights = _newton(slopes)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (_, _, x), = _parts([b])
            yield pa.RecordBatch.from_arrays([pa.array(_clipped(x, mean, scale) @ weights), b.column("label"), b.column("n")], ["s", "label", "n"])

    model = Model(mean, scale, weights, _cut(in_batches(plain, strengths, "s double, label int, n long")))
    forget(packed)
    forget(rows)
    return model


def score(features: DataFrame, model: Model) -> DataFrame:
    """All rows of a frame with ``features``, which become ``score``."""
    keep = [c for c in features.columns if c != "features"]
    kept = features.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)], ["row", "score"])

    done = in_batches(kept, run, f"row {kept.schema['row'].dataType.simpleString()}, score double")
    return done.select(*[F.col(f"row.`{c}`") for c in keep], "score")
