"""Toxicity by a subsequence string kernel and a support vector machine.

Two words are alike as far as they share subsequences of ORDER letters, each weighed by DECAY to the power of the stretch that it spans, so that
gaps and inserted characters cost a little and change nothing else. The kernel is divided by the norms of both words. Words are mapped to
the space of LANDMARKS words (Nyström), where a linear support vector machine is trained. A text is split into sentences and words; the margin
of a sentence is that of its worst word, the margin of a text that of its worst sentence.

Labels are those of whole texts, so words have to explain them: every word is an example of each kind of text that it occurs in, as often as it
does. Words that tell much, common words and words drawn by a hash are learned from; after a fit, those words of clean texts that come
nearest to the toxic ones are added, and the machine is trained again. The kernel of a word and all landmarks
is a sum over the subsequences of the word, read from a table of those of the landmarks.

Defined cases: null, empty or without letters: score 0. Labels of one kind only: all scores are 0. Characters between the letters of a word
(i.d.i.o.t) and spaces between single letters are removed before comparing. Words longer than LONGEST letters are compared piece by piece,
pieces overlapping by half. Equal texts have equal scores. At most about SAMPLES texts of each label are learned from, chosen by a hash of the text;
the cut is that of fewest errors over all labelled texts that may be learned from, at their own shares, whatever their number.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, forget, in_batches, portions, stash
from .quality import sample

ORDER = 3
DECAY = 0.6
POWER = 3
BIN = 1 / 1024  # width of the margins that are counted together to find the cut
LANDMARKS = 128
WORDS = 4000  # words learned from in each round, at most: half of them those that tell most for toxic texts
RIDGE = 3e-4
LONGEST = 24
CUT = 0.7
MEMO = 800_000
WORST = 2  # words whose mean margin is that of a text
LETTERS = 36  # letters are told apart up to this many, a-z and what others are dealt to
_STEP = 1024  # words compared at a time
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,2}){2,}[^\W\d_](?!\w)")
_INNER = re.compile(r"[\W_]+")
_worker: dict = {}


def code(word: str) -> np.ndarray:
    """Letters as numbers from 1; a-z keep their own, others share the rest."""
    points = np.frombuffer(word.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points * 2654435761 % (LETTERS - 28))


def words(text: str | None) -> list[list[str]]:
    """Words of each sentence, in lower case, without marks inside, and with a mark for their beginning; single letters in a row are one word."""
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        spelled = [_INNER.sub("", m) for m in _SPELLED.findall(sentence) if any(c.isspace() for c in m)]
        out.append(["^" + w for w in (_INNER.sub("", p) if not p.isalpha() else p for p in sentence.split()) if w] + ["^" + w for w in spelled])
    return out


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """All choices of ORDER places of a word of ``size`` letters and their weights."""
    if size not in _worker:
        i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(size)] * 3, indexing="ij"))
        rising = (i < j) & (j < k)
        _worker[size] = np.stack([i, j, k])[:, rising], DECAY ** (k - i + 1.0)[rising]
    return _worker[size]


def _spread(group: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subsequences of words of one size, by word, and their weights."""
    at, weight = _places(size)
    letters = code("".join(group)).reshape(len(group), size)
    return (letters[:, at[0]] * LETTERS + letters[:, at[1]]) * LETTERS + letters[:, at[2]], weight


def _by_size(given: list[str]) -> Iterator[tuple[list[int], list[str], int]]:
    sizes: dict[int, list[int]] = {}
    for i, w in enumerate(given):
        sizes.setdefault(len(w), []).append(i)
    for size, found in sizes.items():
        for start in range(0, len(found), _STEP):
            yield found[start:start + _STEP], [given[i] for i in found[start:start + _STEP]], size


def norms(letters: np.ndarray) -> np.ndarray:
    """Kernel norm of each row of letters, by dynamic programming over all rows at once."""
    count, size = letters.shape
    same = letters[:, :, None] == letters[:, None, :]
    inner = np.ones((size + 1, size + 1, count))
    for _ in range(ORDER - 1):
        outer = np.zeros((size + 1, size + 1, count))
        for a in range(1, size + 1):
            run = np.zeros(count)
            for b in range(1, size + 1):
                run = DECAY * run + DECAY**2 * same[:, a - 1, b - 1] * inner[a - 1, b - 1]
                outer[a, b] = DECAY * outer[a - 1, b] + run
        inner = outer
    return np.sqrt(DECAY**2 * np.einsum("nab,abn->n", same.astype(np.float64), inner[:-1, :-1]))


def embedded(given: list[str]) -> np.ndarray:
    """Weighted subsequences of a bounded list of words as dense rows; rows of words shorter than ORDER are zero."""
    out = np.zeros((len(given), LETTERS**3), np.float32)
    for places, group, size in _by_size(given):
        if size >= ORDER:
            numbers, weight = _spread(group, size)
            np.add.at(out, (np.array(places)[:, None], numbers), weight.astype(np.float32))
    scale = np.sqrt((out**2).sum(axis=1))
    out /= np.where(scale > 0, scale, 1)[:, None]
    return out


def similar(given: list[str], columns: np.ndarray) -> np.ndarray:
    """Kernel of words to the landmarks whose rows of ``embedded`` are the given columns, to the power of POWER, which is a kernel as well and
    tells near words from nearer ones."""
    out = np.zeros((len(given), columns.shape[1]), np.float32)
    for places, group, size in _by_size(given):
        if size >= ORDER:
            numbers, weight = _spread(group, size)
            found = np.stack([weight.astype(np.float32) @ columns[row] for row in numbers])
            out[places] = found / norms(code("".join(group)).reshape(len(group), size))[:, None]
    return out**POWER


@cache
def _columns(marks: tuple[str, ...]) -> np.ndarray:
    """Subsequences by landmarks."""
    return np.ascontiguousarray(embedded(list(marks)).T)


@dataclass
class Model:
    marks: list[str]  # the landmarks
    weights: np.ndarray
    bias: float
    slope: float

    def margins(self, given: list[str]) -> np.ndarray:
        """Value of the machine at each word."""
        return similar(given, _columns(tuple(self.marks))).astype(np.float64) @ self.weights + self.bias


def fit(given: list[str], bad: np.ndarray, clean: np.ndarray, seed: int = 0) -> Model:
    """Support vector machine of words, all at most LONGEST letters, by the number of toxic and of clean texts that each occurs in: squared
    hinge loss, minimised by Newton's method. Half of the landmarks are the words that tell most for toxic texts."""
    rest = np.random.default_rng(seed).permutation(np.arange(LANDMARKS // 2, max(LANDMARKS // 2, len(given))))
    order = np.argsort(-_surplus(bad, clean), kind="stable")
    marks = [given[i] for i in [*order[:LANDMARKS // 2], *order[rest[:LANDMARKS // 2]]]]
    base = embedded(marks)
    values, vectors = np.linalg.eigh((base.astype(np.float64) @ base.T) ** POWER)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström map of kernel values
    rows = similar(given, _columns(tuple(marks))).astype(np.float64) @ root
    x = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    x, y, cost = np.concatenate([x, x]), np.repeat([1.0, -1.0], len(x)), np.concatenate([bad / max(1, bad.sum()), clean / max(1, clean.sum())])
    x, y, cost = x[cost > 0], y[cost > 0], cost[cost > 0]
    ridge = np.eye(x.shape[1]) * RIDGE
    ridge[-1, -1] = 1e-8
    w = np.zeros(x.shape[1])
    for _ in range(30):
        slack = np.maximum(0, 1 - y * (x @ w))
        on = slack > 0
        step = np.linalg.solve((x[on] * cost[on, None]).T @ x[on] + ridge, ridge @ w - x[on].T @ (cost[on] * y[on] * slack[on]))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(marks, root @ w[:-1], float(w[-1]), 6.0)


def _surplus(bad: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-likelihood gained by a word's own share of toxic texts over the common one; negative where the share is lower."""
    share = bad.sum() / max(1.0, bad.sum() + clean.sum())
    n = bad + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(bad > 0, bad * np.log(bad / (n * share)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0)
    return np.where(bad > n * share, gain, -gain)


def _word_rows(texts: DataFrame) -> DataFrame:
    """(word, label) once for each word of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = sorted({p for s in words(text) for w in s for p in pieces(w) if len(p) >= ORDER})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["word", "label"])

    return in_batches(texts, run, "word string, label int")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    """From rows with doc_id and text, and a table of labels by doc_id; None if there are not both kinds. What reaches the driver are at most 3 * WORDS words."""
    chosen = sample(docs.select("doc_id", F.xxhash64("text").alias("h")), labels, label)  # about 2 * SAMPLES ids
    sampled = stash(docs.join(F.broadcast(chosen), "doc_id").select("text", "label"))
    totals = {r["label"]: r["n"] for r in sampled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {0, 1}:
        return None
    share = totals[1] / (totals[0] + totals[1])
    seen = stash(_word_rows(sampled).groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("all")))
    clean = F.col("all") - F.col("bad")
    surplus = F.when(F.col("bad") > F.col("all") * share, F.col("bad") * F.log(F.col("bad") / (F.col("all") * share)) + F.when(clean > 0, clean * F.log(clean / (F.col("all") * (1 - share)))).otherwise(0))
    telling = seen.withColumn("g", surplus).where("g is not null").orderBy(F.desc("g"), "word").limit(WORDS // 2)
    others = seen.orderBy(F.xxhash64("word"), "word").limit(WORDS // 2)
    known = {r["word"]: (r["bad"], r["all"]) for rows in (telling, others, seen.orderBy(F.desc("all"), "word").limit(WORDS // 4)) for r in rows.collect()}
    for round_ in range(3):
        given = sorted(known)
        counts = np.array([known[w] for w in given], np.float64).reshape(-1, 2)
        model = fit(given, counts[:, 0], counts[:, 1] - counts[:, 0])
        if round_ < 2:
            near = _with_margins(seen.where("bad < all"), model).orderBy(F.desc("margin"), "word").limit(WORDS // 2)
            known |= {r["word"]: (r["bad"], r["all"]) for r in near.collect()}
    forget(seen)
    forget(sampled)
    return model


def cut(margins: DataFrame, labels: DataFrame, label: str = "toxic") -> float:
    """Where the labelled ones of rows with doc_id and ``margin``, all of them, are told apart with fewest errors, in the middle of the gap there.
    What reaches the driver are counts of each BIN of margins."""
    known = margins.join(labels.select("doc_id", F.col(label).cast("int").alias("label")), "doc_id").where("label IN (0, 1) AND margin > double('-Infinity')")
    bins = known.groupBy(F.floor(F.col("margin") / BIN).alias("bin")).agg(
        F.min("margin").alias("low"), F.max("margin").alias("high"), F.sum("label").alias("bad"), F.count("*").alias("all")).orderBy("bin").collect()
    low, high, bad, all_ = np.array([tuple(r)[1:] for r in bins], np.float64).reshape(-1, 4).T
    if not len(low):
        return 0.0
    clean = all_ - bad
    errors = np.concatenate([[0], np.cumsum(bad)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    best = np.flatnonzero(errors == errors.min())
    i = int(best[len(best) // 2])
    return float(high[i - 1] + low[i]) / 2 if 0 < i < len(low) else float(low[0]) if not i else float(np.nextafter(high[-1] + BIN, np.inf))


def _with_margins(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = pa.array(model.margins(batch.column("word").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, margins], ["word", "bad", "all", "margin"])

    return in_batches(rows.select("word", "bad", "all"), run, "word string, bad long, all long, margin double")


class Judge:
    """Margins of texts in one worker; margins of words that were met lately are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.recent = Recent(lambda given: [m.tobytes() for m in self._margins(given)], MEMO)

    def _margins(self, given: list[str]) -> np.ndarray:
        parts = [pieces(w) for w in given]
        flat = self.model.margins([p for some in parts for p in some])
        return np.maximum.reduceat(flat, np.cumsum([0, *map(len, parts)])[:-1]) if given else flat

    def __call__(self, texts: list[str]) -> list[float]:
        out = []
        for some in portions(texts):
            rows = [[w for s in words(t) for w in s if len(w) >= ORDER] for t in some]
            for found in self.recent.joined(rows):
                margins = np.frombuffer(found, np.float64)
                out.append(float(np.sort(margins)[-WORST:].mean()) if len(margins) else -np.inf)
        return out


def measured(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The kept columns of all rows, with ``margin``, negative infinity without a word."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model) if model else None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            margins = judge(texts) if judge else [-np.inf] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(margins, pa.float64())], ["row", "margin"])

    done = in_batches(kept, run, f"row {kept.schema['row'].dataType.simpleString()}, margin double")
    return done.select(*[F.col(f"row.`{c}`") for c in keep], "margin")


def scored(margins: DataFrame, model: Model | None, shift: float) -> DataFrame:
    """The rows with ``score``, which is CUT at the margin ``shift`` and 0 without a word."""
    distance = (F.col("margin") - shift) * (model.slope if model else 0.0) + float(np.log(CUT / (1 - CUT)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), distance))))
    return margins.withColumn("score", F.when(F.col("margin") > float("-inf"), score).otherwise(0.0))
