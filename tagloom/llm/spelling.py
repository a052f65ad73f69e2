"""Spelling variants: words that differ by one letter, found in a trie of letter-group counts.

Letters fall into eight groups, and a word is the vector of how many letters it has of each. One inserted, deleted or replaced letter changes the
vector by at most one more in one group and one less in one group. The words are arranged in a trie whose levels are the counts of the successive
groups; a word is looked up by a depth-first search that may take one step too high (surplus) and one too low (deficit) on its way down, and the
words of the leaves that it reaches are verified letter by letter.

The trie is shared out: nodes with many words are open, the first node on a way down that is not open is a seat, and a seat's words form the lower
trie in one task. Which nodes are open is a bounded table; every word visits the seats that its budget lets it reach. A seat with many visitors
serves them in blocks, and a leaf with many words is cut into tiles. A task gives one row for a visitor, with the number of its near words and the
best of them, so that no pairs leave it.

Defined cases: null text has no words, null doc_id counts as the empty text, equal rows count each, ties of n go to the first word in code-point
order, an empty table gives no rows, and a run of letters may be of any length.
"""
from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_batches, stash

GROUPS = 8  # a letter belongs to the group of its code point modulo GROUPS
MOST = 31  # higher counts share a branch; the budget holds for them too
SEAT = 32768  # words of a seat, and of a tile
NODES = 4096  # open nodes of a level at most: beyond GROUPS * NODES * SEAT words seats grow instead
LETTERS = 5  # code points of a word at least
TIMES = 3  # occurrences of a word at least
LOWER = bytes(b if 97 <= b <= 122 or b >= 192 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))  # Latin-1: A-Z to a-z, no letter to a space


def _tokens(text: str) -> list[bytes]:
    """Runs of letters in Latin-1, in order; a byte is a code point."""
    return text.encode("latin-1", "replace").translate(LOWER).split()


def _counts(typos: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            words = [(w, k) for w, k in seen.items() if len(w) >= LETTERS and k]
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w, _ in words], pa.string()), "n": pa.array([k for _, k in words], pa.int64())})

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                tokens = _tokens(text)
                seen.update(tokens)
                if typos:
                    start, crc = zlib.crc32(b"%s:" % doc.encode()), zlib.crc32
                    for w in [w for w in set(tokens) if not crc(w if w.isascii() else w.decode("latin-1").encode(), start) % typos]:
                        k, at = tokens.count(w), crc(w.decode("latin-1").encode(), start) % len(w)
                        seen[w] -= k
                        seen[w[:at] + w[at + 1 :]] += k
                if len(seen) > 200_000:
                    yield flushed()
        yield flushed()

    return run


def counted(docs: DataFrame, typos: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, of at least five code points and three occurrences in all texts. ``typos`` plants
    errors: where it divides the crc32 h of ``doc_id:run``, the run loses the letter at h modulo its length."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text IS NOT NULL")
    words = in_batches(rows, _counts(typos), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.col("n") >= TIMES) & (F.char_length("word") >= LETTERS))


def vectors(words: list[str]) -> np.ndarray:
    """Letters of each group, one row for a word, at most MOST."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.minimum(np.bincount(row * GROUPS + points % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS), MOST).astype(np.uint8)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the ways of the words of a batch, with their words."""
    for b in batches:
        if b.num_rows:
            seen: Counter = Counter()
            for v, k in Counter(map(bytes, vectors(b.column("word").to_pylist()))).items():
                for depth in range(GROUPS + 1):
                    seen[v[:depth]] += k
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})


def within(vector: bytes, children: dict[bytes, list[int]]) -> list[bytes]:
    """Depth-first search: nodes without children that ``vector`` reaches with at most one step too low (deficit) and one too high (surplus).

    Of two words with different vectors exactly one finds the other: a surplus may follow a deficit but not go before it, and a way down that
    ends with a deficit alone is given up, as the shorter word finds the longer one.
    """
    found, todo = [], [(b"", 1, 1)]
    while todo:
        node, surplus, deficit = todo.pop()
        below = children.get(node)
        if below is None:
            if len(node) < GROUPS or deficit or not surplus:
                found.append(node)
            continue
        own = vector[len(node)]
        for count in below:
            if count == own:
                todo.append((node + bytes((count,)), surplus, deficit))
            elif count == own + 1 and surplus:
                todo.append((node + bytes((count,)), 0, 0))
            elif count == own - 1 and deficit:
                todo.append((node + bytes((count,)), surplus, 0))
    return found


def _visits(children: dict[bytes, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[bytes, list[bytes]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            row, seat, own = [], [], []
            for k, v in enumerate(map(bytes, vectors(b.column("word").to_pylist()))):
                if v not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    home = b""
                    while home in children:
                        home = v[: len(home) + 1]
                    memo[v] = home, within(v, children)
                home, seats = memo[v]
                row += [k] * len(seats)
                seat += seats
                own += [s == home for s in seats]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in b.columns), pa.array(seat, pa.binary()), pa.array(own, pa.bool_())],
                                             [*b.schema.names, "seat", "own"])

    return run


def differ_by_one(a: str, b: str) -> bool:
    """Whether exactly one code point was inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return k < len(a) and a[k + 1 :] == b[k + 1 :]
    return len(a) + 1 == len(b) and a[k:] == b[k + 1 :]


def _near(table: pa.Table) -> pa.Table:
    """Visitors of one block against the words of one tile."""
    words, ns, own = (table.column(c).to_pylist() for c in ("word", "n", "own"))
    children: dict[bytes, set[int]] = defaultdict(set)
    leaves: dict[bytes, dict[int, tuple[dict, dict]]] = defaultdict(dict)  # by length: words by first half and by second half, one of which is intact
    visitors: dict[bytes, list[int]] = defaultdict(list)
    for k, (w, v, here) in enumerate(zip(words, map(bytes, vectors(words)), own)):
        if here:
            if v not in leaves:
                for depth in range(GROUPS):
                    children[v[:depth]].add(v[depth])
            first, second = leaves[v].setdefault(len(w), ({}, {}))
            first.setdefault(w[: len(w) // 2], []).append(k)
            second.setdefault(w[len(w) // 2 :], []).append(k)
        else:
            visitors[v].append(k)
    found: dict[str, list] = {}

    def met(a: str, b: int) -> None:
        held, top = found.get(a), (-ns[b], words[b])
        if held is None:
            found[a] = [1, top]
        else:
            held[0] += 1
            held[1] = min(held[1], top)

    for v, guests in visitors.items() if children else ():
        for leaf in within(v, children):
            for length, (first, second) in leaves[leaf].items():
                h = length // 2
                for k in guests:
                    w = words[k]
                    if not -1 <= length - len(w) <= 1:
                        continue
                    left, right = first.get(w[:h]), second.get(w[len(w) - length + h :])
                    if left is None and right is None:
                        continue
                    near = {c for c in left or () if differ_by_one(w, words[c])}
                    near.update(c for c in right or () if c not in near and differ_by_one(w, words[c]))
                    for c in near:
                        met(w, c)
                        if leaf != v:
                            met(words[c], k)
    cols = list(zip(*((w, n, -top[0], top[1]) for w, (n, top) in found.items()))) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, seat: int = SEAT) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a near word: how many, and the most frequent of them."""
    total = words.count()
    seat = max(seat, -(-total // NODES))
    nodes = words.select("word").mapInArrow(_prefixes, "node binary, n long").groupBy("node").agg(F.sum("n").alias("n"))
    opened = nodes.where((F.col("n") > seat) & (F.length("node") < GROUPS)).select(F.col("node").alias("parent"))  # at most GROUPS * NODES
    below = nodes.where("length(node) > 0").select(F.expr("substring(node, 1, length(node) - 1)").alias("parent"), F.expr("substring(node, length(node), 1)").alias("at"))
    children = {bytes(p): sorted(bytes(c)[0] for c in cs) for p, cs in below.join(opened, "parent").groupBy("parent").agg(F.collect_list("at")).collect()}
    visits = stash(words.mapInArrow(_visits(children), "word string, n long, seat binary, own boolean"))
    sizes = visits.groupBy("seat").agg(F.count("*").alias("visitors"), F.count_if("own").alias("here")).where("here > 0")
    cut = lambda n: F.ceil(F.col(n) / seat).cast("int")
    dealt = visits.join(sizes.select("seat", cut("visitors").alias("blocks"), cut("here").alias("tiles")), "seat")
    at = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    come = dealt.select("word", "n", "seat", F.lit(False).alias("own"), at("blocks").alias("block"), every("tiles").alias("tile"))
    stay = dealt.where("own").select("word", "n", "seat", "own", every("blocks").alias("block"), at("tiles").alias("tile"))
    met = come.unionByName(stay).groupBy("seat", "block", "tile").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("top")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("top.col1")).alias("best_n"), "top.best")


def variants(words: DataFrame, seat: int = SEAT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the form of a word is its most frequent near word, if that is at least twice as frequent; the root
    is the end of the forms. Forms double in n, so a chain is short; roots are found by doubling steps."""
    words = stash(words)
    found = stash(words.join(near_words(words, seat), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("best_n") >= 2 * F.col("n"), F.col(c)).alias(a) for c, a in (("best", "form"), ("best_n", "form_n"))]))
    ways = stash(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stash(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(ways)
        ways = further
        if not ways.where("moved").limit(1).count():
            break
        ways = ways.drop("moved")
    return found.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
