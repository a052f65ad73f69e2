"""Conversations brought back to the form system? (user assistant)+ with the cheapest edits, over a grammar of role and fault sequences.

A conversation is a word over nine symbols: the initial of a role (s, u, a, or x for any other), as a capital letter where the text breaks off,
or d where the row has to go. Such words repeat, so Re-Pair rules are learnt over the words of all conversations: pairs of neighbours are counted
everywhere by Spark, the most frequent become new symbols, and so on. For each symbol there is one min-plus matrix over the four states of the
wanted form (nothing yet, after s, after u, after a): the least cost of its rows from state to state, with the initials of the edits as a rope.
The matrix of a rule is the product of the matrices of its two symbols, evaluated once, bottom-up, and shared by all conversations; a
conversation is the product over its few compressed symbols.

Among equal costs the ASCII-least audit wins. Two audits of equal cost over the same rows are never prefixes of each other (the longer one would
hold more insertions, which cost), so the least audit of a product is made of least audits and the matrix needs only one for each entry.

No conversation is gathered: its rows are numbered by range, cut into blocks, each block gives a matrix, and matrices of neighbouring blocks are
multiplied in a tree of bounded width. The rows of a repaired conversation are an ordered table. Only its digest has to read them one after the
other, in constant memory, as SHA-256 is sequential.

Defined cases: a null role or text counts as one space; rows of the same turn are taken by role, then by the SHA-256 of their text; equal rows
are duplicates of the first; null conv_id is a conversation of its own; an empty table gives no rows; a conversation of one repeated row, of
any length, is that row and deletions.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import positions
from .common import forget, in_batches, stash

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3  # costs of an edit; BROKEN is added for a truncated row that stays
ROLES = {"s": "system", "u": "user", "a": "assistant"}
BLOCK = 1024  # rows of a block
FAN = 64  # blocks multiplied at once
RULES = 24  # rules learnt in one round
ROUNDS = 8
MEMO = 20_000  # words remembered by a task
SPACE = r"[\x20\x09-\x0D]"
STATES = range(4)  # nothing yet, after s, after u, after a
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # state after a role
ENDS = (0, 3)


class Rope:
    """An audit that shares its parts; equal parts are told by hash when two audits are compared."""

    __slots__ = ("size", "hash", "text", "parts")
    LEAF, BASE, PRIME = 32, 1_000_003, (1 << 61) - 1

    def __init__(self, text: str = "", parts: tuple[Rope, Rope] | None = None):
        self.text, self.parts = text, parts
        if parts:
            a, b = parts
            self.size = a.size + b.size
            self.hash = (a.hash * pow(self.BASE, b.size, self.PRIME) + b.hash) % self.PRIME
        else:
            self.size, self.hash = len(text), 0
            for c in text.encode():
                self.hash = (self.hash * self.BASE + c) % self.PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        if self.size + other.size <= self.LEAF:
            return Rope(str(self) + str(other))
        return Rope(parts=(self, other))

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.parts:
                todo += node.parts[::-1]
            else:
                out.append(node.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        left, right = [self], [other]
        while left and right:
            x, y = left.pop(), right.pop()
            if x is y or (x.size == y.size and x.hash == y.hash):
                continue
            if x.parts and (not y.parts or x.size >= y.size):
                left += x.parts[::-1]
                right.append(y)
            elif y.parts:
                right += y.parts[::-1]
                left.append(x)
            else:
                k = min(x.size, y.size)
                if x.text[:k] != y.text[:k]:
                    return x.text[:k] < y.text[:k]
                if x.size > k:
                    left.append(Rope(x.text[k:]))
                if y.size > k:
                    right.append(Rope(y.text[k:]))
        return bool(right)


Matrix = list  # of rows; an entry is None or (cost, Rope)


def _better(a, b):
    if a is None or b is None:
        return a or b
    return b if b[0] < a[0] or (b[0] == a[0] and b[1] < a[1]) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        made = [None] * len(b[0])
        for entry, onward in zip(row, b):
            if entry is not None:
                for q, more in enumerate(onward):
                    if more is not None and (made[q] is None or entry[0] + more[0] <= made[q][0]):
                        made[q] = _better(made[q], (entry[0] + more[0], entry[1] + more[1]))
        out.append(made)
    return out


def _inserts() -> Matrix:
    """Rows put in: nothing, or the shortest way from state to state."""
    m = [[(0, Rope()) if p == q else None for q in STATES] for p in STATES]
    for p in STATES:
        at = p
        for k in (1, 2):
            at = STEP["a" if at == 2 else "u"][at]
            m[p][at] = m[p][at] or (k * INSERT, Rope("I" * k))
    return m


def symbol_matrix(symbol: str) -> Matrix:
    """Rows put in before, then one row with this role and fault."""
    m: Matrix = [[None] * 4 for _ in STATES]
    for p in STATES:
        m[p][p] = (DELETE, Rope("D"))
        if symbol != "d":
            stays = BROKEN if symbol.isupper() else 0
            for role, cost, audit in ((symbol.lower(), KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                q = STEP.get(role, {}).get(p)
                if q is not None:
                    m[p][q] = _better(m[p][q], (cost + stays, Rope(audit)))
    return product(_inserts(), m)


def _rewrite(word: str, rules: list[tuple[str, str]]) -> str:
    for pair, symbol in rules:
        if len(word) < 2:
            break
        word = word.replace(pair, symbol)
    return word


def _pairs(rules: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for word, times in Counter(b.column(0).to_pylist()).items():
                word, last = _rewrite(word, rules), -1
                for k in range(len(word) - 1):
                    if word[k] != word[k + 1] or last != k - 1:  # of aaa only one aa counts
                        seen[word[k : k + 2]] += times
                        last = k if word[k] == word[k + 1] else -1
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return run


def grammar(words: DataFrame, rounds: int = ROUNDS, most: int = RULES) -> list[tuple[str, str]]:
    """Re-Pair rules (pair, symbol) over the column ``word`` of all rows, in the order in which they apply. A round takes the most frequent pairs
    that cannot overlap each other, as counted over every word; at most ``rounds`` * ``most`` rules reach the driver."""
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        counted = words.select("word").mapInArrow(_pairs(rules), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        starts, ends, fresh = set(), set(), []
        for pair, _n in counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(most).collect():
            if pair[0] not in ends and pair[1] not in starts:
                starts.add(pair[0])
                ends.add(pair[1])
                fresh.append((pair, chr(0xE000 + len(rules) + len(fresh))))
        if not fresh:
            break
        rules += fresh
    return rules


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, list[list[tuple[int, str] | None]]]:
    """The matrix of each symbol, that of a rule from those of its two symbols; audits are written out, so that tasks can read them."""
    found = {symbol: symbol_matrix(symbol) for symbol in "suaxSUAXd"}
    for pair, symbol in rules:
        found[symbol] = product(found[pair[0]], found[pair[1]])
    return {symbol: [[e and (e[0], str(e[1])) for e in row] for row in m] for symbol, m in found.items()}


def _roped(m: list) -> Matrix:
    return [[e and (e[0], Rope(e[1])) for e in row] for row in m]


FOUND = "conv_id bigint, blk bigint, costs array<bigint>, audits array<string>"


def _written(keys: list[tuple], found: list[Matrix]) -> pa.RecordBatch:
    flat = [[e for row in m for e in row] for m in found]
    return pa.RecordBatch.from_pydict({
        "conv_id": pa.array([k[0] for k in keys], pa.int64()), "blk": pa.array([k[1] for k in keys], pa.int64()),
        "costs": pa.array([[e and e[0] for e in m] for m in flat], pa.list_(pa.int64())),
        "audits": pa.array([[e and str(e[1]) for e in m] for m in flat], pa.list_(pa.string()))})


def _read(costs: list, audits: list) -> Matrix:
    flat = [None if c is None else (c, Rope(a)) for c, a in zip(costs, audits)]
    return [flat[k : k + 4] for k in range(0, len(flat), 4)]


def _evaluate(rules: list[tuple[str, str]], matrices: dict):
    """Matrices of blocks; of a first block only the row of the state in which every conversation starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ropes, memo = {s: _roped(m) for s, m in matrices.items()}, {}
        for b in batches:
            keys, found = list(zip(b.column("conv_id").to_pylist(), b.column("blk").to_pylist())), []
            for (_, blk), word in zip(keys, b.column("word").to_pylist()):
                m = memo.get((blk == 0, word))
                if m is None:
                    short = _rewrite(word, rules)
                    m = ropes[short[0]][:1] if blk == 0 else ropes[short[0]]
                    for symbol in short[1:]:
                        m = product(m, ropes[symbol])
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[blk == 0, word] = m
                found.append(m)
            yield _written(keys, found)

    return run


def _multiplied(fan: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("blk").to_pylist(), table.column("costs").to_pylist(), table.column("audits").to_pylist()), key=lambda r: r[0])
        m = _read(*rows[0][1:])
        for _, costs, audits in rows[1:]:
            m = product(m, _read(costs, audits))
        return pa.Table.from_batches([_written([(table.column("conv_id")[0].as_py(), rows[0][0] // fan)], [m])])

    return run


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tail = _inserts()
    for b in batches:
        best = []
        for costs, audits in zip(b.column("costs").to_pylist(), b.column("audits").to_pylist()):
            row = product(_read(costs, audits), tail)[0]
            best.append(_better(row[ENDS[0]], row[ENDS[1]]))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([e[0] for e in best], pa.int64()), pa.array([str(e[1]) for e in best], pa.string())],
                                         ["conv_id", "cost", "audit"])


def _parts(block: int):
    """An audit cut at the ends of blocks, with the state in front of each: s still to come, u next or a next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, audit in zip(b.column("conv_id").to_pylist(), b.column("audit").to_pylist()):
                state = "s" if (len(audit) - audit.count("D")) % 2 else "u"  # only a leading s makes an odd number of rows
                start, blk, rows, at = 0, 0, 0, state
                for k, c in enumerate(audit):
                    if c != "I" and rows == block:
                        out.append((conv, blk, audit[start:k], at))
                        start, blk, rows, at = k, blk + 1, 0, state
                    rows += c != "I"
                    if c != "D":
                        state = "a" if state == "u" else "u"
                out.append((conv, blk, audit[start:], at))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                                             ["c", "k", "part", "state"])

    return run


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that come out of a block: those kept or given another role by rid, those put in without."""
    for b in batches:
        out = []
        for conv, rows, part, state in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rows", "part", "state"))):
            at = iter(rows)
            pos, sub = (rows[0]["pos"], 0) if rows else (0, 0)
            for c in part:
                row = None
                if c != "I":
                    row = next(at)
                    pos, sub = row["pos"], 0 if row["pos"] != pos else sub
                if c != "D":
                    out.append((conv, pos, sub, row and row["rid"], None if c == "K" else ROLES[state]))
                    state = "a" if state == "u" else "u"
                sub += 1
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                         ["conv_id", "pos", "sub", "rid", "given"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, read in order across batches."""
    nothing = object()
    conv, state = nothing, None
    for b in batches:
        done = []
        for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
            line = f"{role}:{text}".encode()
            if conv is not nothing and c == conv:
                state.update(b"\n" + line)
            else:
                if conv is not nothing:
                    done.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256(line)
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([x[0] for x in done], pa.int64()), "sha256": pa.array([x[1] for x in done], pa.string())})
    if conv is not nothing:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "sha256": pa.array([state.hexdigest()], pa.string())})


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of conv_id:turn modulo 20: 0 is dropped, 1 loses its text, 2 its stops, 3 stands twice, 4 has role user."""
    blank = F.lit(" ")
    at = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fault = F.crc32(F.concat(at("conv_id"), F.lit(":"), at("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(at("text"), "[.!?]", "")).otherwise(at("text"))
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(at("role")).alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return out.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _same(a: DataFrame, b: DataFrame, *on: tuple[str, str]) -> Column:
    """Equality in which null equals null, so that rows without conv_id meet."""
    out = F.lit(True)
    for x, y in on:
        out = out & a[x].eqNullSafe(b[y])
    return out


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired rows of conversations (conv_id, turn, role, text).

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired rows: conv_id, pos, sub (together their order), role, text.
    """
    held = stash(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                             F.coalesce("text", F.lit(" ")).alias("text")).withColumn("rid", F.monotonically_increasing_id()))
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    light = held.select("conv_id", "turn", "role", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("h"), "rid", (last == "").alias("blank"),
                        (~last.isin(".", "!", "?")).alias("broken"))
    placed = stash(positions(light, ["conv_id"], ["turn", "role", "h", "rid"], "pos"))
    firsts = placed.where("NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(F.min("pos").alias("first"))
    marked = placed.join(firsts, _same(placed, firsts, ("conv_id", "c"), ("role", "r"), ("h", "g")), "left")
    again = ~F.col("blank") & (F.col("pos") > F.col("first"))
    faults = marked.select("conv_id", "pos", "rid", "blank", again.alias("again"), _initial(F.col("role")).alias("initial"),
                           (F.col("broken") & ~F.col("blank") & ~again).alias("broken"))
    symbol = F.when(F.col("blank") | F.col("again"), "d").when(F.col("broken"), F.upper("initial")).otherwise(F.col("initial"))
    number = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    row = F.sort_array(F.collect_list(F.struct("pos", "rid", symbol.alias("symbol"), "initial")))
    blocks = faults.groupBy("conv_id", F.floor((F.col("pos") - 1) / block).cast("long").alias("blk")).agg(
        row.alias("rows"), number("blank"), number("again"), number("broken"))
    joined = lambda c: F.concat_ws("", F.transform("rows", lambda r: r[c]))
    blocks = stash(blocks.select("conv_id", "blk", "blank", "again", "broken", joined("symbol").alias("word"), joined("initial").alias("initials"),
                                 F.transform("rows", lambda r: F.struct(r["pos"], r["rid"])).alias("rows")))
    forget(placed)

    before = F.coalesce(F.lag(F.substring("initials", -1, 1)).over(Window.partitionBy("conv_id").orderBy("blk")), F.lit(""))  # one row for each block
    known = blocks.select("conv_id", "blank", "again", "broken", F.concat(before, "initials").alias("i"))
    legal = sum((F.length("i") - F.length(F.replace("i", F.lit(pair), F.lit(pair[0]))) for pair in ("su", "ua", "au")), F.lit(0))
    counts = known.withColumn("illegal", (F.length("i") - 1 - legal).cast("long")).groupBy("conv_id").agg(
        F.sum("blank").alias("blank"), F.sum("again").alias("duplicate"), F.sum("broken").alias("truncated"), F.sum("illegal").alias("illegal"))
    gaps = held.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.countDistinct("turn").alias("turns"))
    gaps = gaps.select("conv_id", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"))

    rules = grammar(blocks)
    found = in_batches(blocks.select("conv_id", "blk", "word"), _evaluate(rules, rule_matrices(rules)), FOUND)
    if blocks.where("blk > 0").limit(1).count():
        found = stash(found)
        while found.where("blk > 0").limit(1).count():
            several = found.where("blk > 0").select(F.col("conv_id").alias("c")).distinct()
            alone = found.join(several, _same(found, several, ("conv_id", "c")), "left_anti")
            rest = found.join(several, _same(found, several, ("conv_id", "c")), "left_semi")
            found, old = stash(alone.union(rest.groupBy("conv_id", F.floor(F.col("blk") / fan)).applyInArrow(_multiplied(fan), FOUND))), found
            forget(old)
    best = stash(in_batches(found, _closed, "conv_id bigint, cost bigint, audit string"))
    report = gaps.unionByName(counts, True).unionByName(best, True).groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.max("audit").alias("audit"))

    parts = in_batches(best.select("conv_id", "audit"), _parts(block), "c bigint, k bigint, part string, state string")
    told = blocks.join(parts, _same(blocks, parts, ("conv_id", "c"), ("blk", "k"))).select("conv_id", "rows", "part", "state")
    edited = in_batches(told, _edited, "conv_id bigint, pos bigint, sub bigint, rid bigint, given string")
    lines = edited.join(held.select("rid", "role", "text"), "rid", "left")
    return report, lines.select("conv_id", "pos", "sub", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha256) over the lines role:text of every conversation that has any, joined by line ends."""
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "role", "text")
    return in_batches(ordered, _digests, "conv_id bigint, sha256 string")
