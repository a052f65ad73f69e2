"""Scans over keys that lie over many partitions against the plain sequential rule."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.operators import imports as I
from tagloom.operators import names as NM
from tagloom.operators.scans import scan


def run(machine, rows, state=None):
    out = []
    for row in rows:
        state, made = machine.step(state, *row)
        out.append(made)
    return out, state


def drawn(kind, n, draw):
    if kind == "pack":
        return [(draw.choice([1, 1, 2, 3, 50]), draw.choice([0, 10, 10, 200, 999])) for _ in range(n)]
    slots = sorted(draw.sample(range(2, 4 * n + 2), n))
    return [(s, draw.randint(0, s), draw.randint(0, 1)) for s in slots]


MACHINES = {"pack": I.packing(7, 1000), "skip": NM.skipping()}


@pytest.fixture
def spread(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", MACHINES)
def test_summaries_tell_the_state_after_rows(kind):
    draw, machine = random.Random(1), MACHINES[kind]
    for _ in range(400):
        rows = drawn(kind, draw.randint(1, 40), draw)
        cut = draw.randint(0, len(rows) - 1)
        _, state = run(machine, rows[:cut])
        _, want = run(machine, rows[cut:], state)
        assert machine.advance(machine.summary(rows[cut:]), state) == want


def test_hot_key_lies_over_many_partitions(spread):
    """One root holds two thirds of the rows and no partition holds them all, yet the batches are the sequential ones."""
    draw = random.Random(2)
    rows = [("hot" if draw.random() < 0.67 else f"r{draw.randint(0, 20)}", k, *drawn("pack", 1, draw)[0]) for k in range(6000)] + [(None, 1, 1, 5), (None, 2, 60, 5), (None, 3, 1, 1)]
    df = spread.createDataFrame(rows, "root string, at long, files long, size long")
    out = scan(df, ["root"], ["at"], ["files", "size"], MACHINES["pack"], {"batch": ("long", pa.int64())})
    placed = out.withColumn("task", F.spark_partition_id())
    got = {(r["root"], r["at"]): r["batch"] for r in placed.collect()}
    for root in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == root)
        assert [got[root, m[0]] for m in mine] == [b for (b,) in run(MACHINES["pack"], [m[1:] for m in mine])[0]]
    shares = [r["count"] for r in placed.where("root = 'hot'").groupBy("task").count().collect()]
    assert len(shares) >= 4 and max(shares) < 0.5 * sum(shares)


def test_names_of_a_hot_parent(spread):
    """Many literals under one repeated name, against trying names one after the other."""
    draw = random.Random(3)
    bases = [draw.choice(["x", "x", "X", f"x_{draw.randint(2, 400)}", f"x_{draw.randint(2, 60)}", f"x_2_{draw.randint(2, 9)}"]) for _ in range(900)]
    df = spread.createDataFrame([(k, "g", b) for k, b in enumerate(bases)], "id long, g string, base string")
    got = {r["id"]: r["stem"] for r in NM.unique_stems(df, "g", "id").collect()}
    used, want = set(), {}
    for k, b in enumerate(bases):
        name, n = b, 1
        while name.lower() in used:
            n += 1
            name = f"{b}_{n}"
        used.add(name.lower())
        want[k] = name
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "root string, at long, files long, size long")
    assert scan(df, ["root"], ["at"], ["files", "size"], MACHINES["pack"], {"batch": ("long", pa.int64())}).count() == 0
