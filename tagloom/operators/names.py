"""Collision-free export names, exact for any amount of collisions and without per-group tasks."""
from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .order import positions
from .scans import Machine, scan


def unique_names(df: DataFrame, group: list[str], order: list[str], name: str = "name", out: str = "unique") -> DataFrame:
    """The n-th use of a name (any case) becomes ``name (n).ext``."""
    p = positions(df.withColumn("_k", F.lower(name)), [*group, "_k"], order, "_n")
    ext = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    bare = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    numbered = F.concat(bare, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext)
    return p.withColumn(out, F.when(F.col("_n") == 1, F.col(name)).otherwise(numbered)).drop("_k", "_n")


def skipping() -> Machine:
    """Per parent, in slot order: is the literal name already used when the parent's counter reaches it? The state is the number of skipped slots.

    A slot is skipped by states below some bound, so over a stretch of rows the skips fall as the entering state grows: they are the bounds, as
    bounds on the entering state, that lie above it.
    """

    def step(skipped, slot: int, used: int, own: int):
        skipped = skipped or 0
        skip = slot - skipped - own > used
        return skipped + skip, (skip, skipped + skip)

    def summary(rows: list[tuple]):
        bounds: list[int] = []  # sorted; entering with s skips as many slots as there are bounds above s
        for slot, used, own in rows:
            low, high = slot - own - used - len(bounds) - 1, slot - own - used
            while low < high:  # the first entering state that comes to this row with no skip left to make
                mid = (low + high) // 2
                if mid + len(bounds) - bisect_right(bounds, mid) >= slot - own - used:
                    high = mid
                else:
                    low = mid + 1
            if low > 0:
                insort(bounds, low)
        return np.array(bounds, np.int64)

    def advance(bounds, skipped):
        skipped = skipped or 0
        return skipped + len(bounds) - int(np.searchsorted(bounds, skipped, "right"))

    return Machine(step, summary, advance)


def unique_stems(df: DataFrame, group: str, order: str, base: str = "base", out: str = "stem") -> DataFrame:
    """First use of a base keeps it; later uses try ``base_2``, ``base_3`` ... until free, in ``order``, ignoring case.

    A number too long for a counter can't meet one. The only interaction between different bases is a literal ``x_7`` standing where the counter of a repeated ``x``
    would pass. Those (parent, literal) pairs are found by an equi-join on distinct names, so the usual case is one
    numbering. For the pairs, counting the parent's uses before the literal's first use tells who gets the name: the
    literal keeps it and the counter skips the slot, or the counter got there first and the literal counts as used.
    Nested pairs (``x``, ``x_2``, ``x_2_2``) are resolved level by level from the outside in.
    """
    rows = cut_lineage(df.withColumn("g", F.col(group)).withColumn("k", F.lower(base)))
    keys = cut_lineage(rows.groupBy("g", "k").agg(F.count("*").alias("m"), F.min(order).alias("f")))
    tail = r"(?s)^(.+)_([1-9][0-9]*)$"
    kids = keys.select("g", "k", "f", F.regexp_extract("k", tail, 1).alias("p"),
                       F.regexp_extract("k", tail, 2).try_cast("long").alias("slot")).where("p <> '' and slot >= 2")
    heads = keys.select("g", F.col("k").alias("p"), F.col("m").alias("pm"))
    rel = kids.join(heads, ["g", "p"])
    width = rel.groupBy("g", "p").agg(F.count("*").alias("kids"))
    rel = rel.join(width, ["g", "p"]).where("slot <= pm + 1 + kids").drop("kids")
    nested = rel.select("g", F.col("k").alias("p")).distinct().withColumn("inner", F.lit(True))
    rel = cut_lineage(rel.join(nested, ["g", "p"], "left").where("pm >= 2 or inner").drop("inner"))
    skips, own = None, None
    if rel.limit(1).count():
        skips, own = _resolve(rows, rel, order)
    full = rows.join(keys.select("g", "k", "m"), ["g", "k"])
    full = full.join(own, ["g", "k"], "left") if own is not None else full.withColumn("own", F.lit(None).cast("long"))
    full = cut_lineage(full.withColumn("own", F.coalesce("own", F.lit(0).cast("long"))))
    single = full.where("m = 1 and own = 0").withColumn(out, F.col(base))
    many = positions(full.where("m > 1 or own = 1"), ["g", "k"], [order], "_i").withColumn("_j", F.col("_i") + F.col("own"))
    if skips is None:
        many = many.withColumn("_shift", F.lit(0).cast("long"))
    else:
        # skipped slots below each use: a running count over uses and skips in counter order
        events = many.select("g", "k", "_j", F.lit(1).alias("_t"), F.lit(0).alias("_skip")).unionByName(
            skips.select("g", F.col("p").alias("k"), (F.col("slot") - F.col("shift") + 1).alias("_j"), F.lit(0).alias("_t"), F.lit(1).alias("_skip")))
        hit = events.join(skips.select("g", F.col("p").alias("k")).distinct(), ["g", "k"], "left_semi")
        run = positions(hit.withColumn("_u", F.monotonically_increasing_id()), ["g", "k"], ["_j", "_t", "_u"], "_shift", F.col("_skip"))
        many = many.join(run.where("_t = 1").select("g", "k", "_j", "_shift"), ["g", "k", "_j"], "left") \
                   .withColumn("_shift", F.coalesce("_shift", F.lit(0).cast("long")))
    number = (F.col("_j") + F.col("_shift")).cast("string")
    many = many.withColumn(out, F.when(F.col("_j") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), number)))
    cols = [*df.columns, out]
    return single.select(*cols).unionByName(many.select(*cols))


def _resolve(rows: DataFrame, rel: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(skipped slots per parent, literals whose name was taken first)."""
    uses = rows.select("g", F.col("k").alias("p"), F.col(order).alias("at"), F.lit(1).alias("use"), F.lit(None).cast("string").alias("k")) \
        .join(rel.select("g", "p").distinct(), ["g", "p"], "left_semi")
    marks = rel.select("g", "p", F.col("f").alias("at"), F.lit(0).alias("use"), "k")
    counted = positions(uses.unionByName(marks), ["g", "p"], ["at", "use", "k"], "used", F.col("use"))
    todo = cut_lineage(rel.join(counted.where("use = 0").select("g", "p", "k", "used"), ["g", "p", "k"]))
    skips = own = None
    while todo.limit(1).count():
        inner = todo.select("g", F.col("k").alias("p")).distinct()
        now = todo.join(inner, ["g", "p"], "left_anti")
        now = now.join(own.select("g", F.col("k").alias("p"), "own"), ["g", "p"], "left") if own is not None else now.withColumn("own", F.lit(0).cast("long"))
        ready = now.withColumn("own", F.coalesce("own", F.lit(0).cast("long"))).select("g", "p", "k", "slot", "used", "own")
        told = scan(ready, ["g", "p"], ["slot", "k"], ["slot", "used", "own"], skipping(), {"skip": ("boolean", pa.bool_()), "shift": ("long", pa.int64())})
        done = cut_lineage(told.select("g", "p", "k", "slot", "skip", "shift"))
        gone, taken = done.where("skip"), done.where("not skip").select("g", "k", F.lit(1).cast("long").alias("own"))
        skips = gone if skips is None else skips.unionByName(gone)
        own = taken if own is None else own.unionByName(taken)
        todo = cut_lineage(todo.join(done.select("g", "k"), ["g", "k"], "left_anti"))
    return skips, own
