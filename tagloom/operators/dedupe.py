"""Exact duplicates."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def without_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows sharing none of ``keys`` with ``known``: one equi anti-join per key, never an OR."""
    for k in keys:
        rows = rows.join(known.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return rows


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows kept by a pass in ``order`` that skips a row sharing any key with a row kept before.

    A skipped row blocks nobody, so this is not one minimum per key. Rounds: an open row that is the earliest open one
    for each of its keys is kept, open rows sharing a key with it are dropped, and the rest goes on. Every round reads
    a checkpoint; minima are aggregates, so a key held by a third of all rows is combined on the map side.
    """
    open_, kept = cut_lineage(rows), []
    while open_.limit(1).count():
        earliest: list[DataFrame] = [
            open_.groupBy(k).agg(F.min(order).alias(order)).where(F.col(k).isNotNull()).select(k, order) for k in keys]
        new = open_
        for k, e in zip(keys, earliest):
            blocked = open_.select(k, order).join(e.withColumnRenamed(order, "_e"), k).where(F.col(order) != F.col("_e")).select(order)
            new = new.join(blocked, order, "left_anti")
        new = cut_lineage(new)
        kept.append(new)
        open_ = cut_lineage(without_known(open_.join(new.select(order), order, "left_anti"), new, keys))
    return reduce(DataFrame.unionByName, kept) if kept else open_
