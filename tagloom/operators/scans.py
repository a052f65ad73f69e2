"""Scans whose next step needs the outcome of the step before, without one task for a key.

The rows are range-partitioned by key and order, so a hot key lies over many partitions. Each partition summarises its last key as a map from
the state in which that key enters the partition to the state in which it leaves. The maps, one for each partition, are applied one after the other;
then every partition replays its own rows from the state in which its first key enters.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .order import ranged


@dataclass(frozen=True)
class Machine:
    """``step(state, *values)`` gives the next state and the row's outputs; a key starts with state None.
    ``summary(rows)`` describes rows in order so that ``advance(summary, state)`` is the state after them."""

    step: Callable[..., tuple[Any, tuple]]
    summary: Callable[[list[tuple]], Any]
    advance: Callable[[Any, Any], Any]


def _ends(group: list[str], take: list[str], machine: Machine):
    """One row for a partition: its first and last key, and the summary of the last key's rows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, now, held = None, None, None, []
        for b in batches:
            if b.num_rows:
                pid = b.column("_pid")[0].as_py()
                for key, row in zip(zip(*(b.column(c).to_pylist() for c in group)), zip(*(b.column(c).to_pylist() for c in take))):
                    if key != now:
                        first, now, held = key if now is None else first, key, []
                    held.append(row)
        if pid is not None:
            blobs = [pa.array([pickle.dumps(x)], pa.binary()) for x in (first, now, machine.summary(held))]
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), *blobs], ["pid", "first", "last", "summary"])

    return run


def _entries(machine: Machine):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for pid, first, key, summary in zip(b["pid"], b["first"], b["last"], b["summary"]):
                entry = state if first == last else None
                out.append((pid, pickle.dumps(entry)))
                last, state = key, machine.advance(pickle.loads(summary), entry if first == key else None)
            yield pd.DataFrame(out, columns=["pid", "entry"])

    return run


def _replayed(group: list[str], take: list[str], machine: Machine, entries: dict[int, bytes], names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, fresh = None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for key, row in zip(zip(*(b.column(c).to_pylist() for c in group)), zip(*(b.column(c).to_pylist() for c in take))):
                if fresh:
                    now, state, fresh = key, pickle.loads(entries[b.column("_pid")[0].as_py()]), False
                elif key != now:
                    now, state = key, None
                state, made = machine.step(state, *row)
                out.append(made)
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            kept = [c for c in b.schema.names if c not in ("_pid", "_idx")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, *names])

    return run


def scan(df: DataFrame, group: list[str], order: list[str], take: list[str], machine: Machine, outputs: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``df`` with the outputs of ``machine`` over the columns ``take`` of each group in order. The order must be total within a group.

    The driver sees one state for each partition.
    """
    r = ranged(df, group + order)
    ends = r.select("_pid", *group, *[c for c in take if c not in group]).mapInArrow(_ends(group, take, machine), "pid int, first binary, last binary, summary binary")
    entries = ends.coalesce(1).sortWithinPartitions("pid").mapInPandas(_entries(machine), "pid int, entry binary")  # one row for a partition
    known = {e["pid"]: bytes(e["entry"]) for e in entries.collect()}
    schema = df.schema.simpleString()[7:-1] + "".join(f", {name} {sql}" for name, (sql, _) in outputs.items())
    return r.mapInArrow(_replayed(group, take, machine, known, list(outputs), [t for _, t in outputs.values()]), schema)
