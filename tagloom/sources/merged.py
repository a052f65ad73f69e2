"""Tables that batches are merged into: rows in hash buckets, versions that appear at once, and a batch that counts once.

A table is a folder. ``data/<name>/_bucket=<k>`` holds the rows of bucket k as one merge left them, ``versions/<n>.json`` names the folder of each bucket
and the last batch of each writer. A merge reads and rewrites only the buckets that its keys fall into, and its version file appears by one rename that
fails if the number is taken. Readers see a whole version; a batch that comes again, after a failure at any point, changes nothing.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.stats import latest
from ..session import cut_lineage

BUCKETS = 64  # of a new table: about its expected size over 1 GB; an existing table keeps its number


@dataclass
class Version:
    """``parts``: the folder that holds each bucket; ``batches``: the last batch of each writer."""
    number: int = -1
    buckets: int = 0
    parts: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it does not exist."""
    store, place = _path(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def _load(spark: SparkSession, path: str, number: int) -> Version:
    store, place = _path(spark, f"{path}/versions/{number:012d}.json")
    stream = store.open(place)
    try:
        held = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return Version(number, held["buckets"], {int(k): v for k, v in held["parts"].items()}, held["batches"])


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, path + "/versions") if n.endswith(".json") and not n.startswith("."))


def version(spark: SparkSession, path: str) -> Version:
    """The newest version; number -1 where there is none."""
    numbers = _numbers(spark, path)
    return _load(spark, path, numbers[-1]) if numbers else Version()


def _commit(spark: SparkSession, path: str, new: Version) -> None:
    """Makes ``new`` the newest version; an error if another writer took its number meanwhile."""
    text = json.dumps({"buckets": new.buckets, "parts": new.parts, "batches": new.batches}).encode()
    store, draft = _path(spark, f"{path}/versions/.{uuid4().hex}")
    out = store.create(draft, True)
    out.write(text)
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(draft.toUri() if draft.isAbsolute() and draft.toUri().getScheme() else store.getUri(), spark._jsc.hadoopConfiguration())
    keep_others = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    files.rename(draft, hadoop.Path(f"{path}/versions/{new.number:012d}.json"), keep_others)


def _rows(spark: SparkSession, path: str, schema: StructType, held: Version, buckets: list[int] | None = None) -> DataFrame:
    """Rows of the given buckets with their ``_bucket``; only the folders of these are listed and read."""
    wanted = sorted(held.parts if buckets is None else set(buckets) & set(held.parts))
    full = StructType([*schema.fields, StructField("_bucket", IntegerType())])
    if not wanted:
        return spark.createDataFrame([], full)
    parts = [spark.read.schema(full).option("basePath", f"{path}/data/{folder}").parquet(*[f"{path}/data/{folder}/_bucket={k}" for k in wanted if held.parts[k] == folder])
             for folder in sorted({held.parts[k] for k in wanted})]
    while len(parts) > 1:  # a shallow tree of unions
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    return parts[0]


def merged(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the newest version."""
    return _rows(spark, path, schema, version(spark, path)).drop("_bucket")


def _in_buckets(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _touched(rows: DataFrame) -> list[int]:
    return [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most the number of buckets


def merge(rows: DataFrame, path: str, keys: list[str], by: list[str], batch: int, writer: str = "", gone: Column | None = None, buckets: int = BUCKETS) -> bool:
    """Merges ``rows`` into the table at ``path``: of each key the row with the greatest ``by`` stays, of equal ones that of the later batch. A key whose
    winning row fulfils ``gone`` leaves the table, so it takes any row that comes later. ``batch`` counts up for each ``writer``; False if it is in already.

    Null keys are keys like others. A key that a third of the rows share is one row after the first, map-side aggregation.
    """
    spark, held = rows.sparkSession, version(rows.sparkSession, path)
    if held.batches.get(writer, -1) >= batch:
        return False
    count = held.buckets or buckets
    new = cut_lineage(_in_buckets(latest(rows, keys, by), keys, count))
    touched = _touched(new)
    parts = dict(held.parts)
    if touched:
        old = _rows(spark, path, rows.schema, held, touched)
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        # one shuffle: rows that are together by bucket are together by bucket and key
        kept = latest(both.repartition(count, "_bucket"), ["_bucket", *keys], [*by, "_new"]).drop("_new")
        folder = uuid4().hex
        (kept if gone is None else kept.where(~F.coalesce(gone, F.lit(False)))).write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
        filled = {int(n.split("=")[1]) for n in names(spark, f"{path}/data/{folder}") if n.startswith("_bucket=")}
        parts = {k: v for k, v in parts.items() if k not in set(touched)} | {k: folder for k in filled}
    _commit(spark, path, Version(held.number + 1, count, parts, held.batches | {writer: batch}))
    return True


def missing(rows: DataFrame, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """Those of ``rows`` whose key the table lacks. Only the key columns of the buckets that the rows fall into are read. Null keys never match."""
    spark, held = rows.sparkSession, version(rows.sparkSession, path)
    if not held.parts:
        return rows
    placed = cut_lineage(_in_buckets(rows, keys, held.buckets))
    there = _rows(spark, path, schema, held, _touched(placed)).select("_bucket", *keys)
    return placed.join(there, ["_bucket", *keys], "left_anti").select(*rows.columns)


def tidy(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Frees the versions before the newest ``keep``, and data that only these name. Run it while no merge runs; readers of freed versions fail."""
    numbers = _numbers(spark, path)[-keep:]
    used = {folder for n in numbers for folder in _load(spark, path, n).parts.values()}
    old = [f"{path}/data/{n}" for n in names(spark, path + "/data") if n not in used]
    old += [f"{path}/versions/{n}" for n in names(spark, path + "/versions") if n.endswith(".json") and not n.startswith(".") and int(n[:-5]) not in numbers]
    for name in old if numbers else []:
        store, place = _path(spark, name)
        store.delete(place, True)
