"""Projects as folders of batches: an import is planned against what is there and appended once."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import positions
from ..session import cut_lineage

NUMBERED = r"(?s)^(.+) \(([1-9][0-9]{0,17})\)(\.[^.]*)?$"


def _asked(rows: DataFrame, name: str = "name") -> DataFrame:
    """Adds what a name asks for: ``stem`` and ``ext`` without a number in brackets, ``root`` in lower case, and the number (1 if it has none)."""
    has = F.col(name).rlike(NUMBERED)
    ext = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    bare = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    part = lambda k: F.regexp_extract(name, NUMBERED, k)
    out = rows.withColumns({"stem": F.when(has, part(1)).otherwise(bare), "ext": F.when(has, part(3)).otherwise(ext),
                            "number": F.when(has, part(2).try_cast("long")).otherwise(F.lit(1).cast("long"))})
    return out.withColumn("root", F.lower(F.concat("stem", "ext")))


def free_names(new: DataFrame, present: DataFrame, order: str, name: str = "name") -> DataFrame:
    """``new`` with ``given``, a name nobody else has, in any case. ``a (3).png`` asks for number 3 of ``a.png``, which itself is number 1. The first
    that asks for a free number gets it; all others take the next free numbers of their base in ``order``.

    The j-th free number is j plus the taken numbers t whose rank i among them leaves t - i < j: one running count, so a name that a third of the rows
    share is no task of its own.
    """
    rows = cut_lineage(_asked(new, name))
    there = _asked(present.select(F.col(name)), name).select("root", "number").distinct()
    wins = rows.join(there, ["root", "number"], "left_anti").groupBy("root", "number").agg(F.min(order).alias(order)).withColumn("own", F.lit(True))
    told = cut_lineage(rows.join(wins, ["root", "number", order], "left"))
    taken = there.union(told.where("own").select("root", "number"))
    ranked = positions(taken, ["root"], ["number"], "_i").select("root", (F.col("number") - F.col("_i")).alias("_at"), F.lit(1).alias("_taken"), F.lit(None).cast("long").alias("_o"))
    rest = positions(told.where("own IS NULL"), ["root"], [order], "_j")
    asks = rest.select("root", F.col("_j").alias("_at"), F.lit(0).alias("_taken"), F.col(order).cast("long").alias("_o"))
    both = ranked.unionByName(asks).withColumn("_u", F.monotonically_increasing_id())
    counted = positions(both, ["root"], ["_at", "_taken", "_u"], "_before", F.col("_taken")).where("_taken = 0")
    numbers = counted.select(F.col("_o").alias(order), (F.col("_at") + F.col("_before")).alias("_n"))
    out = told.join(numbers, order, "left").withColumn("_n", F.coalesce("_n", "number"))
    label = F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    return out.withColumn("given", F.concat("stem", label, "ext")).select(*new.columns, "given")


def import_plan(selected: DataFrame, present: DataFrame, order: str = "id", allow_duplicates: bool = False) -> DataFrame:
    """``selected`` (``order`` a unique number, name, sha1) with ``reason`` (duplicate, or null: it is added) and ``given``, its name in the project. ``present``: name, sha1.
    A record is a duplicate if the project or an earlier record of the selection has its content; null content is never one."""
    marked = selected.withColumn("reason", F.lit(None).cast("string"))
    if not allow_duplicates:
        first = selected.where("sha1 IS NOT NULL").groupBy("sha1").agg(F.min(order).alias("_first"))
        known = present.where("sha1 IS NOT NULL").select("sha1").distinct().withColumn("_known", F.lit(True))
        marked = selected.join(first, "sha1", "left").join(known, "sha1", "left").withColumn(
            "reason", F.when(F.col("_known") | (F.col(order) != F.col("_first")), "duplicate")).select(*selected.columns, "reason")
    marked = cut_lineage(marked)
    named = free_names(marked.where("reason IS NULL"), present, order)
    return named.unionByName(marked.where("reason IS NOT NULL"), True)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def project(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were written to their end, with their batch."""
    store, place = _folder(spark, path)
    done = [f.getPath().getName() for f in store.listStatus(place) if _folder(spark, f"{path}/{f.getPath().getName()}/_SUCCESS")[0].exists(
        _folder(spark, f"{path}/{f.getPath().getName()}/_SUCCESS")[1])] if store.exists(place) else []
    if not done:
        return spark.createDataFrame([], schema + ", batch string")
    return spark.read.schema(schema + ", batch string").option("basePath", path).parquet(*[f"{path}/{d}" for d in done])


def to_project(selected: DataFrame, path: str, batch: str, allow_duplicates: bool = False) -> DataFrame:
    """Plans an import of ``selected`` (id long, name, sha1) into the project at ``path``, appends what is new as batch ``batch``, and returns the plan.

    A batch has a folder of its own, planned against the other batches. The same batch again, after a failure or by mistake, gives the same plan; a
    finished one is left as it is, an unfinished one is written over, so nothing is added twice.
    """
    spark = selected.sparkSession
    schema = "id long, name string, sha1 string"
    present = project(spark, path, schema).where(F.col("batch") != batch).select("name", "sha1")
    plan = cut_lineage(import_plan(selected.select("id", "name", "sha1"), present, "id", allow_duplicates))
    store, mark = _folder(spark, f"{path}/batch={batch}/_SUCCESS")
    if not store.exists(mark):
        plan.where("reason IS NULL").select("id", F.col("given").alias("name"), "sha1").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return plan
