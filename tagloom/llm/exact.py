"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then a hash of everything.

Each step only keeps rows whose group still has two members, and the text of a row is read in full only when both cheaper keys are
shared. All of it is DataFrame functions. Texts count as equal when they are the same after each run of spaces, tabs, line feeds,
vertical tabs, form feeds and carriage returns has become one space.

Defined cases: null text equals the empty text. The row with the smallest doc_id stays (a null id only if all ids of the group are
null); of rows that repeat the same id and text all stay, as they are one document twice (``first_rows`` keeps one). An empty table
gives an empty table. Other columns, whatever their names, are carried untouched in the struct ``row``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

PREFIX = 64  # characters behind the second key


def normal(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def full_hash(text: str | Column) -> Column:
    return F.sha2(F.encode(normal(text), "UTF-8"), 256)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row as struct ``row``, with full (the hash, null where it wasn't needed), keep_id, group_size and kept.

    Only ids and keys are shuffled for the first two steps; rows meet their surviving keys once, by (id, length, prefix). Counts are
    made before any join, so a group of any size is one row per task; the joins that bring a count back to a large group are equi-joins
    that adaptive execution may split.
    """
    text = normal("row.text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.octet_length(text).alias("length"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("prefix"))
    keys = stash(keyed.select("id", "length", "prefix"))
    crowded = keys.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    second = keys.join(crowded, "length").groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("length", "prefix")
    alike = keys.join(second, ["length", "prefix"]).select("id", "length", "prefix").distinct()
    same = [keyed.id.eqNullSafe(alike.id), keyed.length == alike.length, keyed.prefix == alike.prefix]
    read = keyed.join(alike.withColumn("alike", F.lit(True)), same, "left").select(
        "row", keyed.id, keyed.length, keyed.prefix, F.when(F.col("alike"), full_hash("row.text")).alias("full"))
    groups = read.where("full is not null").groupBy("length", "prefix", "full").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return read.join(groups, ["length", "prefix", "full"], "left").select(
        "row", "full", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.coalesce("keep_id", "id")).alias("kept"))


def first_rows(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns of ``docs``. Only kept rows are numbered, of which a group has one, or one for each
    time that its document is repeated."""
    kept = exact_groups(docs).where("kept")
    again = Window.partitionBy("keep_id", "full").orderBy(F.lit(0))
    one = kept.where("full is not null").withColumn("n", F.row_number().over(again)).where("n = 1")
    return kept.where("full is null").select("row").union(one.select("row")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
