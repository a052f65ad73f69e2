"""Row numbers and positions without funnelling a group, or the whole table, through one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partitioned and sorted by ``keys``, with partition number and row index; written once, so both passes see
    the same partitions even if an executor is lost."""
    spread = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    mono = F.monotonically_increasing_id()
    return cut_lineage(spread.withColumn("_pid", F.spark_partition_id())
                       .withColumn("_idx", mono - F.shiftleft(F.spark_partition_id().cast("long"), 33)))


def number_rows(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """1-based global row number. The order must be total. The offset table has one row per partition."""
    r = ranged(df, order)
    sizes = r.groupBy("_pid").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    return r.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_idx") + 1) \
            .drop("_pid", "_idx", "_off")


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos", running: Column | None = None,
              first: str | None = None) -> DataFrame:
    """1-based position inside each group, or a running total of ``running``; hot groups stay spread.

    Rows are range-partitioned by (group, order). A group crossing partitions gets the total of its earlier
    partitions; only the first and last group of a partition can cross, so the carry table is at most two rows per
    partition, whatever the data. ``first`` names a column whose value in the group's first row is added as "first".
    """
    value = F.lit(1).cast("long") if running is None else running.cast("long")
    r = ranged(df.withColumn("_v", value), group + order)
    key = F.struct(*[F.col(g) for g in group])
    ends = r.groupBy("_pid").agg(F.min_by(key, "_idx").alias("_a"), F.max_by(key, "_idx").alias("_b"))
    edge = ends.select("_pid", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_g"))
    part = r.withColumn("_g", key).join(F.broadcast(edge), ["_pid", "_g"]).groupBy("_pid", "_g").agg(
        F.sum("_v").alias("_t"), F.min_by(F.col(first or "_idx"), "_idx").alias("_f"))
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select("_pid", "_g", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_c"), F.first("_f").over(before).alias("_f"))
    inside = Window.partitionBy("_pid", *group).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    local = r.withColumn("_local", F.sum("_v").over(inside)).withColumn("_g", key)
    if first:
        local = local.withColumn("first", F.first(first).over(inside))
    out = local.join(F.broadcast(carry), ["_pid", "_g"], "left").withColumn(name, F.col("_local") + F.coalesce("_c", F.lit(0)))
    if first:
        out = out.withColumn("first", F.coalesce("_f", "first"))
    return out.drop("_pid", "_idx", "_v", "_local", "_g", "_c", "_f")


def evenly_spaced(df: DataFrame, order: list[str], count: int = 3) -> DataFrame:
    """At most ``count`` rows, evenly spread over the order, with their pick number."""
    n = number_rows(df, order, "_n")
    total = n.agg(F.count("*").alias("_total"))
    picks = total.select(F.explode(F.sequence(F.lit(0), F.least(F.lit(count), F.col("_total")).cast("int") - 1)).alias("pick"),
                         F.col("_total"), F.least(F.lit(count).cast("long"), F.col("_total")).alias("_k")).where("_total > 0")
    at = F.floor(F.col("pick") * (F.col("_total") - 1) / F.greatest(F.lit(1), F.col("_k") - 1) + 0.5) + 1
    wanted = picks.select(at.alias("_n"), "pick")  # at most ``count`` rows
    return n.join(F.broadcast(wanted), "_n").drop("_n")
