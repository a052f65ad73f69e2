"""Counts and roll-ups. All use partial aggregation, so a hot key costs one row per map task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

UNTAGGED = ["pending", "error"]


def tag_stats(items: DataFrame) -> DataFrame:
    """Records per tag; a record counts a tag once."""
    return items.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def tag_summary(items: DataFrame) -> DataFrame:
    """Number of records and of different tags, the latter from the tag counts rather than a second distinct."""
    return items.agg(F.count("*").alias("images")).select(
        "images", tag_stats(items).agg(F.count("*").alias("n")).scalar().alias("unique_tags"))


def histograms(items: DataFrame) -> DataFrame:
    """Rating and status counts in one pass."""
    sets = items.select(F.coalesce(F.nullif(F.col("rating"), F.lit("")), F.lit("unknown")).alias("rating"), "status") \
        .groupingSets([["rating"], ["status"]], "rating", "status") \
        .agg(F.count("*").alias("n"), F.grouping("status").alias("_s"))
    return sets.select(F.when(F.col("_s") == 1, "rating").otherwise("status").alias("kind"),
                       F.when(F.col("_s") == 1, F.col("rating")).otherwise(F.col("status")).alias("value"), "n")


def project_rollup(items: DataFrame, projects: DataFrame) -> DataFrame:
    """Every project with counts and its first record as cover. Aggregates before joining."""
    per = items.groupBy("project_id").agg(
        F.count("*").alias("image_count"), F.count_if(F.col("status") == "done").alias("done_count"),
        F.min_by("id", F.struct("created", "id")).alias("cover_id"))
    zero = F.lit(0).cast("long")
    return projects.join(per, "project_id", "left").withColumn("image_count", F.coalesce("image_count", zero)) \
                   .withColumn("done_count", F.coalesce("done_count", zero))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group: Spark keeps only ``k`` per group on the map side before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Newest row per key as an aggregate (map-side combine), not a window."""
    packed = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*by)).alias("_r"))
    return packed.select(*key, "_r.*")


def tag_suggest(targets: DataFrame, used: list[str], characters: int = 6, general: int = 18) -> DataFrame:
    """Frequent tags worth filtering by: not already used, not on every target. ``targets``: id, character, general."""
    targets = cut_lineage(targets)
    total = targets.agg(F.count("*").alias("total")).scalar()
    long = targets.select(F.explode(F.concat(
        F.transform(F.array_distinct("character"), lambda t: F.struct(t.alias("tag"), F.lit(True).alias("named"))),
        F.transform(F.array_distinct(F.array_except("general", "character")), lambda t: F.struct(t.alias("tag"), F.lit(False).alias("named"))),
    )).alias("x")).select("x.*")
    counted = long.groupBy("tag").agg(F.count("*").alias("n"), F.bool_or("named").alias("named"))
    open_tags = counted.withColumn("total", total).where(
        ~F.col("tag").isin(used) & ((F.col("n") < F.col("total")) | (F.col("total") == 1)))
    ranked = top_k(open_tags, ["named"], [F.col("n").desc(), F.col("tag")], max(characters, general))
    return ranked.where(F.col("rank") <= F.when(F.col("named"), characters).otherwise(general)).drop("total")
