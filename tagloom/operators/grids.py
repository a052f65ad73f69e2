"""Plain-region search on boolean grids as relations: (grid, x, y) rows for the true cells."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_heights(cells: DataFrame) -> DataFrame:
    """Height of the unbroken column ending at each true cell. A column holds at most the grid's height of rows."""
    column = Window.partitionBy("grid", "x").orderBy("y")
    island = Window.partitionBy("grid", "x", "_island").orderBy("y")
    marked = cells.withColumn("_island", F.col("y") - F.row_number().over(column))
    return marked.withColumn("height", F.row_number().over(island)).drop("_island")


def largest_area(heights: DataFrame) -> DataFrame:
    """Area of the largest all-true rectangle per grid.

    Each grid line becomes an array of column heights from the grid's first to its last true column. For every start column
    one fold walks right with the lowest height so far; a gap has height zero and ends the span.
    """
    reach = heights.groupBy("grid").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    line = heights.groupBy("grid", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "height"))).alias("m")).join(reach, "grid").select(
        "grid", F.transform(F.sequence("_low", "_high"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("long")).alias("h"))
    fold = ("aggregate(slice(h, s, size(h)), named_struct('low', cast(null as bigint), 'n', 0L, 'best', 0L), (a, v) -> named_struct('low', least(a.low, v), "
            "'n', a.n + 1, 'best', greatest(a.best, least(a.low, v) * (a.n + 1))), a -> a.best)")
    best = F.array_max(F.call_function("transform", F.sequence(F.lit(1), F.size("h")), F.expr("s -> " + fold)))
    return line.groupBy("grid").agg(F.max(best).alias("area"))
