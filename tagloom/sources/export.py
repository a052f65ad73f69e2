"""Manifests and sinks. Every sink takes an already policy-filtered frame from ``prepare``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.names import unique_stems
from ..operators.order import number_rows, positions
from ..operators.policy import policy_split
from .captions import CaptionFiles


def prepare(items: DataFrame, **vocabulary) -> DataFrame:
    return policy_split(items, **vocabulary)[0]


def export_names(items: DataFrame, project: str, order: list[str], naming: str = "original", trigger: Column | str = "img") -> DataFrame:
    """Adds ``stem`` and ``ext``: slugged original names or ``trigger_0001`` numbers, without collisions per project."""
    p = positions(items, [project], order, "_n")
    four = lambda prefix: F.concat(prefix, F.lit("_"), F.lpad(F.col("_n").cast("string"), 4, "0"))
    pad = lambda prefix: F.when(F.col("_n") > 9999, F.concat(prefix, F.lit("_"), F.col("_n").cast("string"))).otherwise(four(prefix))
    if naming == "sequential":
        t = P.slugify(F.lit(trigger) if isinstance(trigger, str) else trigger, "img")
        base = pad(t)
    else:
        base = P.slugify(P.stem(F.col("name")), pad(F.lit("img")))
    named = unique_stems(p.withColumn("_base", base), project, "_n", "_base")
    return named.withColumn("ext", P.suffix(F.col("name"))).drop("_base", "_n")


def folder(fmt: str, repeats: int = 10, trigger: Column | None = None, class_word: Column | None = None) -> Column:
    if fmt == "kohya":
        return F.concat(F.lit(f"img/{max(1, repeats)}_"), P.folder_part(trigger), F.lit(" "), P.folder_part(class_word), F.lit("/"))
    return F.lit("train/" if fmt == "jsonl" else "")


def manifest(named: DataFrame, where: Column) -> DataFrame:
    """Target paths of pictures and captions."""
    return named.select("*", F.concat(where, "stem", "ext").alias("image_path"), F.concat(where, "stem", F.lit(".txt")).alias("caption_path"))


def jsonl(named: DataFrame) -> DataFrame:
    return named.select(F.to_json(F.struct(F.concat("stem", "ext").alias("file_name"), F.col("caption").alias("text"))).alias("value"))


def write_jsonl(named: DataFrame, path: str) -> None:
    jsonl(named).write.mode("overwrite").text(path)


def write_captions(manifest_: DataFrame, path: str) -> None:
    """One text file for each record at its ``caption_path`` below ``path``, with the caption and a line end."""
    spark = manifest_.sparkSession
    spark.dataSource.register(CaptionFiles)
    manifest_.select("caption_path", "caption").write.format(CaptionFiles.name()).option("path", path).mode("append").save()


def snapshot(items: DataFrame, project: str, order: list[str]) -> DataFrame:
    """Five-digit numbers from 0 in dataset order, after the exclusion, so excluded records never use a number."""
    p = positions(items, [project], order, "_n")
    n = (F.col("_n") - 1).cast("string")
    return p.withColumn("file", F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n)).drop("_n")


def global_order(items: DataFrame, order: list[str]) -> DataFrame:
    return number_rows(items, order, "ord")
