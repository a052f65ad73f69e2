"""Bulk edits of tag lists. Each returns the new list; a row counts as changed only if the list differs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import canon_sql, globs_regex, let, only, quoted, split_text, tidy


def _lits(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def add(tags: Column, text: str, position: str = "back") -> Column:
    wanted = _lits(split_text(text))

    def put(lowers: Column) -> Column:
        extra = F.filter(wanted, lambda w: ~F.array_contains(lowers, F.lower(w)))
        return F.concat(extra, tags) if position == "front" else F.concat(tags, extra)

    return let(F.transform(tags, F.lower), put)


def remove(tags: Column, text: str) -> Column:
    regex = globs_regex(split_text(text))
    return only(tags, f"t -> NOT lower({canon_sql('t')}) RLIKE {quoted(regex)}") if regex else tags


def replace(tags: Column, find: str, put: str) -> Column:
    target = (split_text(find) or [""])[0].lower()
    new = _lits(split_text(put))
    return tidy(F.flatten(F.transform(tags, lambda t: F.when(F.lower(t) == target, new).otherwise(F.array(t)))))


def with_undo(df: DataFrame, new_tags: Column, new_nl: Column) -> DataFrame:
    """Keep one level of history in ``prev``."""
    return df.withColumn("prev", F.struct(F.col("tags").alias("tags"), F.col("nl").alias("nl"))) \
             .withColumn("tags", new_tags).withColumn("nl", new_nl)


def undo(df: DataFrame) -> DataFrame:
    has = F.col("prev").isNotNull()
    return df.withColumn("tags", F.when(has, F.col("prev.tags")).otherwise(F.col("tags"))) \
             .withColumn("nl", F.when(has, F.col("prev.nl")).otherwise(F.col("nl"))) \
             .withColumn("prev", F.lit(None).cast("struct<tags:array<string>,nl:string>"))


def changed_count(df: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    return df.agg(F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed"), F.count("*").alias("total"))


def patch(df: DataFrame, tags_text: Column, nl_text: Column) -> DataFrame:
    """Single-record edit: given values replace, and a pending or failed record becomes done."""
    from ..functions.tags import split_tags, strip

    edited = tags_text.isNotNull() | nl_text.isNotNull()
    reopen = edited & F.col("status").isin("pending", "error")
    return df.select(
        *[c for c in df.columns if c not in ("tags", "nl", "status")],
        F.when(tags_text.isNotNull(), split_tags(tags_text)).otherwise(F.col("tags")).alias("tags"),
        F.when(nl_text.isNotNull(), strip(nl_text)).otherwise(F.col("nl")).alias("nl"),
        F.when(reopen, "done").otherwise(F.col("status")).alias("status"))
