"""Safety exclusion, applied before every sink. There is no bypass."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import canon_sql, each, let
from ..settings import PROTECTED_AGE_TERMS, SEXUAL_RATINGS, SEXUAL_TERMS, SEXUAL_TEXT


def _terms(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def policy_flag(tags: Column, rating: Column, nl: Column, first: list[str] = PROTECTED_AGE_TERMS,
                second: list[str] = SEXUAL_TERMS, text: str = SEXUAL_TEXT,
                ratings: list[str] = SEXUAL_RATINGS) -> Column:
    """Sorted, joined terms of the first list when the record also matches the second list, a rating or the text
    pattern; null otherwise."""
    keys = each(F.coalesce(tags, F.array().cast("array<string>")), f"t -> lower({canon_sql('t')})")

    def judge(k: Column) -> Column:
        hits = F.sort_array(F.array_intersect(F.array_distinct(k), _terms(first)))
        paired = (F.coalesce(rating.isin(ratings), F.lit(False)) | F.arrays_overlap(k, _terms(second))
                  | F.coalesce(nl.rlike(text), F.lit(False)))
        return let(hits, lambda h: F.when((F.size(h) > 0) & paired, F.array_join(h, ", ")))

    return let(keys, judge)


def policy_split(df: DataFrame, **vocabulary) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with reason) over one flagged frame."""
    flagged = df.withColumn("reason", policy_flag(F.col("tags"), F.col("rating"), F.col("nl"), **vocabulary))
    return flagged.where(F.col("reason").isNull()).drop("reason"), flagged.where(F.col("reason").isNotNull())
