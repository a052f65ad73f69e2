"""Which pool records match: scores, manual marks, recovery by person, tag filter. Thresholds stay query-time."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----
THRESHOLDS = {"default": 0.17847511429108218, "large": 0.21323118981474148}
AMBIGUOUS = 0.02
KEEP = 2
MANUAL = {"include": 1, "exclude": -1, "keep": KEEP, "clear": None}
SKIPPED = ["overlap", "small", "no_target", "ambiguous"]
# ---- end of fixed values ----


@dataclass
class Session:
    threshold: float = THRESHOLDS["default"]
    model: str = "default"
    people_mode: str | None = None
    recover: float | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def core(s: Session) -> Column:
    """Close enough, and closer than to any negative."""
    score, neg = F.col("score"), F.col("neg_score")
    return F.coalesce((F.col("model") == s.model) & (score <= s.threshold) & (neg.isNull() | (score < neg)), F.lit(False))


def in_range(s: Session) -> Column:
    """Not a match by itself, but near enough to look at each person."""
    if not (s.people_mode and s.recover):
        return F.lit(False)
    near = (F.col("role") == "pool") & ~F.col("manual").eqNullSafe(F.lit(-1)) & (F.col("model") == s.model) & (
        F.col("score") <= s.threshold + s.recover)
    return F.coalesce(near, F.lit(False)) & ~core(s)


def recovered(s: Session) -> Column:
    return in_range(s) & F.coalesce(F.col("judge") == "found", F.lit(False))


def target(s: Session) -> Column:
    return F.when((F.col("role") != "pool") | F.col("manual").eqNullSafe(F.lit(-1)), False) \
        .when(F.col("manual").isin(1, KEEP), True).otherwise(core(s) | recovered(s))


def tag_block(s: Session) -> Column:
    """Null if the tags pass; otherwise struct(kind, tag) of the first reason."""
    reason = lambda kind, tag: F.struct(F.lit(kind).alias("kind"), tag.cast("string").alias("tag"))
    if not (s.include or s.exclude):
        return F.lit(None).cast("struct<kind:string,tag:string>")
    wanted = F.array(*[F.lit(t) for t in s.include]).cast("array<string>")
    barred = F.array(*[F.lit(t) for t in s.exclude]).cast("array<string>")
    missing = F.get(F.array_except(wanted, F.col("tags")), F.lit(0))
    present = F.get(F.array_intersect(barred, F.col("tags")), F.lit(0))
    return F.when(F.col("tags").isNull(), reason("untagged", F.lit(None))) \
        .when(missing.isNotNull(), reason("missing", missing)).when(present.isNotNull(), reason("excluded", present))


def decided(pool: DataFrame, s: Session) -> DataFrame:
    """All decision columns in one projection. ``pool``: id, role, model, score, neg_score, manual, judge, tags."""
    d = pool.withColumn("core", core(s)).withColumn("recovered", recovered(s)).withColumn("target", target(s)) \
            .withColumn("block", tag_block(s))
    keep = (F.col("role") == "pool") & F.col("manual").eqNullSafe(F.lit(KEEP))
    return d.withColumn("match", keep | (F.col("target") & F.col("block").isNull()))


def matches(pool: DataFrame, s: Session) -> DataFrame:
    return decided(pool, s).where("match").orderBy(F.col("score").asc_nulls_last(), "id")


def bucket(d: DataFrame, group: Column) -> DataFrame:
    """One bucket per visible pool row."""
    seen = d.where((F.col("role") == "pool") & (F.col("score").isNotNull() | (F.col("manual") > 0)))
    blocked = F.col("target") & F.col("block").isNotNull() & ~F.col("manual").eqNullSafe(F.lit(KEEP))
    return seen.select("id", F.when(F.col("match"), "match").when(blocked & (F.col("block.kind") == "untagged"), "untagged")
                       .when(blocked, "tagout").otherwise("other").alias("bucket"), (F.col("target") & group).alias("grouped"))


def set_manual(pool: DataFrame, marks: DataFrame) -> DataFrame:
    """Apply a mark table (id, action): include, exclude, keep or clear."""
    value = F.create_map(*[x for k, v in MANUAL.items() if v is not None for x in (F.lit(k), F.lit(v))])
    j = pool.join(marks, "id", "left")
    return j.withColumn("manual", F.when(F.col("action").isNull(), F.col("manual"))
                        .otherwise(F.try_element_at(value, F.col("action")))).drop("action")


def judge(first: Column, first_neg: Column, second: Column, threshold: float) -> Column:
    """From the two smallest person distances."""
    none = first.isNull() | (first > threshold) | F.coalesce(first_neg <= first, F.lit(False))
    unsure = F.coalesce((second <= threshold) & (second - first < AMBIGUOUS), F.lit(False))
    return F.when(none, "no_target").when(unsure, "ambiguous").otherwise("found")


def norm_filter(include: Column, exclude: Column) -> tuple[Column, Column]:
    """Distinct filter spellings; a tag on both sides stays excluded only."""
    from ..functions.tags import WHITE, each, only

    spell = f"t -> regexp_replace(btrim(lower(t), '{WHITE}'), r'(?U)\\s+', '_')"
    clean = lambda c: F.array_distinct(only(each(c, spell), "t -> t <> ''"))
    return F.array_except(clean(include), clean(exclude)), clean(exclude)
