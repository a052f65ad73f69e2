"""Scores to ordered tag lists."""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import (
    canon_all, canon_sql, canon_text, each, globs_regex, groups_regex, is_count_sql, let, only, quoted, split_text, tidy,
)
from ..settings import PROFILES, PRUNE_GROUPS

SCORE_FLOOR = 0.15  # fixed value: weaker predictions are not stored


def empty() -> Column:
    return F.array().cast("array<string>")


def score_floor(scores: DataFrame, floor: float = SCORE_FLOOR) -> DataFrame:
    """Drop weak predictions, then round half-even to four places."""
    return scores.where(F.col("score") >= floor).withColumn("score", F.bround("score", 4))


def above(scores: DataFrame, general: float, character: float) -> DataFrame:
    limit = F.when(F.col("category") == "character", F.lit(character)).otherwise(F.lit(general))
    return scores.where(F.col("score") >= limit)


def ranked(scores: Column, threshold: float) -> Column:
    """Canonical names at or above the threshold, best first, input order on ties."""
    kept = only(scores, f"s -> s.score >= {threshold}D")
    keyed = F.sort_array(each(kept, "(s, i) -> struct(-s.score AS o, i AS i, s.name AS n)"))
    return each(keyed, "s -> " + canon_sql("s.n"))


def trusted(character: Column, vlm_character: Column, settings: dict[str, Any]) -> Column:
    """Names from the language model count only if the tagger saw no character, or agrees on one."""
    if settings["vlm_tags"] == "only":
        return F.lit(True)
    sure = each(only(character, f"s -> s.score >= {settings['character_threshold']}D"), f"s -> lower({canon_sql('s.name')})")
    told = each(vlm_character, f"x -> lower({canon_sql('x')})")
    return let(sure, lambda s: (F.size(s) == 0) | F.coalesce(F.arrays_overlap(s, told), F.lit(False)))


def vlm_parts(raw: Column, settings: dict[str, Any]) -> dict[str, Column]:
    """Which language-model lists the settings accept: character, copyright, artist, general."""
    mode = settings["vlm_tags"]
    if mode == "off":
        return {k: empty() for k in ("character", "copyright", "artist", "general")}
    vlm = raw["vlm"]

    def names(key: str, prefix: str = "") -> Column:
        named = canon_all(F.coalesce(vlm[key], empty()))
        return each(named, f"x -> concat({quoted(prefix)}, x)") if prefix else named

    ok = trusted(raw["character"], F.coalesce(vlm["character"], empty()), settings)
    artist = PROFILES[settings["profile"]].get("artist_prefix", "")
    return {
        "character": F.when(ok, names("character")).otherwise(empty())
        if settings["include_character_tags"] else empty(),
        "copyright": F.when(ok, names("copyright")).otherwise(empty()),
        "artist": names("artist", artist) if settings["vlm_artist_tags"] else empty(),
        "general": names("general") if mode in ("merge", "only") else empty(),
    }


def removable_sql(x: str, settings: dict[str, Any], groups: dict[str, list[str]] | None = None) -> str:
    """Pruned by pattern group or blacklisted."""
    table = PRUNE_GROUPS if groups is None else groups
    regexes = [groups_regex(settings["prune_groups"], table), globs_regex(split_text(settings["blacklist"]))]
    tests = [f"lower({canon_sql(x)}) RLIKE {quoted(r)}" for r in regexes if r]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def select_tags(raw: Column, settings: dict[str, Any], groups: dict[str, list[str]] | None = None) -> Column:
    """Ordered tag list of one record from ``raw`` = struct(general, character, vlm).

    People counts, characters, then language-model characters, works and artists, then everything else. Filters run
    before the distinct, the distinct before the cap. One record's predictions are bounded by the tag vocabulary, so
    the whole rule is a row expression and needs no shuffle.
    """
    tagger = settings["vlm_tags"] != "only"
    general = ranked(raw["general"], settings["general_threshold"]) if tagger else empty()
    chars = ranked(raw["character"], settings["character_threshold"]) \
        if tagger and settings["include_character_tags"] else empty()
    vlm = vlm_parts(raw, settings)
    trigger = canon_text(settings["trigger"]).lower()

    def assemble(g: Column) -> Column:
        return F.concat(only(g, f"x -> {is_count_sql('x')}"), chars, vlm["character"], vlm["copyright"], vlm["artist"],
                        only(g, f"x -> NOT {is_count_sql('x')}"))

    candidates = let(F.concat(general, vlm["general"]), assemble)
    kept = only(candidates, f"x -> x <> '' AND lower(x) <> {quoted(trigger)} AND NOT {removable_sql('x', settings, groups)}")
    ordered = tidy(kept)
    cap = settings["max_tags"]
    return F.slice(ordered, 1, cap) if cap > 0 else ordered


def apply_filters(tags: Column, settings: dict[str, Any], groups: dict[str, list[str]] | None = None) -> Column:
    return only(tags, f"x -> NOT {removable_sql('x', settings, groups)}")


def top_rating(rating: Column) -> Column:
    """Name with the highest score; the first entry wins a tie."""
    entries = F.transform(F.map_entries(rating),
                          lambda e, i: F.struct((-e["value"]).alias("o"), i.alias("i"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def merge_predictions(fresh: Column, new_tags: Column, old_tags: Column, errors: Column) -> tuple[Column, ...]:
    """Re-derive tags only when something new was predicted; any error marks the record."""
    found = F.filter(errors, lambda e: e.isNotNull())
    tags = F.when(fresh, new_tags).otherwise(old_tags)
    return tags, F.when(F.size(found) > 0, "error").otherwise("done"), F.nullif(F.array_join(found, "; "), F.lit(""))
