"""Caption assembly, training hints, and fitting a caption into a length limit."""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import (
    COUNT_TAG, canon_sql, canon_text, collapse, dedupe_ci, each, format_all, format_sql, format_text, let,
    only, quoted, split_text, strip, strip_sql,
)
from ..settings import PROFILES
from .select import empty, vlm_parts

MAX_CAPTION = 1024  # fixed value


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _words(text: str, s: dict[str, Any]) -> list[str]:
    return [format_text(t, s["underscore_to_space"], s["escape_parentheses"]) for t in split_text(text)]


def _lits(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def block_words(has_blocks: Column, s: dict[str, Any]) -> Column:
    """Keywords for a detected region, when the project asks for them."""
    if not s["block_tag_auto"]:
        return empty()
    return F.when(F.coalesce(has_blocks, F.lit(False)), _lits(split_text(s["block_tag"]))).otherwise(empty())


def leading_names(raw: Column, s: dict[str, Any]) -> Column:
    """Names that may stand before a rating tag: tagger characters and accepted language-model names."""
    vlm = vlm_parts(raw, s)
    return F.concat(raw["character"]["name"], vlm["character"], vlm["copyright"],
                    vlm["artist"])


def rating_word(rating: Column, s: dict[str, Any]) -> Column:
    table = PROFILES[s["profile"]]["rating_map"]
    if not (s["include_rating"] and table):
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[rating]


def place_after_people(tags: Column, body: Column, word: Column, names: Column) -> Column:
    """Insert ``word`` after the leading run of people-count and name tags."""
    known = each(names, f"n -> lower({canon_sql('n')})")

    def insert(known_names: Column) -> Column:
        def at(keys: Column) -> Column:
            leads = F.transform(keys, lambda t, i: F.when(
                ~(t.rlike(COUNT_TAG) | F.coalesce(F.array_contains(known_names, t), F.lit(False))), i))
            return F.coalesce(F.array_min(leads), F.size(tags))

        return let(let(each(tags, f"t -> lower({canon_sql('t')})"), at), lambda n: F.concat(
            F.slice(body, F.lit(1), n), F.array(word), F.slice(body, n + 1, F.size(body))))

    return F.when(word.isNull(), body).otherwise(let(known, insert))


def _description(nl: Column, s: dict[str, Any], body: Column) -> Column:
    """Collapsed description with the trigger's own spelling restored."""
    text = collapse(F.coalesce(nl, F.lit("")))
    trigger = s["trigger"].strip()
    if trigger:
        safe = trigger.replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, r"(?iU)(?<!\w)" + _quote(trigger) + r"(?!\w)", safe)
    if s["caption_mode"] == "hybrid":
        text = F.when(F.size(body) > 0, F.regexp_replace(text, r"\.+$", "")).otherwise(text)
    return text


def caption_parts(tags: Column, nl: Column, rating: Column, names: Column, extra: Column, s: dict[str, Any]) -> Column:
    """The caption's pieces in order, before the final distinct."""
    u2s, esc = s["underscore_to_space"], s["escape_parentheses"]
    fmt = lambda a: format_all(a, u2s, esc)
    trigger, mode = s["trigger"].strip(), s["caption_mode"]
    extra = fmt(extra)
    if mode == "trigger_only":
        fixed = F.filter(F.concat(_lits([x for x in (trigger, s["class_word"].strip()) if x]), extra),
                         lambda x: x != "")
        return F.when(F.size(fixed) > 0, fixed).otherwise(fmt(tags))
    prefix = _lits(_words(s["prefix_tags"], s))
    quality = _lits(_words(s["quality_tags"], s) if s["add_quality_tags"] else [])
    append = F.concat(_lits(_words(s["append_tags"], s)), extra)
    word = rating_word(rating, s)
    body = fmt(tags)
    if PROFILES[s["profile"]].get("rating_position") == "prefix":
        prefix = F.concat(prefix, F.when(word.isNull(), empty()).otherwise(F.array(word)))
    elif s["include_rating"] and PROFILES[s["profile"]]["rating_map"]:
        body = place_after_people(tags, body, word, names)

    def lay_out(b: Column) -> Column:
        def with_text(text: Column) -> Column:
            said = F.when(text == "", empty()).otherwise(F.array(text))
            head = _lits([trigger] if trigger else [])
            if mode == "natural":
                if trigger:
                    starts = text.rlike(r"(?iU)^" + _quote(trigger) + r"(?!\w)")
                    head = F.when(starts, empty()).otherwise(head)
                return F.concat(head, prefix, quality, F.when(text == "", b).otherwise(said), append)
            if mode == "hybrid":
                middle = (b, said) if s["nl_position"] == "after_tags" else (said, b)
                return F.concat(head, prefix, quality, *middle, append)
            return F.concat(head, prefix, quality, b, append)

        return let(_description(nl, s, b), with_text)

    return let(body, lay_out)


def build_caption(tags: Column, nl: Column, rating: Column, names: Column, extra: Column, s: dict[str, Any]) -> Column:
    parts = caption_parts(tags, nl, rating, names, extra, s)
    if s["caption_mode"] == "trigger_only":
        return F.array_join(parts, ", ")
    stripped = only(each(parts, "x -> " + strip_sql("x")), "x -> x <> ''")
    return F.array_join(dedupe_ci(stripped), ", ")


def training_hints(s: dict[str, Any]) -> dict[str, Any]:
    """Shuffle advice and the number of leading pieces to keep in place. Depends on settings alone."""
    profile = PROFILES[s["profile"]]
    if s["caption_mode"] in ("natural", "trigger_only") or not profile.get("shuffle_caption", True):
        return {"shuffle_caption": False, "keep_tokens": 0}
    fixed = [
        bool(s["trigger"].strip()),
        len(split_text(s["prefix_tags"])),
        len(split_text(s["quality_tags"])) if s["add_quality_tags"] else 0,
        bool(s["include_rating"] and profile["rating_map"] and profile.get("rating_position") == "prefix"),
        s["caption_mode"] == "hybrid" and s["nl_position"] == "before_tags",
    ]
    return {"shuffle_caption": True, "keep_tokens": int(sum(fixed))}


def _scored(tags: Column, general: Column) -> Column:
    """array<struct<tag,i,t,k,score>>: every tag with its prediction score, by one sort of tags and scores together. Of several scores of one
    canonical name the last counts, and it counts for every repeat of the tag."""
    none = F.expr("cast(array() as array<struct<name:string,score:double>>)")
    scores = each(F.coalesce(general, none), f"(g, i) -> struct(lower({canon_sql('g.name')}) AS k, false AS tag, i AS i, "
                                             "cast(g.score as double) AS s, cast(null as string) AS t)")
    rows = F.concat(scores, each(tags, f"(t, i) -> struct(lower({canon_sql('t')}) AS k, true AS tag, i AS i, "
                                       "cast(null as double) AS s, t AS t)"))
    last = let(F.sort_array(rows), "a -> filter(a, (x, j) -> x.tag OR coalesce(get(a, j + 1).tag OR get(a, j + 1).k <> x.k, true))")
    # Equal names now stand side by side, the score first. It is handed on over distances of 1, 2, 4 ... so that no step depends on all before it.
    attached = let(last, (
        "a -> aggregate(sequence(0, cast(ceil(log2(greatest(size(a), 1))) as int)), transform(a, x -> x.s), "
        "(s, j) -> transform(s, (v, i) -> coalesce(v, CASE WHEN get(a, i - shiftleft(1, j)).k = get(a, i).k THEN get(s, i - shiftleft(1, j)) END)), "
        "s -> transform(a, (x, i) -> struct(x.tag AS tag, x.i AS i, x.t AS t, x.k AS k, get(s, i) AS score)))"))
    return only(attached, "x -> x.tag")


def fit_captions(df: DataFrame, s: dict[str, Any], limit: int = MAX_CAPTION) -> DataFrame:
    """Caption of at most ``limit`` characters, giving up the least sure tags first.

    Input columns: tags, nl, rating, names, extra, general (array<struct<name,score>>). Adds ``caption`` and
    ``removed``. The tags are put in removal order once, and one pass over that order finds how many must go: a tag
    whose text is also a fixed piece frees nothing, every other tag frees its length plus the separator. Everything
    is a sort or a scan inside the row, so long texts cost O(n log n).
    """
    keep = ", ".join(quoted(canon_text(k).lower()) for k in split_text(s["block_tag"]))
    shown = strip_sql(format_sql(canon_sql("x.t"), s["underscore_to_space"], s["escape_parentheses"]))
    nl, rating, names, extra = F.col("nl"), F.col("rating"), F.col("names"), F.col("extra")
    base = df.withColumn("_full", build_caption(F.col("tags"), nl, rating, names, extra, s))
    long = F.length("_full") > limit
    fixed = each(caption_parts(empty(), nl, rating, names, extra, s), f"x -> lower({strip_sql('x')})")
    base = base.withColumn("_fixed", F.when(long, F.array_distinct(fixed))) \
               .withColumn("_scored", F.when(long, _scored(F.col("tags"), F.col("general"))))
    # The fixed pieces are bound outside the lambda over tags: a column made of them may be inlined there, and then they are made anew for each tag.
    order = let(F.col("_fixed"), (
        f"fixed -> sort_array(transform(filter(_scored, x -> x.k NOT IN ({keep})), "
        "x -> struct(x.score IS NULL AS unscored, coalesce(x.score, 0D) AS score, -x.i AS back, x.t AS t, "
        f"CASE WHEN array_contains(fixed, lower({shown})) THEN 0 ELSE length({shown}) + 2 END AS frees)))"))
    base = base.withColumn("_order", F.when(long, order))
    bodiless = s["caption_mode"] == "trigger_only" and bool(s["trigger"].strip() or s["class_word"].strip())
    frees = (lambda x: F.lit(0)) if bodiless else (lambda x: x["frees"])
    start = F.struct(F.length("_full").cast("int").alias("len"), F.lit(0).alias("n"))
    walked = F.aggregate("_order", start, lambda acc, x: F.when(acc["len"] <= limit, acc).otherwise(
        F.struct((acc["len"] - frees(x)).cast("int").alias("len"), (acc["n"] + 1).cast("int").alias("n"))))
    count = walked["n"]
    if s["caption_mode"] == "natural":  # a described record shows no tags, so no removal helps
        count = F.when(collapse(F.coalesce(nl, F.lit(""))) != "", F.size("_order")).otherwise(count)
    base = base.withColumn("_n", F.when(long, count).otherwise(0))
    stay = each(only(F.col("_scored"), f"x -> x.k IN ({keep})"), "x -> struct(x.i AS i, x.t AS t)")
    rest = each(F.slice("_order", F.col("_n") + 1, F.greatest(F.size("_order"), F.lit(0))),
                "x -> struct(-x.back AS i, x.t AS t)")
    kept = each(F.sort_array(F.concat(stay, rest)), "x -> x.t")
    base = base.withColumn("_kept", F.when(long, kept).otherwise(F.col("tags")))
    base = base.withColumn("_short", F.when(long, build_caption(F.col("_kept"), nl, rating, names, extra, s))
                           .otherwise(F.col("_full"))).withColumn("_suffix", F.array_join("extra", ", "))
    text, suffix = F.col("_short"), F.col("_suffix")
    without = F.when((suffix != "") & F.endswith(text, suffix), F.regexp_replace(
        F.substring(text, F.lit(1), F.length(text) - F.length(suffix)), "[, ]+$", "")).otherwise(text)
    room = F.lit(limit) - F.when(suffix != "", F.length(suffix) + 2).otherwise(0)
    cut = let(F.substring(without, F.lit(1), room), lambda c: F.when(
        F.contains(c, F.lit(",")), F.regexp_replace(c, "(?s),[^,]*$", "")).otherwise(c))
    hard = let(cut, lambda c: F.when(suffix != "", F.concat(c, F.lit(", "), suffix)).otherwise(c))
    return base.withColumn("caption", F.when(F.length(text) <= limit, text).otherwise(hard)) \
               .withColumn("removed", F.col("_n")) \
               .drop("_full", "_fixed", "_scored", "_order", "_n", "_kept", "_short", "_suffix")
