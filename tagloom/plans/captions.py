"""Captions, hints, settings and policy."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as C
from ..functions.tags import token_estimate
from ..operators import captions as K
from ..operators import policy as P
from ..operators import select as S
from .registry import query
from .tags import GROUPS, PROJECT, SELECTED
from .views import ITEMS, PROJECTS, WORD_SCORES, items, projects, raw, table, texts, word_scores

ANIMAGINE = C.defaults_for("animagine_xl", trigger="hot gear", add_quality_tags=True, append_tags="new, Old Ring", vlm_tags="merge",
                           vlm_artist_tags=True, character_threshold=0.5, block_tag_auto=True)
PONY = C.defaults_for("pony_v6", trigger="hot gear", underscore_to_space=False)
HYBRID = C.defaults_for("sdxl_base", trigger="hot gear", nl_position="after_tags")
NATURAL = C.defaults_for("flux1_dev", trigger="hot gear", append_tags="new")
WORD_ONLY = C.defaults_for("illustrious", trigger="hot gear", class_word="thing", caption_mode="trigger_only", block_tag_auto=True)

# Records: the selected tags led by a people count, a description, a rating and a region mark, from each order.
RECORDS = SELECTED + """,
records AS (SELECT s.entity, [CAST(1 + o_custkey % 3 AS VARCHAR) || 'girls'] || s.tags AS tags,
    CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'HOT  GEAR near ' || lower(o_orderpriority) || '.' END AS nl,
    CASE o_orderstatus WHEN 'P' THEN 'general' WHEN 'F' THEN 'sensitive' ELSE 'explicit' END AS rating,
    o_totalprice > 250000 AS has_blocks,
    [replace(x.name, '_', ' ') for x in r.chars] || CASE WHEN t.ok THEN coalesce(v.v_char, []) || coalesce(v.v_copy, []) ELSE [] END
      || coalesce(v.v_artist, []) AS names
  FROM selected s JOIN orders ON o_orderkey = s.entity JOIN raw r ON r.entity = s.entity JOIN trust t ON t.entity = s.entity
    LEFT JOIN vlm v ON v.entity = s.entity)"""


def records(spark, sf):
    o = table(spark, sf, "orders")
    r = raw(spark, sf).select("entity", "raw", S.select_tags(F.col("raw"), PROJECT, GROUPS).alias("picked"))
    s = F.col("o_orderstatus")
    return r.join(o, F.col("o_orderkey") == F.col("entity")).select(
        "entity", F.concat(F.array(F.concat((1 + F.col("o_custkey") % 3).cast("string"), F.lit("girls"))), "picked").alias("tags"),
        F.when(s == "O", "").otherwise(F.concat(F.lit("HOT  GEAR near "), F.lower("o_orderpriority"), F.lit("."))).alias("nl"),
        F.when(s == "P", "general").when(s == "F", "sensitive").otherwise("explicit").alias("rating"),
        (F.col("o_totalprice") > 250000).alias("has_blocks"), K.leading_names(F.col("raw"), ANIMAGINE).alias("names"))


def caption(s):
    return K.build_caption(F.col("tags"), F.col("nl"), F.col("rating"), F.col("names"), K.block_words(F.col("has_blocks"), s), s)


def joined(parts: str) -> str:
    """SQL: case-insensitive first-wins join of a list column."""
    return (f"array_to_string(list_filter({parts}, lambda x, i: x <> '' AND "
            f"list_position(list_transform({parts}, lambda y: lower(y)), lower(x)) = i), ', ')")


_NL = "replace(trim(regexp_replace(nl, '\\s+', ' ', 'g')), 'HOT GEAR', 'hot gear')"
_LEAD = """coalesce(list_min(list_filter(list_transform(tags, lambda t, i: CASE WHEN regexp_matches(t, '^\\dgirls$')
    OR list_contains(names, t) THEN NULL ELSE i END), lambda z: z IS NOT NULL)), len(tags) + 1)"""
_SAFE_WORD = "CASE rating WHEN 'general' THEN 'safe' WHEN 'sensitive' THEN 'sensitive' ELSE 'explicit' END"
_PONY_WORD = "CASE rating WHEN 'general' THEN 'rating_safe' WHEN 'sensitive' THEN 'rating_questionable' ELSE 'rating_explicit' END"
CAPTION_SQL = f"""WITH {RECORDS}, p AS (SELECT entity, nl, tags, {_NL} AS text, rtrim({_NL}, '.') AS bare,
    ['hot gear', 'masterpiece', 'high score', 'great score', 'absurdres'] || tags[1:{_LEAD} - 1] || [{_SAFE_WORD}] || tags[{_LEAD}:]
      || ['new', 'Old Ring'] || CASE WHEN has_blocks THEN ['white rectangle'] ELSE [] END AS a,
    ['hot gear', 'source_anime', {_PONY_WORD}] || [replace(t, ' ', '_') for t in tags] AS b, has_blocks FROM records)
  SELECT entity, {joined("a")} AS by_tags, {joined("b")} AS underscored,
    array_to_string(list_filter(['hot gear'] || tags || [bare], lambda x, i: x <> '' AND list_position(list_transform(['hot gear'] || tags || [bare], lambda y: lower(y)), lower(x)) = i), ', ') AS hybrid,
    CASE WHEN nl = '' THEN {joined("(['hot gear'] || tags || ['new'])")} ELSE text || ', new' END AS described,
    'hot gear, thing' || CASE WHEN has_blocks THEN ', white rectangle' ELSE '' END AS word_only FROM p"""


@query("captions", CAPTION_SQL)
def captions(spark, sf):
    r = records(spark, sf)
    return r.select("entity", caption(ANIMAGINE).alias("by_tags"), caption(PONY).alias("underscored"),
                    caption(HYBRID).alias("hybrid"), caption(NATURAL).alias("described"), caption(WORD_ONLY).alias("word_only"))


@query("caption_rating", f"""WITH {RECORDS} SELECT entity, array_to_string(tags[1:{_LEAD} - 1] || [{_SAFE_WORD}] || tags[{_LEAD}:], '|') AS placed,
    {_LEAD} - 1 AS lead FROM records""")
def caption_rating(spark, sf):
    word = K.rating_word(F.col("rating"), ANIMAGINE)
    placed = records(spark, sf).withColumn("word", word).select(
        "entity", "word", K.place_after_people(F.col("tags"), F.col("tags"), F.col("word"), F.col("names")).alias("p"))
    return placed.select("entity", F.array_join("p", "|").alias("placed"),
                         (F.array_position("p", F.col("word")) - 1).alias("lead"))


@query("token_estimate", """SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]')) AS tokens FROM documents""")
def tokens(spark, sf):
    """Whole texts."""
    return texts(spark, sf).select("doc_id", token_estimate(F.col("text")).cast("long").alias("tokens"))


_WORD = "CASE rating WHEN 'general' THEN 'general' WHEN 'sensitive' THEN 'sensitive' WHEN 'questionable' THEN 'nsfw' END"
FIT_SQL = f"""WITH {WORD_SCORES}, t AS (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos, {_WORD} AS word, rating FROM items),
    w AS (SELECT t.*, s.score, CASE WHEN t.tag IN ('the', coalesce(word, 'the')) THEN 0 ELSE length(t.tag) + 2 END AS frees FROM t LEFT JOIN word_scores s ON s.id = t.id AND s.tag = t.tag),
    o AS (SELECT *, row_number() OVER v AS rn, sum(frees) OVER v AS freed, sum(frees) OVER (PARTITION BY id) AS body
      FROM w WINDOW v AS (PARTITION BY id ORDER BY score IS NULL, coalesce(score, 0), -pos ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, 3 + body + coalesce(length(word) + 2, 0) + length(', white rectangle') AS total FROM o),
    k AS (SELECT id, CASE WHEN any_value(total) <= 1024 THEN 0 ELSE coalesce(min(rn) FILTER (total - freed <= 1024), count(*)) END AS n FROM f GROUP BY 1),
    kept AS (SELECT f.id, list(tag ORDER BY pos) FILTER (rn > n) AS tags, any_value(word) AS word, any_value(n) AS n FROM f JOIN k ON k.id = f.id GROUP BY 1),
    p AS (SELECT i.id, ['the'] || CASE WHEN i.rating IS NULL THEN [] ELSE [{_WORD.replace('rating', 'i.rating')}] END || coalesce(kept.tags, []) || ['white rectangle'] AS parts,
      coalesce(n, 0) AS n FROM items i LEFT JOIN kept ON kept.id = i.id)
  SELECT id, {joined("parts")} AS caption, n AS removed FROM p"""


@query("caption_fit", FIT_SQL)
def caption_fit(spark, sf):
    """Every record's whole word list and whole description, fitted into 1024 characters."""
    s = C.defaults_for("noobai_xl", trigger="the", append_tags="white rectangle", max_tags=0)
    df = items(spark, sf).join(word_scores(spark, sf), "id", "left").select(
        "id", "tags", "nl", "rating", F.array().cast("array<string>").alias("names"),
        F.array().cast("array<string>").alias("extra"), "general")
    return K.fit_captions(df, s).select("id", "caption", F.col("removed").cast("long").alias("removed"))


RESOLVED = PROJECTS + """,
profile_dim(profile, family, token_limit, mode, thr, max_tags, rating, chars, vlm, prefix, pos, shuffle, quality) AS (VALUES
    ('pony_v6', 'sdxl', 75, 'tags', 0.35, 40, true, true, false, 'source_anime', 'prefix', true, 3),
    ('sdxl_base', 'sdxl', 75, 'hybrid', 0.4, 20, false, false, true, '', 'after_character', true, 0),
    ('flux1_dev', 'flux', 512, 'natural', 0.4, 30, false, false, true, '', 'after_character', true, 0),
    ('animagine_xl', 'sdxl', 75, 'tags', 0.35, 40, true, true, false, '', 'after_character', true, 4),
    ('illustrious', 'sdxl', 75, 'tags', 0.35, 40, false, true, false, '', 'after_character', true, 2)),
clean AS (SELECT * REPLACE (CASE WHEN profile = 'mystery' THEN 'illustrious' ELSE profile END AS profile,
    CASE WHEN lora_type = 'odd' THEN 'character' ELSE lora_type END AS lora_type) FROM projects),
resolved AS (SELECT c.project_id, c.class_word, c.profile, c.lora_type, d.family, d.token_limit,
    CASE WHEN o_caption_mode IS NULL THEN d.mode WHEN o_caption_mode = 'weird' THEN 'tags' ELSE o_caption_mode END AS caption_mode,
    CAST(least(1.0, greatest(0.0, coalesce(try_cast(o_general_threshold AS DOUBLE), d.thr))) AS DOUBLE) AS general_threshold,
    greatest(0, coalesce(try_cast(o_max_tags AS INT), d.max_tags)) AS max_tags, trim(coalesce(o_trigger, '')) AS trigger,
    CASE WHEN trim(coalesce(o_block_tag, ',')) = ',' THEN 'white rectangle' ELSE 'white box, grey' END AS block_tag,
    CASE WHEN o_vlm_tags IS NULL OR o_vlm_tags = 'bad' THEN 'off' ELSE o_vlm_tags END AS vlm_tags, o_use_wd14 AS use_wd14,
    d.chars AND c.lora_type <> 'style' AS include_character_tags, d.rating AS include_rating, d.vlm AS use_vlm, d.prefix AS prefix_tags,
    d.pos AS rating_position, d.shuffle AS shuffle_caption, CASE WHEN coalesce(o_add_quality_tags, false) THEN d.quality ELSE 0 END AS quality_tags, coalesce(o_nl_position, '') <> 'after_tags' AS text_first,
    CASE c.lora_type WHEN 'character' THEN 'hair_color,eye_color' WHEN 'style' THEN 'style_medium' ELSE '' END AS prune_groups
  FROM clean c JOIN profile_dim d ON d.profile = c.profile)"""
_SHOWN = ["project_id", "profile", "lora_type", "family", "token_limit", "caption_mode", "general_threshold", "max_tags", "trigger",
          "block_tag", "vlm_tags", "use_wd14", "include_character_tags", "prune_groups"]


@query("settings_resolved", f"WITH {RESOLVED} SELECT {', '.join(_SHOWN)} FROM resolved")
def settings_resolved(spark, sf):
    return C.resolve_settings(projects(spark, sf)).select(*_SHOWN)


@query("profile_switch", f"""WITH {RESOLVED} SELECT project_id, lora_type, trigger, class_word, '' AS blacklist, 'server' AS vlm_engine, '' AS vlm_cli_model, 'sdxl_base' AS profile, 'sdxl' AS family,
    'hybrid' AS caption_mode, 0.4::DOUBLE AS general_threshold, 20 AS max_tags, false AS include_character_tags FROM resolved""")
def profile_switch(spark, sf):
    return C.switch_profile(C.resolve_settings(projects(spark, sf)), F.lit("sdxl_base"))


@query("config_problems", f"""WITH {RESOLVED} SELECT project_id, NOT (caption_mode = 'trigger_only' OR use_wd14 OR (use_vlm AND caption_mode IN ('natural', 'hybrid'))
    OR vlm_tags <> 'off') AS nothing_to_generate, use_vlm AND caption_mode IN ('natural', 'hybrid') AS needs_text, vlm_tags <> 'off' AS needs_vlm_tags FROM resolved""")
def config_problems(spark, sf):
    r = C.resolve_settings(projects(spark, sf))
    return r.select("project_id", C.nothing_to_generate(r).alias("nothing_to_generate"), C.needs_text(r).alias("needs_text"),
                    (F.col("vlm_tags") != "off").alias("needs_vlm_tags"))


@query("settings_rejected", f"""WITH {PROJECTS} SELECT project_id, 'general_threshold' AS setting FROM projects WHERE o_general_threshold = 'high'
    UNION ALL SELECT project_id, 'profile' FROM projects WHERE profile = 'mystery'""")
def settings_rejected(spark, sf):
    return C.bad_overrides(projects(spark, sf))


@query("training_hints", f"""WITH {RESOLVED} SELECT project_id, caption_mode NOT IN ('natural', 'trigger_only') AS shuffle_caption,
    CASE WHEN caption_mode IN ('natural', 'trigger_only') THEN 0 ELSE CAST(trigger <> '' AS INT) + CASE WHEN prefix_tags = '' THEN 0 ELSE 1 END
      + CAST(include_rating AND rating_position = 'prefix' AS INT) + CAST(quality_tags AS INT) + CAST(caption_mode = 'hybrid' AND text_first AS INT) END AS keep_tokens FROM resolved""")
def training_hints(spark, sf):
    return C.hint_columns(C.resolve_settings(projects(spark, sf)))


# A neutral vocabulary for the checks: the rule is the same, the word lists are parameters.
VOCABULARY = dict(first=["the", "les", "der", "una"], second=["with", "dans", "nicht"], text=r"(?i)\b(avec|und|that)\b")
_HITS = "list_sort(list_filter(['the', 'les', 'der', 'una'], lambda w: list_contains(tags, w)))"
FLAGGED = ITEMS + f""",
flagged AS (SELECT *, CASE WHEN len({_HITS}) > 0 AND (coalesce(rating IN ('questionable', 'explicit'), false) OR list_has_any(tags, ['with', 'dans', 'nicht'])
    OR regexp_matches(nl, '(?i)\\b(avec|und|that)\\b')) THEN array_to_string({_HITS}, ', ') END AS reason FROM items)"""


@query("policy_flag", f"WITH {FLAGGED} SELECT id, reason FROM flagged")
def policy_flag(spark, sf):
    return items(spark, sf).select("id", P.policy_flag(F.col("tags"), F.col("rating"), F.col("nl"), **VOCABULARY).alias("reason"))


@query("policy_split", f"WITH {FLAGGED} SELECT project_id, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS excluded FROM flagged GROUP BY 1")
def policy_split(spark, sf):
    reason = P.policy_flag(F.col("tags"), F.col("rating"), F.col("nl"), **VOCABULARY)
    flagged = items(spark, sf).select("project_id", reason.alias("reason"))
    return flagged.groupBy("project_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("excluded"))
