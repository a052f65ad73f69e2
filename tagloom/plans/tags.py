"""Tag text, predictions and tag lists."""
from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import select as S
from ..session import checkpoint_folder
from ..settings import defaults_for
from ..sources.files import tag_dictionary
from ..operators.tagger import predictions
from .registry import query
from .views import RAW, SCORES, raw, table, tag_scores, texts

# A neutral pattern table for part names, shaped like the built-in groups.
GROUPS = {"colour_part": ["(red|blue|green) (plate|ring|bolt)"], "old_part": ["old .+"]}
PROJECT = defaults_for("anima", general_threshold=0.3, character_threshold=0.5, max_tags=6, trigger="hot_gear",
                       prune_groups=["colour_part"], blacklist="small w*, large [ap]*", vlm_tags="merge",
                       vlm_artist_tags=True)
_PRUNED = "^(?:(red|blue|green) (plate|ring|bolt))$"
_BLACK = "^(?:small w.*)$|^(?:large [ap].*)$"

CANON = r"""CASE WHEN regexp_matches({0}, '(?i)^(score_\d+(_up)?|source_[a-z0-9]+|rating_[a-z]+)$') THEN {0}
    ELSE trim(regexp_replace(replace({0}, '_', ' '), '\s+', ' ', 'g')) END"""
_BARE = r"replace(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\(', '('), '\)', ')')"


def canon_sql(c: str) -> str:
    return CANON.format(_BARE.format(c))


@query("canon_tags", f"""SELECT o_orderkey AS id, {canon_sql("p")} AS tag FROM (
    SELECT o_orderkey, '  ' || lower(o_orderpriority) || '_\\(' || o_orderstatus || '\\)  x__y ' AS p FROM orders
    UNION ALL SELECT o_orderkey, ' score_' || (o_orderkey % 10) || '_up' FROM orders)""")
def canon_tags(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit("_\\("), "o_orderstatus", F.lit("\\)  x__y "))
    both = o.select("o_orderkey", text.alias("p")).union(o.select("o_orderkey", F.concat(
        F.lit(" score_"), (F.col("o_orderkey") % 10).cast("string"), F.lit("_up"))))
    return both.select(F.col("o_orderkey").alias("id"), T.canon(F.col("p")).alias("tag"))


@query("split_tags", f"""WITH p AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (
      SELECT doc_id, string_split_regex(text, '[,\\n]') AS l FROM documents)),
    c AS (SELECT doc_id, pos, {canon_sql("t")} AS t FROM p),
    f AS (SELECT doc_id, lower(t) AS k, min(pos) AS pos, arg_min(t, pos) AS t FROM c WHERE t <> '' GROUP BY 1, 2)
    SELECT doc_id, string_agg(t, '|' ORDER BY pos) AS tags, count(*) AS n FROM f GROUP BY 1""")
def split_tags(spark, sf):
    """Whole texts, split on commas and line breaks."""
    d = texts(spark, sf).select("doc_id", T.split_tags(F.col("text")).alias("t"))
    return d.where(F.size("t") > 0).select("doc_id", F.array_join("t", "|").alias("tags"), F.size("t").cast("long").alias("n"))


@query("format_tags", r"""SELECT p_partkey AS id, replace(p_name || '_(' || lower(p_brand) || ')', '_', ' ') AS spaced,
    replace(replace(replace(replace(p_name || '_(' || lower(p_brand) || ')', '_', ' '), ' ', '_'), '(', '\('), ')', '\)') AS underscored
    FROM part""")
def format_tags(spark, sf):
    t = F.concat("p_name", F.lit("_("), F.lower("p_brand"), F.lit(")"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.format_tag(t).alias("spaced"),
                                           T.format_tag(t, False, True).alias("underscored"))


@query("prune_tags", f"""WITH {SCORES} SELECT entity, tag, regexp_matches(replace(tag, '_', ' '), '{_PRUNED}') AS pruned,
    regexp_matches(replace(tag, '_', ' '), '^(?:old .+)$') AS old FROM tag_scores""")
def prune_tags(spark, sf):
    t = F.col("tag")
    return tag_scores(spark, sf).select("entity", "tag", T.matches_groups(t, ["colour_part"], GROUPS).alias("pruned"),
                                        T.matches_groups(t, ["old_part"], GROUPS).alias("old"))


@query("blacklist_tags", f"""WITH {SCORES} SELECT entity, tag, category, score FROM tag_scores
    WHERE NOT regexp_matches(replace(tag, '_', ' '), '{_BLACK}')""")
def blacklist_tags(spark, sf):
    return tag_scores(spark, sf).where(~T.matches_globs(F.col("tag"), T.split_text(PROJECT["blacklist"])))


@query("score_floor", f"""WITH {SCORES} SELECT entity, tag, category, round(score, 4) AS score FROM tag_scores WHERE score >= 0.15""")
def score_floor(spark, sf):
    return S.score_floor(tag_scores(spark, sf))


@query("tags_threshold", f"""WITH {SCORES} SELECT entity, category, string_agg(tag, ',' ORDER BY score DESC, tag) AS tags
    FROM tag_scores WHERE score >= CASE WHEN category = 'character' THEN 0.85 ELSE 0.35 END GROUP BY 1, 2""")
def tags_threshold(spark, sf):
    kept = S.above(tag_scores(spark, sf), 0.35, 0.85)
    # one record's tags are bounded by the vocabulary
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "tag")))
    return kept.groupBy("entity", "category").agg(F.array_join(F.transform(listed, lambda x: x["tag"]), ",").alias("tags"))


_KEEP = f"t <> '' AND lower(t) <> 'hot gear' AND NOT regexp_matches(t, '{_PRUNED}') AND NOT regexp_matches(t, '{_BLACK}')"
SELECTED = RAW + f""",
sure AS (SELECT entity, list(replace(tag, '_', ' ')) AS l FROM tag_scores WHERE category = 'character' AND score >= 0.5 GROUP BY 1),
trust AS (SELECT r.entity, coalesce(len(s.l), 0) = 0 OR coalesce(list_has_any(s.l, v.v_char), false) AS ok
  FROM raw r LEFT JOIN sure s ON s.entity = r.entity LEFT JOIN vlm v ON v.entity = r.entity),
cand AS (
  SELECT entity, CASE category WHEN 'character' THEN 1 ELSE 5 END AS bucket, -score AS o1, tag AS o2, replace(tag, '_', ' ') AS t
    FROM tag_scores WHERE score >= CASE category WHEN 'character' THEN 0.5 ELSE 0.3 END
  UNION ALL SELECT l.entity, CASE part WHEN 'character' THEN 2 WHEN 'copyright' THEN 3 WHEN 'artist' THEN 4 ELSE 5 END,
    1, tag, CASE part WHEN 'artist' THEN '@' || tag ELSE tag END FROM vlm_lines l JOIN trust u ON u.entity = l.entity
    WHERE u.ok OR part NOT IN ('character', 'copyright')),
placed AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY bucket, o1, o2) AS pos FROM cand WHERE {_KEEP}),
firsts AS (SELECT entity, lower(t) AS k, min(pos) AS pos, arg_min(t, pos) AS t FROM placed GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY pos) AS rn FROM firsts),
selected AS (SELECT r.entity, coalesce(list(k.t ORDER BY k.rn) FILTER (k.rn <= 6), []) AS tags
  FROM raw r LEFT JOIN ranked k ON k.entity = r.entity GROUP BY 1)"""


@query("select_tags", f"WITH {SELECTED} SELECT entity, array_to_string(tags, '|') AS tags, len(tags) AS n FROM selected")
def select_tags(spark, sf):
    t = S.select_tags(F.col("raw"), PROJECT, GROUPS)
    return raw(spark, sf).select("entity", t.alias("t")).select(
        "entity", F.array_join("t", "|").alias("tags"), F.size("t").cast("long").alias("n"))


@query("vlm_trust", f"WITH {SELECTED} SELECT entity, ok AS trusted FROM trust")
def vlm_trust(spark, sf):
    return raw(spark, sf).select("entity", S.trusted(F.col("raw.character"), F.col("raw.vlm.character"), PROJECT).alias("trusted"))


@query("top_rating", """WITH r AS (SELECT l_orderkey AS entity, CASE l_linestatus || l_returnflag WHEN 'OA' THEN 'general' WHEN 'ON' THEN 'sensitive'
      WHEN 'OR' THEN 'questionable' ELSE 'explicit' END AS name, max(l_discount) AS s FROM lineitem GROUP BY 1, 2)
    SELECT entity, arg_max(name, (s, -CASE name WHEN 'general' THEN 1 WHEN 'sensitive' THEN 2 WHEN 'questionable' THEN 3 ELSE 4 END)) AS rating
    FROM r GROUP BY 1""")
def top_rating(spark, sf):
    """Four fixed ratings per record: one conditional aggregate each, then the first maximum."""
    key = F.concat("l_linestatus", "l_returnflag")
    name = F.when(key == "OA", "general").when(key == "ON", "sensitive").when(key == "OR", "questionable").otherwise("explicit")
    names = ["general", "sensitive", "questionable", "explicit"]
    wide = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), name.alias("name"), "l_discount") \
        .groupBy("entity").agg(*[F.max(F.when(F.col("name") == n, F.col("l_discount"))).alias(n) for n in names])
    m = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull())
    return wide.select("entity", S.top_rating(m).alias("rating"))


@query("tag_union", f"""WITH {RAW}, u AS (SELECT entity, tag AS t, 1 AS part, tag AS o FROM (SELECT entity, upper(replace(tag, '_', ' ')) AS tag FROM tag_scores)
      UNION ALL SELECT entity, tag, 2, tag FROM vlm_lines),
    p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY part, o) AS pos FROM u),
    f AS (SELECT entity, lower(t) AS k, min(pos) AS pos, arg_min(t, pos) AS t FROM p GROUP BY 1, 2)
    SELECT entity, string_agg(t, '|' ORDER BY pos) AS tags FROM f GROUP BY 1""")
def tag_union(spark, sf):
    """Upper-case tagger names first, then language-model names: the first spelling wins."""
    r = F.col("raw")
    first = F.sort_array(F.transform(F.concat(r["general"], r["character"]), lambda x: F.upper(T.canon(x["name"]))))
    v = r["vlm"]
    second = F.sort_array(F.concat(v["character"], v["copyright"], v["artist"], v["general"]))
    return raw(spark, sf).select("entity", F.array_join(T.tidy(F.concat(first, second)), "|").alias("tags"))


@query("merge_predictions", f"""WITH {SELECTED} SELECT r.entity, array_to_string(CASE WHEN len(r.general) > 1 THEN s.tags ELSE ['kept'] END, '|') AS tags,
    CASE WHEN v.entity IS NULL OR len(r.chars) = 0 THEN 'error' ELSE 'done' END AS status,
    nullif(concat_ws('; ', CASE WHEN v.entity IS NULL THEN 'no reply' END, CASE WHEN len(r.chars) = 0 THEN 'no character' END), '') AS error
    FROM raw r JOIN selected s ON s.entity = r.entity LEFT JOIN vlm v ON v.entity = r.entity""")
def merge_predictions(spark, sf):
    r = F.col("raw")
    silent = F.size(F.concat(*[r["vlm"][k] for k in ("character", "copyright", "artist", "general")])) == 0
    errors = F.array(F.when(silent, "no reply"), F.when(F.size(r["character"]) == 0, "no character"))
    tags, status, error = S.merge_predictions(F.size(r["general"]) > 1, S.select_tags(r, PROJECT, GROUPS),
                                              F.array(F.lit("kept")), errors)
    return raw(spark, sf).select("entity", F.array_join(tags, "|").alias("tags"), status.alias("status"), error.alias("error"))


@query("tag_dim", """SELECT p_partkey AS tag_id, p_name AS name, CASE p_type WHEN 'PROMO' THEN 'character' WHEN 'LARGE' THEN 'rating' ELSE 'general' END AS category FROM part""")
def tag_dim(spark, sf):
    """A tag dictionary written from the part table in its CSV shape and read back."""
    code = F.when(F.col("p_type") == "PROMO", 4).when(F.col("p_type") == "LARGE", 9).otherwise(0)
    place = f"{checkpoint_folder(spark).rstrip('/')}/tags-{uuid4().hex}"
    table(spark, sf, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("name"), code.alias("category"),
                                    F.col("p_size").alias("count")).write.option("header", True).csv(place)
    return tag_dictionary(spark, place)


HEADS = [("general", "rating"), ("sensitive", "rating"), ("sky", "general"), ("tree", "general"), ("smile", "general"), ("alice", "character"), ("bob", "character")]


def _linear():
    """A linear tagger of 64 numbers; stands for any model that is loaded once in a worker."""
    weights = np.array([[((7 * i + 3 * j) % 11 - 5) / 2.0 for i in range(len(HEADS))] for j in range(64)])
    return lambda x: 1 / (1 + np.exp(-(np.asarray(x, np.float64) @ weights)))


def _with_category(kind):
    return lambda x: F.struct(F.lit(kind).alias("category"), x["name"].alias("name"), x["score"].alias("score"))


@query("tag_predictions", f"""WITH l(i, name, category) AS (VALUES {", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(HEADS))}),
    s AS (SELECT vec_id, name, category, 1 / (1 + exp(-list_sum([CAST(embedding[j + 1] AS DOUBLE) * ((7 * i + 3 * j) % 11 - 5) / 2.0 FOR j IN range(64)]))) AS score FROM embeddings, l)
    SELECT vec_id, category, name, round_even(score, 4) AS score FROM s WHERE category = 'rating' OR score >= 0.15""")
def tag_predictions(spark, sf):
    """Scores of a batch model over every vector, stored as a tagger stores them."""
    p = predictions(table(spark, sf, "embeddings").select("vec_id", "embedding"), _linear, "embedding", 64, HEADS)
    marked = [F.transform(kind, _with_category(kind)) for kind in ("rating", "general", "character")]
    return p.select("vec_id", F.explode(F.concat(*marked)).alias("x")).select("vec_id", "x.category", "x.name", "x.score")
