"""Reference matching."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import score as SC
from ..operators import stats as A
from .registry import query
from .views import FEATURES, SCORES, detections, features, table, tag_scores

S = M.Session(threshold=0.93, people_mode="crop", recover=0.06, include=["red_ring"], exclude=["old_gear", "hot_bolt"])
DOT = "list_dot_product(p.embedding::DOUBLE[], r.embedding::DOUBLE[])"
SCORED = FEATURES + f""",
dist AS (SELECT p.id, r.role AS head, 1 - {DOT} AS d FROM features p JOIN features r ON r.role IN ('ref', 'neg') AND r.id <> p.id
  WHERE p.role = 'pool' OR (p.role = 'ref' AND r.role = 'ref')),
scores AS (SELECT f.id, f.role, median(d) FILTER (head = 'ref') AS score, min(d) FILTER (head = 'neg') AS neg_score
  FROM features f LEFT JOIN dist ON dist.id = f.id WHERE f.role <> 'neg' GROUP BY 1, 2)"""
TAGS = SCORES + """,
tag_lists AS (SELECT entity, list(tag ORDER BY tag) AS tags, list(tag ORDER BY tag) FILTER (category = 'character') AS chars,
    list(tag ORDER BY tag) FILTER (category = 'general') AS gens FROM tag_scores WHERE score >= 0.35 GROUP BY 1)"""
# people: the two smallest distances per record (d = conf of the person boxes, negative distance = 1 - conf)
PEOPLE = """persons AS (SELECT l_orderkey AS entity, round(max(l_extendedprice) / 110000.0, 3) AS d, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS box
    FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
ordered AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, box) AS rn FROM persons),
two AS (SELECT entity, max(d) FILTER (rn = 1) AS d1, round(1 - max(d) FILTER (rn = 1), 3) AS n1, max(d) FILTER (rn = 2) AS d2, max(box) FILTER (rn = 1) AS target
  FROM ordered GROUP BY 1)"""


def judge_sql(t: float) -> str:
    return f"CASE WHEN d1 IS NULL THEN NULL WHEN d1 > {t} OR n1 <= d1 THEN 'no_target' WHEN d2 <= {t} AND d2 - d1 < 0.02 THEN 'ambiguous' ELSE 'found' END"


def two_nearest(boxes):
    """Per record the two smallest person distances; the map side keeps two rows per record."""
    near = A.top_k(boxes.where(F.col("kind") == "person"), ["entity"], [F.col("conf"), F.col("box")], 2)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return near.groupBy("entity").agg(at(1, "conf").alias("d1"), at(2, "conf").alias("d2"), at(1, "box").alias("target")) \
        .withColumn("n1", F.round(1 - F.col("d1"), 3))


POOL = SCORED + ", " + TAGS + ", " + PEOPLE + f""",
pool AS (SELECT f.id, f.role, 'default' AS model, s.score, s.neg_score, f.manual, {judge_sql(0.5)} AS judge, t.tags, t.chars, t.gens
  FROM features f JOIN scores s ON s.id = f.id LEFT JOIN tag_lists t ON t.entity = f.id LEFT JOIN two ON two.entity = f.id),
cored AS (SELECT *, coalesce(score <= 0.93 AND (neg_score IS NULL OR score < neg_score), false) AS core FROM pool),
ranged AS (SELECT *, coalesce(role = 'pool' AND manual IS DISTINCT FROM -1 AND score <= 0.99, false) AND NOT core AS in_range FROM cored),
rec AS (SELECT *, in_range AND coalesce(judge = 'found', false) AS recovered FROM ranged),
tgt AS (SELECT *, CASE WHEN role <> 'pool' OR manual = -1 THEN false WHEN manual IN (1, 2) THEN true ELSE core OR recovered END AS target,
  CASE WHEN tags IS NULL THEN 'untagged' WHEN NOT list_contains(tags, 'red_ring') THEN 'missing' WHEN list_contains(tags, 'old_gear') OR list_contains(tags, 'hot_bolt') THEN 'excluded' END AS kind,
  CASE WHEN tags IS NULL THEN NULL WHEN NOT list_contains(tags, 'red_ring') THEN 'red_ring' WHEN list_contains(tags, 'old_gear') THEN 'old_gear' WHEN list_contains(tags, 'hot_bolt') THEN 'hot_bolt' END AS tag FROM rec),
decided AS (SELECT *, (role = 'pool' AND coalesce(manual = 2, false)) OR (target AND kind IS NULL) AS match FROM tgt)"""


def tag_lists(spark, sf):
    kept = tag_scores(spark, sf).where(F.col("score") >= 0.35)
    named = F.col("category") == "character"
    lists = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("tag"))))
    return kept.groupBy(F.col("entity").alias("id")).agg(
        F.sort_array(F.collect_list("tag")).alias("tags"), lists(named).alias("chars"), lists(~named).alias("gens"))


def pool(spark, sf):
    f = features(spark, sf)
    two = two_nearest(detections(spark, sf))
    j = two.select(F.col("entity").alias("id"), M.judge(F.col("d1"), F.col("n1"), F.col("d2"), 0.5).alias("judge"))
    return SC.ref_scores(f, carry=("manual",)).withColumn("model", F.lit("default")) \
        .join(tag_lists(spark, sf), "id", "left").join(j, "id", "left")


@query("ref_scores", f"WITH {SCORED} SELECT id, round(score, 6) AS score, round(neg_score, 6) AS neg_score FROM scores WHERE role = 'pool'")
def ref_scores(spark, sf):
    s = SC.ref_scores(features(spark, sf)).where(F.col("role") == "pool")
    return s.select("id", F.round("score", 6).alias("score"), F.round("neg_score", 6).alias("neg_score"))


@query("ref_selfcheck", f"WITH {SCORED} SELECT id, round(score, 6) AS score FROM scores WHERE role = 'ref'")
def ref_selfcheck(spark, sf):
    return SC.ref_scores(features(spark, sf)).where(F.col("role") == "ref").select("id", F.round("score", 6).alias("score"))


@query("match_core", f"WITH {POOL} SELECT id, core FROM decided")
def match_core(spark, sf):
    return pool(spark, sf).select("id", M.core(S).alias("core"))


@query("match_recover", f"WITH {POOL} SELECT id, in_range, recovered FROM decided")
def match_recover(spark, sf):
    return pool(spark, sf).select("id", M.in_range(S).alias("in_range"), M.recovered(S).alias("recovered"))


@query("match_target", f"WITH {POOL} SELECT id, target FROM decided")
def match_target(spark, sf):
    return pool(spark, sf).select("id", M.target(S).alias("target"))


@query("matches", f"WITH {POOL} SELECT id, round(score, 6) AS score FROM decided WHERE match ORDER BY score NULLS LAST, id")
def matches(spark, sf):
    return M.matches(pool(spark, sf), S).select("id", F.round("score", 6).alias("score"))


@query("tag_block_reason", f"WITH {POOL} SELECT id, kind, tag FROM decided WHERE kind IS NOT NULL")
def tag_block_reason(spark, sf):
    d = M.decided(pool(spark, sf), S).where(F.col("block").isNotNull())
    return d.select("id", F.col("block.kind").alias("kind"), F.col("block.tag").alias("tag"))


@query("match_buckets", f"""WITH {POOL} SELECT CASE WHEN match THEN 'match' WHEN target AND kind IS NOT NULL AND manual IS DISTINCT FROM 2 THEN CASE kind WHEN 'untagged' THEN 'untagged' ELSE 'tagout' END
    ELSE 'other' END AS bucket, count(*) AS n, count(*) FILTER (target AND judge = 'found') AS grouped FROM decided WHERE role = 'pool' AND (score IS NOT NULL OR manual > 0) GROUP BY 1""")
def match_buckets(spark, sf):
    b = M.bucket(M.decided(pool(spark, sf), S), F.coalesce(F.col("judge") == "found", F.lit(False)))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("grouped").alias("grouped"))


_ACTION = "CASE WHEN quality = 1 AND toxic = 0 THEN 'include' WHEN toxic = 1 THEN 'exclude' WHEN quality = 0 THEN 'clear' END"


@query("manual_overrides", f"""WITH {FEATURES}, marks AS (SELECT doc_id AS id, {_ACTION} AS action FROM labels)
    SELECT f.id, CASE action WHEN 'include' THEN 1 WHEN 'exclude' THEN -1 WHEN 'clear' THEN NULL ELSE f.manual END AS manual FROM features f LEFT JOIN marks m ON m.id = f.id""")
def manual_overrides(spark, sf):
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.expr(_ACTION).alias("action"))
    return M.set_manual(features(spark, sf).select("id", "manual"), marks)


@query("scan_pool", f"WITH {FEATURES} SELECT f.id, role, manual FROM features f WHERE role = 'pool' AND id IN (SELECT doc_id FROM labels)")
def scan_pool(spark, sf):
    """Role and id filter; the vectors are not read."""
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return features(spark, sf).where(F.col("role") == "pool").select("id", "role", "manual").join(ids, "id", "left_semi")


@query("todo_features", f"""WITH {FEATURES}, {TAGS} SELECT f.id, label = 7 AS other_model, label = 8 AS failed, role = 'pool' AND t.tags IS NULL AS untagged
    FROM features f LEFT JOIN tag_lists t ON t.entity = f.id WHERE label IN (7, 8) OR (role = 'pool' AND t.tags IS NULL)""")
def todo_features(spark, sf):
    """What a run still has to compute: another model's vector, an error, or a pool record without tags."""
    f = features(spark, sf).drop("embedding").join(tag_lists(spark, sf).select("id", "tags"), "id", "left")
    flags = f.select("id", (F.col("label") == 7).alias("other_model"), (F.col("label") == 8).alias("failed"),
                     ((F.col("role") == "pool") & F.col("tags").isNull()).alias("untagged"))
    return flags.where("other_model or failed or untagged")


@query("todo_people", f"""WITH {POOL} SELECT id, target AND (judge IS NULL OR judge = 'found' AND tags IS NULL) AS todo, in_range AND judge IS NULL AS look FROM decided WHERE role = 'pool'""")
def todo_people(spark, sf):
    d = pool(spark, sf).where(F.col("role") == "pool")
    new = F.col("judge").isNull()
    return d.select("id", (M.target(S) & (new | ((F.col("judge") == "found") & F.col("tags").isNull()))).alias("todo"),
                    (M.in_range(S) & new).alias("look"))


@query("norm_filter", """WITH n AS (SELECT part_key, [w FOR w IN list_distinct(list_transform(inc, lambda t: replace(trim(lower(t)), ' ', '_'))) IF w <> ''] AS i,
      [w FOR w IN list_distinct(list_transform(exc, lambda t: replace(trim(lower(t)), ' ', '_'))) IF w <> ''] AS e
    FROM (SELECT p_partkey AS part_key, [' ' || upper(p_name) || ' ', p_brand, ''] AS inc, [p_type, p_name || CASE WHEN p_size > 25 THEN '' ELSE ' x' END] AS exc FROM part))
    SELECT part_key, array_to_string(list_sort(list_filter(i, lambda w: NOT list_contains(e, w))), ',') AS include, array_to_string(list_sort(e), ',') AS exclude FROM n""")
def norm_filter(spark, sf):
    p = table(spark, sf, "part")
    inc = F.array(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")), F.col("p_brand"), F.lit(""))
    exc = F.array(F.col("p_type"), F.concat("p_name", F.when(F.col("p_size") > 25, "").otherwise(" x")))
    i, e = M.norm_filter(inc, exc)
    return p.select(F.col("p_partkey").alias("part_key"), F.array_join(F.sort_array(i), ",").alias("include"), F.array_join(F.sort_array(e), ",").alias("exclude"))


@query("select_invert", f"WITH {POOL} SELECT id FROM decided WHERE role = 'pool' AND NOT match")
def select_invert(spark, sf):
    """The pool minus the selection."""
    return M.decided(pool(spark, sf).where(F.col("role") == "pool"), S).where("not match").select("id")


@query("tag_suggest", f"""WITH {POOL}, t AS (SELECT id, chars, gens FROM decided WHERE target AND tags IS NOT NULL),
    l AS (SELECT id, unnest(coalesce(chars, [])) AS tag, true AS named FROM t UNION ALL SELECT id, unnest(list_filter(coalesce(gens, []), lambda g: NOT list_contains(coalesce(chars, []), g))), false FROM t),
    c AS (SELECT tag, count(*) AS n, bool_or(named) AS named FROM l GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY named ORDER BY n DESC, tag) AS rank FROM c WHERE n < (SELECT count(*) FROM t) AND tag NOT IN ('red_ring', 'old_gear', 'hot_bolt'))
    SELECT tag, n, named, rank FROM r WHERE rank <= CASE WHEN named THEN 6 ELSE 18 END""")
def tag_suggest(spark, sf):
    t = pool(spark, sf).where(M.target(S) & F.col("tags").isNotNull()).select(
        "id", F.col("chars").alias("character"), F.col("gens").alias("general"))
    return A.tag_suggest(t, S.include + S.exclude).select("tag", "n", "named", F.col("rank").cast("long").alias("rank"))


@query("session_rollup", f"""WITH {FEATURES} SELECT label AS session_id, count(*) FILTER (role = 'ref') AS refs, count(*) FILTER (role = 'pool') AS pool, min(id) FILTER (role = 'ref') AS cover FROM features GROUP BY 1""")
def session_rollup(spark, sf):
    is_ref = F.col("role") == "ref"
    return features(spark, sf).groupBy(F.col("label").alias("session_id")).agg(
        F.count_if(is_ref).alias("refs"), F.count_if(F.col("role") == "pool").alias("pool"), F.min(F.when(is_ref, F.col("id"))).alias("cover"))
