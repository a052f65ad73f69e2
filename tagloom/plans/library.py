"""The record library: scans, searches, counts, edits, table maintenance."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as C
from ..operators import captions as K
from ..operators import edits as E
from ..operators import policy as P
from ..operators import search as R
from ..operators import select as S
from ..operators import stats as A
from ..functions.tags import token_estimate
from .captions import VOCABULARY, RECORDS, _HITS, joined, records
from .registry import query
from .tags import GROUPS, PROJECT, SELECTED
from .views import ITEMS, RUNS, items, raw, runs, table, texts

SHOWN = "id, project_id, name, width, height, sha1, len(tags) AS n_tags, rating, status"


def shown(df):
    return df.select("id", "project_id", "name", "width", "height", "sha1", F.size("tags").cast("long").alias("n_tags"), "rating", "status")


@query("scan_items", f"WITH {ITEMS} SELECT {SHOWN} FROM items WHERE status = 'done' ORDER BY lower(name), id")
def scan_items(spark, sf):
    return shown(items(spark, sf).where(F.col("status") == "done")).orderBy(F.lower("name"), "id")


@query("search_items", f"""WITH {ITEMS} SELECT id FROM items WHERE
    (len(list_filter(tags, lambda t: contains(t, 'tion'))) > 0 OR contains(lower(nl), 'tion') OR contains(lower(name), 'tion'))
    AND (len(list_filter(tags, lambda t: regexp_full_match(t, 'img.*1\\.png'))) > 0 OR regexp_full_match(lower(nl), '(?s)img.*1\\.png') OR regexp_full_match(lower(name), 'img.*1\\.png'))""")
def search_items(spark, sf):
    return items(spark, sf).where(R.search("TION, img*1.PNG", F.col("tags"), F.col("nl"), F.col("name"))).select("id")


@query("untagged", f"WITH {ITEMS} SELECT id, rating IS NULL OR rating = '' AS unrated FROM items WHERE status IN ('pending', 'error')")
def untagged(spark, sf):
    return items(spark, sf).where(F.col("status").isin(A.UNTAGGED)).select(
        "id", (F.col("rating").isNull() | F.coalesce(F.col("rating") == "", F.lit(False))).alias("unrated"))


@query("refine_candidates", f"WITH {ITEMS} SELECT id FROM items WHERE status = 'done' AND (len(tags) > 0 OR nl <> '')")
def refine_candidates(spark, sf):
    return items(spark, sf).where((F.col("status") == "done") & ((F.size("tags") > 0) | (F.col("nl") != ""))).select("id")


@query("replaced_count", f"""WITH {ITEMS} SELECT count(*) FILTER (len(tags) > 0) AS with_tags, count(*) FILTER (nl <> '') AS with_text,
    count(*) FILTER (len(tags) > 0 AND nl <> '') AS with_both FROM items""")
def replaced_count(spark, sf):
    t, n = F.size("tags") > 0, F.col("nl") != ""
    return items(spark, sf).agg(F.count_if(t).alias("with_tags"), F.count_if(n).alias("with_text"), F.count_if(t & n).alias("with_both"))


@query("item_view", f"""WITH {ITEMS}, p AS (SELECT *, ['the'] || CASE rating WHEN 'general' THEN ['safe'] WHEN 'sensitive' THEN ['sensitive'] WHEN 'questionable' THEN ['nsfw'] ELSE [] END || tags AS parts FROM items),
    v AS (SELECT id, width, height, status, len(parts) - 1 < 0 AS odd, {joined("parts")} AS caption,
      CASE WHEN len({_HITS}) > 0 AND (coalesce(rating = 'questionable', false) OR list_has_any(tags, ['with', 'dans', 'nicht'])
      OR regexp_matches(nl, '(?i)\\b(avec|und|that)\\b')) THEN array_to_string({_HITS}, ', ') END AS flag, name FROM p)
    SELECT id, width, height, status, caption, len(regexp_extract_all(caption, '\\w+|[^\\w\\s]')) AS token_estimate, flag,
      lower(name) LIKE '%.jpg' AS lossy, least(width, height) < 384 AS too_small FROM v""")
def item_view(spark, sf):
    """The derived record: caption, token count, policy flag and planning flags in one projection."""
    s = C.defaults_for("anima", trigger="the")
    none = F.array().cast("array<string>")
    v = items(spark, sf).withColumn("caption", K.build_caption(F.col("tags"), F.lit(""), F.col("rating"), none, none, s))
    return v.select("id", "width", "height", "status", "caption", token_estimate(F.col("caption")).cast("long").alias("token_estimate"),
                    P.policy_flag(F.col("tags"), F.col("rating"), F.col("nl"), **VOCABULARY).alias("flag"),
                    R.extension(F.col("name")).isin(R.LOSSY).alias("lossy"),
                    (R.short_side(F.col("width"), F.col("height")) < R.TOO_SMALL).alias("too_small"))


# ------------------------------------------------------------------ counts
@query("tag_stats", f"WITH {ITEMS} SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM items) GROUP BY 1")
def tag_stats(spark, sf):
    return A.tag_stats(items(spark, sf))


@query("tag_summary", f"WITH {ITEMS} SELECT (SELECT count(*) FROM items) AS images, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM items)) AS unique_tags")
def tag_summary(spark, sf):
    return A.tag_summary(items(spark, sf))


@query("tag_topk", f"WITH {ITEMS} SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM items) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 400")
def tag_topk(spark, sf):
    """A top-k report: the 400 most used tags."""
    return A.tag_stats(items(spark, sf)).orderBy(F.col("count").desc(), "tag").limit(400)


@query("rating_hist", f"WITH {ITEMS} SELECT coalesce(rating, 'unknown') AS rating, count(*) AS n FROM items GROUP BY 1")
def rating_hist(spark, sf):
    return A.histograms(items(spark, sf)).where(F.col("kind") == "rating").select(F.col("value").alias("rating"), "n")


@query("status_hist", f"WITH {ITEMS} SELECT status, count(*) AS n FROM items GROUP BY 1")
def status_hist(spark, sf):
    return A.histograms(items(spark, sf)).where(F.col("kind") == "status").select(F.col("value").alias("status"), "n")


@query("project_rollup", """SELECT c_custkey AS project_id, count(o_orderkey) AS image_count, count(*) FILTER (o_orderstatus = 'F') AS done_count,
    arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS cover_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def project_rollup(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"),
                                          F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"),
                                          F.col("o_orderdate").alias("created"))
    return A.project_rollup(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id")))


@query("dataset_view", f"""WITH {ITEMS} SELECT project_id, count(*) AS images, count(*) FILTER (status = 'done') AS done,
    count(*) FILTER (status <> 'done') AS pending, arg_min(id, (lower(name), id)) AS cover_id FROM items GROUP BY 1""")
def dataset_view(spark, sf):
    d = F.col("status") == "done"
    return items(spark, sf).groupBy("project_id").agg(
        F.count("*").alias("images"), F.count_if(d).alias("done"), F.count_if(~d).alias("pending"),
        F.min_by("id", F.struct(F.lower("name"), "id")).alias("cover_id"))


REGIONS = """regions AS (SELECT l_orderkey AS id, count(*) AS rects, bool_or(l_quantity = 50) AS scanned,
    CASE WHEN max(l_discount) = 0.1 THEN true WHEN max(l_tax) = 0 THEN false END AS override FROM lineitem GROUP BY 1)"""


def regions(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("rects"), F.bool_or(F.col("l_quantity") == 50).alias("scanned"),
        F.when(F.max("l_discount") == 0.1, True).when(F.max("l_tax") == 0, False).alias("override"))


@query("has_regions", f"WITH {REGIONS} SELECT id, coalesce(override, rects > 3) AS has FROM regions")
def has_regions(spark, sf):
    """A manual mark beats the detection."""
    return regions(spark, sf).select("id", F.coalesce("override", F.col("rects") > 3).alias("has"))


@query("region_summary", f"""WITH {REGIONS} SELECT count(*) AS total, count(*) FILTER (scanned) AS scanned,
    count(*) FILTER (coalesce(override, scanned AND rects > 3)) AS with_blocks, count(*) FILTER (NOT scanned) AS unscanned FROM regions""")
def region_summary(spark, sf):
    has = F.coalesce(F.col("override"), F.col("scanned") & (F.col("rects") > 3))
    return regions(spark, sf).agg(F.count("*").alias("total"), F.count_if("scanned").alias("scanned"),
                                  F.count_if(has).alias("with_blocks"), F.count_if(~F.col("scanned")).alias("unscanned"))


@query("any_rating", f"WITH {ITEMS} SELECT project_id, bool_or(coalesce(rating IN ('questionable', 'explicit'), false)) AS mature FROM items GROUP BY 1")
def any_rating(spark, sf):
    return items(spark, sf).groupBy("project_id").agg(F.bool_or(F.coalesce(F.col("rating").isin(C.SEXUAL_RATINGS), F.lit(False))).alias("mature"))


# ------------------------------------------------------------------ planning
SIZES = "LEFT JOIN labels l ON l.doc_id = i.id"


def sized(spark, sf):
    """Records whose earlier size is known when they were enlarged (toxic label stands for it)."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    was = (F.col("toxic") == 0) & (F.col("quality") == 0)
    return items(spark, sf).join(lab, "id", "left").withColumn("ow", F.when(was, F.expr("width div 2"))).withColumn(
        "oh", F.when(was, F.expr("height div 2")))


_SIZED = ITEMS + """, sized AS (SELECT i.*, CASE WHEN l.toxic = 0 AND l.quality = 0 THEN i.width // 2 END AS ow,
    CASE WHEN l.toxic = 0 AND l.quality = 0 THEN i.height // 2 END AS oh FROM items i LEFT JOIN labels l ON l.doc_id = i.id)"""
_SHORT = "least(coalesce(ow, width), coalesce(oh, height))"


@query("upscale_candidates", f"WITH {_SIZED} SELECT id, {_SHORT} < 1024 AS small, lower(name) LIKE '%.jpg' AS lossy FROM sized WHERE ow IS NULL")
def upscale_candidates(spark, sf):
    d = sized(spark, sf).where(F.col("ow").isNull())
    return d.select("id", (R.short_side(F.col("width"), F.col("height"), F.col("ow"), F.col("oh")) < 1024).alias("small"),
                    R.extension(F.col("name")).isin(R.LOSSY).alias("lossy"))


@query("upscale_plan", f"""WITH {_SIZED} SELECT id, CASE WHEN lower(name) LIKE '%.jpg' THEN 1 ELSE -1 END AS noise,
    CASE WHEN {_SHORT} * 2 >= 1024 THEN 2 ELSE 4 END AS scale FROM sized""")
def upscale_plan(spark, sf):
    d = sized(spark, sf)
    noise, scale = R.upscale_plan(R.short_side(F.col("width"), F.col("height"), F.col("ow"), F.col("oh")),
                                  R.extension(F.col("name")).isin(R.LOSSY), 1024)
    return d.select("id", noise.alias("noise"), scale.alias("scale"))


@query("too_small", f"WITH {_SIZED} SELECT id, {_SHORT} < 384 AS too_small FROM sized")
def too_small(spark, sf):
    return sized(spark, sf).select("id", (R.short_side(F.col("width"), F.col("height"), F.col("ow"), F.col("oh")) < R.TOO_SMALL).alias("too_small"))


# ------------------------------------------------------------------ edits
def edited(spark, sf, new):
    r = records(spark, sf).select("entity", "tags", "nl")
    r = r.select("entity", "tags", new.alias("new"))
    return r.select("entity", F.array_join("new", "|").alias("tags"), (~F.col("new").eqNullSafe(F.col("tags"))).alias("changed"))


def edit_sql(expr: str) -> str:
    return f"WITH {RECORDS} SELECT entity, array_to_string({expr}, '|') AS tags, {expr} <> tags AS changed FROM records"


def _first(words: str) -> str:
    return f"list_filter({words}, lambda w: NOT list_contains(tags, w))"


@query("bulk_add", f"WITH {RECORDS} SELECT entity, array_to_string(tags || {_first('[$$red ring$$, $$brand new$$]')}, '|') AS tags, true AS changed, "
                   f"array_to_string({_first('[$$red ring$$, $$brand new$$]')} || tags, '|') AS front FROM records")
def bulk_add(spark, sf):
    text = "red_ring, brand new, Red Ring"
    r = records(spark, sf)
    back, front = E.add(F.col("tags"), text), E.add(F.col("tags"), text, "front")
    r = r.select("entity", F.col("tags").alias("old"), back.alias("back"), front.alias("front"))
    return r.select("entity", F.array_join("back", "|").alias("tags"), (~F.col("back").eqNullSafe(F.col("old"))).alias("changed"),
                    F.array_join("front", "|").alias("front"))


_GONE = "list_filter(tags, lambda t: NOT regexp_matches(t, '^(?:hot .*)$|^(?:.ld ring)$'))"


@query("bulk_remove", edit_sql(_GONE))
def bulk_remove(spark, sf):
    return edited(spark, sf, E.remove(F.col("tags"), "hot *, ?ld_ring"))


_SWAP = "flatten([CASE WHEN t = 'old gear' THEN ['2girls', 'fresh gear'] ELSE [t] END for t in tags])"
_SWAPPED = f"list_filter({_SWAP}, lambda x, i: list_position({_SWAP}, x) = i)"


@query("bulk_replace", edit_sql(_SWAPPED))
def bulk_replace(spark, sf):
    return edited(spark, sf, E.replace(F.col("tags"), "Old_Gear", "2girls, fresh gear"))


@query("bulk_reapply", f"WITH {SELECTED} SELECT entity, array_to_string(tags, '|') AS tags, true AS changed FROM selected")
def bulk_reapply(spark, sf):
    """Rebuild the list from the stored predictions."""
    new = S.select_tags(F.col("raw"), PROJECT, GROUPS)
    return raw(spark, sf).select("entity", F.array_join(new, "|").alias("tags"), F.lit(True).alias("changed"))


_FILTERED = "list_filter(tags, lambda t: NOT regexp_matches(t, '^(?:old .+)$') AND NOT regexp_matches(t, '^(?:new .*)$'))"


@query("bulk_filter", edit_sql(_FILTERED))
def bulk_filter(spark, sf):
    return edited(spark, sf, S.apply_filters(F.col("tags"), {"prune_groups": ["old_part"], "blacklist": "new *"}, GROUPS))


@query("bulk_clear", f"WITH {RECORDS} SELECT entity, '' AS nl, nl <> '' AS changed FROM records")
def bulk_clear(spark, sf):
    return records(spark, sf).select("entity", F.lit("").alias("nl"), (F.col("nl") != "").alias("changed"))


@query("bulk_undo", f"WITH {RECORDS} SELECT entity, array_to_string(tags, '|') AS tags, nl, array_to_string({_GONE}, '|') AS edited FROM records")
def bulk_undo(spark, sf):
    """Edit with one level of history, then undo: the lists come back."""
    r = E.with_undo(records(spark, sf).select("entity", "tags", "nl"), E.remove(F.col("tags"), "hot *, ?ld_ring"), F.lit(""))
    r = r.withColumn("edited", F.array_join("tags", "|"))
    return E.undo(r).select("entity", F.array_join("tags", "|").alias("tags"), "nl", "edited")


@query("bulk_changed", f"WITH {RECORDS} SELECT count(*) FILTER ({_GONE} <> tags) AS changed, count(*) AS total FROM records")
def bulk_changed(spark, sf):
    r = records(spark, sf).select(F.col("tags").alias("old"), E.remove(F.col("tags"), "hot *, ?ld_ring").alias("new"))
    return E.changed_count(r)


@query("item_patch", f"""WITH {ITEMS} SELECT i.id, CASE WHEN b.text IS NOT NULL THEN trim(b.text) ELSE nl END AS nl,
    CASE WHEN b.text IS NOT NULL AND status IN ('pending', 'error') THEN 'done' ELSE status END AS status FROM items i LEFT JOIN benchmark b ON b.item_id = i.id""")
def item_patch(spark, sf):
    """New descriptions from an edit table; edited pending or failed records become done."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("new"))
    j = items(spark, sf).join(b, "id", "left")
    return E.patch(j, F.lit(None).cast("string"), F.col("new")).select("id", "nl", "status")


# ------------------------------------------------------------------ table maintenance
@query("upsert_latest", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts,
    arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def upsert_latest(spark, sf):
    return A.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("latest_per_key", f"WITH {RUNS} SELECT project_id, arg_max(run_id, (created_at, run_id)) AS run_id, arg_max(status, (created_at, run_id)) AS status FROM runs GROUP BY 1")
def latest_per_key(spark, sf):
    return A.latest(runs(spark, sf).select("project_id", "run_id", "status", "created_at"), ["project_id"], ["created_at", "run_id"]).select("project_id", "run_id", "status")


@query("keep_last_k", """SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
    FROM events WHERE event_type = 'error') WHERE rank <= 20""")
def keep_last_k(spark, sf):
    """The last 20 errors of each run."""
    e = table(spark, sf, "events").where(F.col("event_type") == "error").select("user_id", "event_id", "ts")
    return A.top_k(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("cas_status", f"WITH {RUNS} SELECT run_id, CASE WHEN status IN ('running', 'queued') THEN 'stopping' ELSE status END AS status FROM runs")
def cas_status(spark, sf):
    return runs(spark, sf).select("run_id", R.compare_and_set(F.col("status"), ["running", "queued"], "stopping").alias("status"))


@query("restore_status", f"WITH {ITEMS} SELECT id, CASE WHEN status IN ('queued', 'processing') THEN CASE WHEN len(tags) > 0 OR nl <> '' THEN 'done' ELSE 'pending' END ELSE status END AS status FROM items")
def restore_status(spark, sf):
    return items(spark, sf).select("id", R.restored_status(F.col("status"), F.col("tags"), F.col("nl")).alias("status"))


@query("delete_anti", """SELECT vec_id AS id, label <> 3 AS scored FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id AND l.toxic = 1)""")
def delete_anti(spark, sf):
    """Remove listed ids; the scores of what stays are cleared where the references changed."""
    gone = table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") != 3).alias("scored"))
    return e.join(gone, "id", "left_anti")


@query("cascade_delete", """SELECT 'items' AS part, count(*) AS n, count(*) AS kept_key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    UNION ALL SELECT 'training', count(*), count(CASE WHEN c_acctbal >= 0 THEN 1 END) FROM orders JOIN customer ON c_custkey = o_custkey""")
def cascade_delete(spark, sf):
    """Deleting projects removes their records and nulls the key of their training projects."""
    gone = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("gone"))
    o = table(spark, sf, "orders").select("o_custkey")
    marked = o.join(gone, "o_custkey", "left")
    stay = F.col("gone").isNull()
    both = marked.agg(F.count_if(stay).alias("a"), F.count("*").alias("b"))
    return both.select(F.explode(F.array(
        F.struct(F.lit("items").alias("part"), F.col("a").alias("n"), F.col("a").alias("kept_key")),
        F.struct(F.lit("training").alias("part"), F.col("b").alias("n"), F.col("a").alias("kept_key")))).alias("x")).select("x.*")


@query("captions_page", f"""WITH {ITEMS} SELECT id, name, status FROM items ORDER BY lower(name), id LIMIT 50 OFFSET 100""")
def captions_page(spark, sf):
    """One page of the listing: rows 101 to 150."""
    return items(spark, sf).select("id", "name", "status").orderBy(F.lower("name"), "id").offset(100).limit(50)
