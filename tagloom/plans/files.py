"""Files, imports, names and exports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import imports as I
from ..operators import names as NM
from ..operators import order as O
from ..sources import export as X
from .captions import FLAGGED, VOCABULARY
from .registry import query
from .views import FILES, ITEMS, files, items, table, texts

_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
_IMG = f"{_EXT} IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.gif', '.tif', '.tiff', '.avif', '.jfif')"
_TXT = f"{_EXT} IN ('.txt', '.caption')"
_HIDDEN = "regexp_matches(path, '(^|/)\\.[^./]|(^|/)__MACOSX(/|$)')"
_STEM = "lower(regexp_replace(path, '([^/])\\.[^./]+$', '\\1'))"


@query("wanted_paths", f"WITH {FILES} SELECT ord, path, {_IMG} AS image FROM files WHERE NOT {_HIDDEN} AND ({_IMG} OR {_TXT})")
def wanted_paths(spark, sf):
    p = F.col("path")
    return files(spark, sf).where(P.is_wanted(p)).select("ord", "path", P.is_image(p).alias("image"))


@query("path_parts", f"WITH {FILES} SELECT ord, regexp_extract(path, '([^/]*)$', 1) AS base, {_STEM} AS stem_key, {_EXT} AS suffix, ltrim(path, '/') AS rel, NULL::VARCHAR AS error FROM files")
def path_parts(spark, sf):
    p = F.col("path")
    rel, err = P.normalise(p)
    return files(spark, sf).select("ord", P.base_name(p).alias("base"), P.stem_key(p).alias("stem_key"), P.suffix(p).alias("suffix"), rel.alias("rel"), err.alias("error"))


_DIR = "regexp_replace(ltrim(path, '/'), '/?[^/]*$', '')"


@query("dir_counts", f"WITH {FILES}, d AS (SELECT root, {_DIR} AS dir, {_IMG} AS img FROM files) SELECT root, dir, count(*) FILTER (img) AS images FROM d WHERE len(string_split(dir, '/')) <= 2 GROUP BY 1, 2")
def dir_counts(spark, sf):
    f = files(spark, sf).select("root", P.parent(F.col("path")).alias("dir"), P.suffix(F.col("path")).isin(P.IMAGE_EXTENSIONS).alias("img"))
    return f.where(F.size(F.split("dir", "/")) <= 2).groupBy("root", "dir").agg(F.count_if("img").alias("images"))


@query("folder_summary", f"WITH {FILES}, d AS (SELECT root, {_DIR} AS dir, {_IMG} AND NOT {_HIDDEN} AS img FROM files) SELECT root, dir, count(*) FILTER (img) AS images, count(*) FILTER (NOT img) AS others FROM d GROUP BY 1, 2")
def folder_summary(spark, sf):
    f = files(spark, sf).select("root", P.parent(F.col("path")).alias("dir"), P.is_image(F.col("path")).alias("img"))
    return f.groupBy("root", "dir").agg(F.count_if("img").alias("images"), F.count_if(~F.col("img")).alias("others"))


@query("folder_dataset", f"WITH {FILES}, i AS (SELECT DISTINCT root, {_STEM} AS k, path FROM files WHERE {_IMG}), t AS (SELECT DISTINCT root, {_STEM} AS k FROM files WHERE {_EXT} = '.txt') SELECT i.root, count(*) AS images, count(t.k) AS captions FROM i LEFT JOIN t ON t.root = i.root AND t.k = i.k GROUP BY 1")
def folder_dataset(spark, sf):
    """Pictures per folder and how many have a caption file of the same stem."""
    f = files(spark, sf).select("root", "path", P.stem_key(F.col("path")).alias("k"), P.suffix(F.col("path")).alias("x"))
    texts_ = f.where("x = '.txt'").select("root", "k", F.lit(1).alias("has")).distinct()
    images = f.where(F.col("x").isin(P.IMAGE_EXTENSIONS)).select("root", "path", "k").distinct()
    return images.join(texts_, ["root", "k"], "left").groupBy("root").agg(F.count("*").alias("images"), F.count("has").alias("captions"))


@query("pair_sidecars", f"""WITH {FILES}, w AS (SELECT *, {_STEM} AS k FROM files WHERE NOT {_HIDDEN}), t AS (SELECT root, k, arg_max(path, ord) AS caption_path, arg_max(html, ord) AS caption FROM w WHERE {_TXT} GROUP BY 1, 2)
    SELECT w.ord, w.path, t.caption_path, sha1(t.caption) AS caption FROM w LEFT JOIN t ON t.root = w.root AND t.k = w.k WHERE {_IMG}""")
def pair_sidecars(spark, sf):
    f = files(spark, sf).withColumnRenamed("html", "content")
    return I.pair_sidecars(f, ["root"]).select("ord", "path", "caption_path", F.sha1("caption").alias("caption"))


PIECES = """pieces AS (SELECT doc_id, pos, trim(p, E' \\t\\r\\n') AS p FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split_regex(text, '[,\\n]') AS l FROM documents))),
sorted AS (SELECT *, len(string_split_regex(p, '\\s+')) > 5 OR ends_with(p, '.') AS sentence FROM pieces WHERE p <> ''),
tags AS (SELECT doc_id, k, min(pos) AS pos, arg_min(t, pos) AS t FROM (SELECT doc_id, pos, trim(regexp_replace(replace(p, '_', ' '), '\\s+', ' ', 'g')) AS t, lower(trim(regexp_replace(replace(p, '_', ' '), '\\s+', ' ', 'g'))) AS k FROM sorted WHERE NOT sentence)
  WHERE k NOT IN ('the', '') GROUP BY 1, 2)"""


@query("parse_sidecar", f"""WITH {PIECES} SELECT d.doc_id, coalesce((SELECT string_agg(t, '|' ORDER BY pos) FROM tags WHERE tags.doc_id = d.doc_id), '') AS tags,
    coalesce((SELECT string_agg(p, ', ' ORDER BY pos) FROM sorted s WHERE s.doc_id = d.doc_id AND sentence), '') AS nl FROM documents d""")
def parse_sidecar(spark, sf):
    """Whole texts read as caption files."""
    tags, nl = I.parse_sidecar(F.col("text"), "the")
    return texts(spark, sf).select("doc_id", F.array_join(tags, "|").alias("tags"), nl.alias("nl"))


@query("collect_sources", f"WITH {FILES} SELECT root, path, min(source) AS source, arg_min(ord, (source, ord)) AS ord FROM (SELECT root, path, 0 AS source, ord FROM files WHERE {_IMG} UNION ALL SELECT root, path, 1, ord FROM files WHERE size > 2000) GROUP BY 1, 2")
def collect_sources(spark, sf):
    f = files(spark, sf)
    folder = f.where(P.suffix(F.col("path")).isin(P.IMAGE_EXTENSIONS)).select("root", "path", "ord")
    picked = f.where("size > 2000").select("root", "path", "ord")
    return I.collect_sources([folder, picked])


@query("url_entries", """WITH u AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'ftp' ELSE regexp_extract(url, '^([a-z]+):', 1) END || regexp_extract(url, '^[a-z]+(:.*)$', 1) AS url FROM pages),
    n AS (SELECT page_id, url LIKE 'ftp%' AS bad, coalesce(nullif(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '/'), '([^/]*)$', 1), ''), 'image') AS name FROM u)
    SELECT page_id, CASE WHEN NOT bad THEN name || CASE WHEN regexp_matches(name, '.\\.[^.]+$') THEN '' ELSE '.png' END END AS name, CASE WHEN bad THEN 'http only' END AS reason FROM n""")
def url_entries(spark, sf):
    scheme = F.when(F.col("page_id") % 10 == 0, "ftp").otherwise(F.regexp_extract("url", "^([a-z]+):", 1))
    u = table(spark, sf, "pages").select("page_id", F.concat(scheme, F.regexp_extract("url", "^[a-z]+(:.*)$", 1)).alias("url"))
    return I.url_entries(u).select("page_id", "name", "reason")


@query("import_batch", f"""WITH {FILES}, w AS (SELECT *, {_STEM} AS k, sha1(html) AS h FROM files WHERE NOT {_HIDDEN}), i AS (SELECT * FROM w WHERE {_IMG}),
    f AS (SELECT *, min(ord) OVER (PARTITION BY root, h) AS first FROM i)
    SELECT root, ord, h AS sha1, CASE WHEN ord <> first OR h IN (SELECT sha1(html) FROM pages WHERE length(html) > 4000) THEN 'duplicate' END AS reason FROM f""")
def import_batch(spark, sf):
    f = files(spark, sf).withColumnRenamed("html", "content")
    present = table(spark, sf, "pages").where(F.length("html") > 4000).select(F.sha1("html").alias("sha1"))
    return I.import_batch(f, present, ["root"]).select("root", "ord", "sha1", "reason")


@query("slugify", """WITH f AS (SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS t, text FROM documents)
    SELECT doc_id, substr(trim(regexp_replace(t, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), 1, 80) AS slug FROM f""")
def slugify(spark, sf):
    return texts(spark, sf).select("doc_id", P.slugify(F.col("text")).alias("slug"))


@query("slug_unicode", """SELECT page_id, coalesce(nullif(substr(regexp_replace(trim(regexp_replace(url, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '._'), '_+', '_', 'g'), 1, 60), ''), 'lora') AS slug FROM pages""")
def slug_unicode(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.slug_unicode(F.col("url")).alias("slug"))


@query("parse_unc", """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/]*)', 1) AS share FROM pages""")
def parse_unc(spark, sf):
    t = F.concat(F.when(F.col("page_id") % 2 == 0, "smb://").otherwise("\\\\"), F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", ""))
                 .otherwise(F.translate(F.regexp_replace("url", "^https?://", ""), "/", "\\")))
    host, share = P.host_and_share(t, F.lit(None).cast("string"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), share.alias("share"))


@query("source_refs", f"WITH {FILES} SELECT root, count(*) FILTER (starts_with(path, '/en/')) AS refs FROM files GROUP BY 1")
def source_refs(spark, sf):
    return files(spark, sf).groupBy("root").agg(F.count_if(F.startswith(F.col("path"), F.lit("/en/"))).alias("refs"))


@query("pack_batches", f"""WITH RECURSIVE {FILES}, g AS (SELECT root, regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS stem_key, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY stem_key) AS k FROM g),
    walk AS (SELECT root, stem_key, files, size, k, 0::BIGINT AS batch, files AS n, size AS total FROM o WHERE k = 1 UNION ALL
      SELECT o.root, o.stem_key, o.files, o.size, o.k, CASE WHEN w.n >= 3 OR w.total > 10000 THEN w.batch + 1 ELSE w.batch END,
        CASE WHEN w.n >= 3 OR w.total > 10000 THEN o.files ELSE w.n + o.files END, CASE WHEN w.n >= 3 OR w.total > 10000 THEN o.size ELSE w.total + o.size END
      FROM walk w JOIN o ON o.root = w.root AND o.k = w.k + 1) SELECT root, stem_key, files, size, batch FROM walk""")
def pack_batches(spark, sf):
    """Greedy by root, in stem order."""
    return I.pack_batches(files(spark, sf).select("root", "path", "size"), 3, 10_000)


# ------------------------------------------------------------------ names and exports
@query("unique_names", f"""WITH {ITEMS}, n AS (SELECT id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS n FROM items)
    SELECT id, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || ' (' || n || ')' || regexp_extract(name, '\\.[^.]*$') END AS unique FROM n""")
def unique_names(spark, sf):
    return NM.unique_names(items(spark, sf).select("id", "name"), [], ["id"]).select("id", "unique")


@query("export_names")
def export_names(spark, sf):
    """Per project, slugged names without collisions; checked against the sequential rule in the tests."""
    return X.export_names(X.prepare(items(spark, sf), **VOCABULARY).select("id", "project_id", "name"), "project_id", ["id"]).select("id", "project_id", "stem", "ext")


_SEQ = f"WITH {FLAGGED}, n AS (SELECT id, project_id, name, row_number() OVER (PARTITION BY project_id ORDER BY lower(name), id) AS n FROM flagged WHERE reason IS NULL)"


@query("export_manifest", _SEQ + " SELECT id, project_id || '_' || lpad(CAST(n AS VARCHAR), 4, '0') || lower(regexp_extract(name, '\\.[^.]*$')) AS image_path, project_id || '_' || lpad(CAST(n AS VARCHAR), 4, '0') || '.txt' AS caption_path FROM n")
def export_manifest(spark, sf):
    kept = X.prepare(items(spark, sf), **VOCABULARY).select("id", "project_id", "name", F.lower("name").alias("_low"))
    named = X.export_names(kept, "project_id", ["_low", "id"], "sequential", F.col("project_id"))
    return X.manifest(named, X.folder("flat")).select("id", "image_path", "caption_path")


@query("export_kohya_paths", _SEQ + " SELECT id, 'img/5_' || project_id || '_x woman/' || project_id || '_' || lpad(CAST(n AS VARCHAR), 4, '0') || lower(regexp_extract(name, '\\.[^.]*$')) AS image_path FROM n")
def export_kohya_paths(spark, sf):
    kept = X.prepare(items(spark, sf), **VOCABULARY).select("id", "project_id", "name", F.lower("name").alias("_low"))
    named = X.export_names(kept, "project_id", ["_low", "id"], "sequential", F.col("project_id"))
    return X.manifest(named, X.folder("kohya", 5, F.concat("project_id", F.lit("/x")), F.lit("woman"))).select("id", "image_path")


@query("export_jsonl", _SEQ.replace("SELECT id, project_id, name,", "SELECT id, project_id, name, tags,") + """ SELECT to_json({'file_name': project_id || '_' || lpad(CAST(n AS VARCHAR), 4, '0') || lower(regexp_extract(name, '\\.[^.]*$')), 'text': array_to_string(tags, ', ')})::VARCHAR AS value FROM n""")
def export_jsonl(spark, sf):
    kept = X.prepare(items(spark, sf), **VOCABULARY).select("id", "project_id", "name", F.lower("name").alias("_low"), F.array_join("tags", ", ").alias("caption"))
    return X.jsonl(X.export_names(kept, "project_id", ["_low", "id"], "sequential", F.col("project_id")))


@query("snapshot_manifest", f"WITH {FLAGGED} SELECT id, project_id, lpad(CAST(row_number() OVER (PARTITION BY project_id ORDER BY lower(name), id) - 1 AS VARCHAR), 5, '0') AS file FROM flagged WHERE reason IS NULL")
def snapshot_manifest(spark, sf):
    kept = X.prepare(items(spark, sf), **VOCABULARY).select("id", "project_id", F.lower("name").alias("_low"))
    return X.snapshot(kept, "project_id", ["_low", "id"]).select("id", "project_id", "file")


@query("snapshot_folder", f"WITH {FLAGGED}, n AS (SELECT id, project_id, nl, row_number() OVER (PARTITION BY project_id ORDER BY id) AS n FROM flagged WHERE reason IS NULL AND nl <> '') SELECT project_id, id, substr(nl, 1, 400) AS sample FROM n WHERE n <= 3")
def snapshot_folder(spark, sf):
    """The first three captions of each folder as sample prompts, at most 400 characters each (a report)."""
    from ..operators.stats import top_k

    kept = X.prepare(items(spark, sf), **VOCABULARY).where("nl <> ''").select("id", "project_id", "nl")
    return top_k(kept, ["project_id"], [F.col("id")], 3).select("project_id", "id", F.substring("nl", 1, 400).alias("sample"))


@query("sample_rows", f"""WITH {ITEMS}, n AS (SELECT id, row_number() OVER (ORDER BY lower(name), id) AS n, count(*) OVER () AS total FROM items), k AS (SELECT unnest([0, 1, 2]) AS pick)
    SELECT id, pick FROM k JOIN n ON n = CAST(floor(pick * (total - 1) / 2.0 + 0.5) AS BIGINT) + 1""")
def sample_rows(spark, sf):
    """Three records, evenly spread over the listing."""
    return O.evenly_spaced(items(spark, sf).select("id", F.lower("name").alias("low")), ["low", "id"]).select("id", "pick")


@query("cache_keys", """SELECT doc_id, substr(sha256(source), 1, 12) || ':' || sha1(text) || ':jpg:2048' || CASE WHEN copy > 0 THEN ':copy' || copy ELSE '' END AS key
    FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) - 1 AS copy FROM documents)""")
def cache_keys(spark, sf):
    d = texts(spark, sf).select("doc_id", "source", F.sha1("text").alias("blob"))
    c = O.positions(d, ["blob"], ["doc_id"]).withColumn("copy", F.col("pos") - 1)
    return c.select("doc_id", F.concat(F.substring(F.sha2("source", 256), 1, 12), F.lit(":"), "blob", F.lit(":jpg:2048"),
                                       F.when(F.col("copy") > 0, F.concat(F.lit(":copy"), F.col("copy").cast("string"))).otherwise("")).alias("key"))


@query("json_fields", """SELECT event_id, CAST(json_extract_string(p, '$.k') AS INT) AS k, json_extract_string(p, '$.original.sha1') AS original_sha1
    FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN '{"original":{"sha1":"' || sha1(props) || '"},' || substr(props, 2) ELSE props END AS p FROM events)""")
def json_fields(spark, sf):
    p = F.when(F.col("event_type") == "click", F.concat(F.lit('{"original":{"sha1":"'), F.sha1("props"), F.lit('"},'), F.expr("substr(props, 2)"))).otherwise(F.col("props"))
    j = F.from_json(p, "k int, original struct<sha1:string>")
    return table(spark, sf, "events").select("event_id", j["k"].alias("k"), j["original"]["sha1"].alias("original_sha1"))


@query("locale_fallback", """WITH k AS (SELECT DISTINCT p_name AS key FROM part), l AS (SELECT unnest(['de', 'fr', 'es']) AS lang),
    t AS (SELECT p_name AS key, CASE p_type WHEN 'PROMO' THEN 'de' WHEN 'LARGE' THEN 'fr' WHEN 'SMALL' THEN 'es' ELSE 'en' END AS lang, min(p_brand) AS text FROM part GROUP BY 1, 2)
    SELECT k.key, l.lang, coalesce(o.text, e.text) AS text FROM k CROSS JOIN l LEFT JOIN t o ON o.key = k.key AND o.lang = l.lang LEFT JOIN t e ON e.key = k.key AND e.lang = 'en'""")
def locale_fallback(spark, sf):
    """Texts per language with the fallback language behind them. Three fixed languages per key."""
    lang = F.when(F.col("p_type") == "PROMO", "de").when(F.col("p_type") == "LARGE", "fr").when(F.col("p_type") == "SMALL", "es").otherwise("en")
    t = table(spark, sf, "part").groupBy(F.col("p_name").alias("key")).agg(
        *[F.min(F.when(lang == x, F.col("p_brand"))).alias(x) for x in ("en", "de", "fr", "es")])
    rows = F.array(*[F.struct(F.lit(x).alias("lang"), F.coalesce(x, "en").alias("text")) for x in ("de", "fr", "es")])
    return t.select("key", F.explode(rows).alias("r")).select("key", "r.lang", "r.text")
