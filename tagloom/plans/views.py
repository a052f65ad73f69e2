"""The curation tables as views over the given tables, once for Spark and once as SQL text.

Every view covers its whole source tables and whole texts. None needs a window over an unbounded key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import BUCKETS, word_buckets
from ..functions.tags import let


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, spread by id when the files give fewer splits than there are cores (a small or unsplittable input)."""
    d, cores = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= cores else d.repartition(cores, "doc_id")


ROWS = 250_000  # rows of a large table that a task sorts or hashes, about, so that its memory does not grow with the table


def dealt(rows: DataFrame, of: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by columns over as many tasks as the rows of ``of`` ask for; few rows stay as they are. A task count that is given is kept,
    where adaptive execution would merge tasks by their compressed bytes."""
    tasks = -(-of.count() // ROWS)
    return rows if tasks <= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(tasks, *by)


# ------------------------------------------------------------------ items: captioned records
EXTENSIONS = [".png", ".JPG", ".webp", ".bmp"]
ITEMS = """
words AS (SELECT doc_id, w, min(pos) AS pos FROM (
    SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS l FROM documents)) WHERE w <> '' GROUP BY 1, 2),
tagged AS (SELECT doc_id, list(w ORDER BY pos) AS tags FROM words GROUP BY 1),
items AS (SELECT d.doc_id AS id, d.source AS project_id,
    'IMG ' || (d.doc_id % 97) || (['.png','.JPG','.webp','.bmp'])[CAST(d.doc_id % 4 AS INT) + 1] AS name,
    64 + d.n_chars % 1500 AS width, 64 + (d.n_chars * 7) % 1500 AS height, sha1(d.text) AS sha1,
    coalesce(t.tags, []) AS tags, CASE WHEN l.quality = 1 THEN d.text ELSE '' END AS nl,
    CASE WHEN l.toxic = 1 THEN 'questionable' WHEN l.quality = 1 THEN 'general' WHEN l.quality = 0 THEN 'sensitive' END AS rating,
    CASE WHEN l.doc_id IS NULL THEN CASE WHEN d.lang = 'en' THEN 'pending' ELSE 'queued' END
         WHEN l.toxic = 1 THEN 'error' ELSE 'done' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN tagged t ON t.doc_id = d.doc_id)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = texts(spark, sf), table(spark, sf, "labels")
    ext = F.array(*[F.lit(e) for e in EXTENSIONS])[(F.col("doc_id") % 4).cast("int")]
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("project_id"),
        F.concat(F.lit("IMG "), (F.col("doc_id") % 97).cast("string"), ext).alias("name"),
        (64 + F.col("n_chars") % 1500).alias("width"), (64 + (F.col("n_chars") * 7) % 1500).alias("height"),
        F.sha1("text").alias("sha1"),
        F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("tags"),
        F.when(F.col("quality") == 1, F.col("text")).otherwise("").alias("nl"),
        F.when(F.col("toxic") == 1, "questionable").when(F.col("quality") == 1, "general")
        .when(F.col("quality") == 0, "sensitive").alias("rating"),
        F.when(F.col("quality").isNull(), F.when(F.col("lang") == "en", "pending").otherwise("queued"))
        .when(F.col("toxic") == 1, "error").otherwise("done").alias("status"))


WORD_SCORES = ITEMS + """,
counted AS (SELECT doc_id AS id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents)
  WHERE w <> '' GROUP BY 1, 2),
word_scores AS (SELECT id, w AS tag, n * 1.0::DOUBLE / (n + 4) AS score FROM counted WHERE length(w) > 2)"""


def word_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per record, a frequency score for every word of more than two letters."""
    words = texts(spark, sf).select(
        F.col("doc_id").alias("id"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name"))
    counted = words.where(F.length("name") > 2).groupBy("id", "name").agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(F.collect_list(F.struct("name", (F.col("n") / (F.col("n") + 4)).alias("score"))).alias("general"))


# ------------------------------------------------------------------ projects: per-project setting overrides
PROJECTS = """
projects AS (SELECT c_custkey AS project_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'pony_v6' WHEN 'AUTOMOBILE' THEN 'sdxl_base' WHEN 'MACHINERY' THEN 'flux1_dev'
      WHEN 'HOUSEHOLD' THEN 'animagine_xl' ELSE 'mystery' END AS profile,
    (['character', 'style', 'concept', 'odd'])[CAST(c_nationkey % 4 AS INT) + 1] AS lora_type,
    CASE WHEN c_acctbal < 0 THEN 'high' WHEN c_acctbal < 5000 THEN '0.' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') WHEN c_acctbal < 8000 THEN '1.7' END AS o_general_threshold,
    CASE WHEN c_nationkey < 20 THEN CAST(c_nationkey - 5 AS VARCHAR) END AS o_max_tags,
    CASE c_nationkey % 5 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'weird' WHEN 2 THEN 'natural' WHEN 3 THEN 'trigger_only' END AS o_caption_mode,
    CASE WHEN c_nationkey % 3 > 0 THEN ' T' || c_custkey || ' ' END AS o_trigger,
    CASE c_nationkey % 3 WHEN 0 THEN ' white box ,, grey ' WHEN 1 THEN ' , ' END AS o_block_tag,
    CASE c_nationkey % 7 WHEN 0 THEN 'merge' WHEN 1 THEN 'bad' WHEN 2 THEN 'only' END AS o_vlm_tags,
    c_nationkey % 2 = 0 AS o_use_wd14, CASE WHEN c_nationkey % 3 < 2 THEN c_nationkey % 3 = 0 END AS o_add_quality_tags,
    CASE c_custkey % 3 WHEN 1 THEN 'after_tags' WHEN 2 THEN 'sideways' END AS o_nl_position, c_name AS class_word FROM customer)"""


def projects(spark: SparkSession, sf: str) -> DataFrame:
    seg, n, bal = F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.when(seg == "BUILDING", "pony_v6").when(seg == "AUTOMOBILE", "sdxl_base").when(seg == "MACHINERY", "flux1_dev")
        .when(seg == "HOUSEHOLD", "animagine_xl").otherwise("mystery").alias("profile"),
        F.array(*[F.lit(k) for k in ("character", "style", "concept", "odd")])[(n % 4).cast("int")].alias("lora_type"),
        F.when(bal < 0, "high").when(bal < 5000, F.concat(F.lit("0."), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")))
        .when(bal < 8000, "1.7").alias("o_general_threshold"),
        F.when(n < 20, (n - 5).cast("string")).alias("o_max_tags"),
        F.when(n % 5 == 0, "hybrid").when(n % 5 == 1, "weird").when(n % 5 == 2, "natural").when(n % 5 == 3, "trigger_only")
        .alias("o_caption_mode"),
        F.when(n % 3 > 0, F.concat(F.lit(" T"), F.col("c_custkey").cast("string"), F.lit(" "))).alias("o_trigger"),
        F.when(n % 3 == 0, " white box ,, grey ").when(n % 3 == 1, " , ").alias("o_block_tag"),
        F.when(n % 7 == 0, "merge").when(n % 7 == 1, "bad").when(n % 7 == 2, "only").alias("o_vlm_tags"),
        (n % 2 == 0).alias("o_use_wd14"), F.when(n % 3 < 2, n % 3 == 0).alias("o_add_quality_tags"),
        F.when(F.col("c_custkey") % 3 == 1, "after_tags").when(F.col("c_custkey") % 3 == 2, "sideways").alias("o_nl_position"), F.col("c_name").alias("class_word"))


# ------------------------------------------------------------------ tag_scores: one row per prediction
SCORES = """
tag_scores AS (SELECT l_orderkey AS entity, replace(p_name, ' ', '_') AS tag,
    CASE WHEN p_type = 'PROMO' THEN 'character' ELSE 'general' END AS category, max(l_quantity) / 50.0 AS score
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""


def tag_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    named = dealt(lines, lines, "l_partkey").join(dealt(parts, lines, "p_partkey"), F.col("p_partkey") == F.col("l_partkey"))
    return dealt(named, lines, "l_orderkey").groupBy(
        F.col("l_orderkey").alias("entity"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("tag"),
        F.when(F.col("p_type") == "PROMO", "character").otherwise("general").alias("category"),
    ).agg((F.max("l_quantity") / 50.0).alias("score"))


# ------------------------------------------------------------------ raw: per record, all predictions as arrays
# The language-model lists come from returned lines, grouped by part type. Lists are bounded by the tag vocabulary.
RAW = SCORES + """,
vlm_lines AS (SELECT DISTINCT l_orderkey AS entity, p_name AS tag, CASE p_type WHEN 'PROMO' THEN 'character'
    WHEN 'LARGE' THEN 'copyright' WHEN 'SMALL' THEN 'artist' ELSE 'general' END AS part
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'),
raw AS (SELECT entity,
    coalesce(list({'name': tag, 'score': score} ORDER BY score DESC, tag) FILTER (category = 'general'), []) AS general,
    coalesce(list({'name': tag, 'score': score} ORDER BY score DESC, tag) FILTER (category = 'character'), []) AS chars
  FROM tag_scores GROUP BY 1),
vlm AS (SELECT entity,
    coalesce(list(tag ORDER BY tag) FILTER (part = 'character'), []) AS v_char,
    coalesce(list(tag ORDER BY tag) FILTER (part = 'copyright'), []) AS v_copy,
    coalesce(list(tag ORDER BY tag) FILTER (part = 'artist'), []) AS v_artist,
    coalesce(list(tag ORDER BY tag) FILTER (part = 'general'), []) AS v_general
  FROM vlm_lines GROUP BY 1)"""


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """entity, raw struct(general, character, vlm). One scan, one shuffle: the map side already reduces per entity."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")) \
        .groupBy(F.col("l_orderkey").alias("entity"), F.col("p_name").alias("tag"), F.col("p_type").alias("kind")) \
        .agg((F.max("l_quantity") / 50.0).alias("score"), F.bool_or(F.col("l_returnflag") == "R").alias("told"))
    name = F.replace("tag", F.lit(" "), F.lit("_"))
    pair = F.struct(name.alias("name"), (-F.col("score")).alias("o"))
    promo = F.col("kind") == "PROMO"
    told = lambda c: F.sort_array(F.collect_set(F.when(F.col("told") & c, F.col("tag"))))
    grouped = lines.groupBy("entity").agg(
        F.collect_list(F.when(~promo, pair)).alias("g"), F.collect_list(F.when(promo, pair)).alias("c"),
        told(promo).alias("v_char"), told(F.col("kind") == "LARGE").alias("v_copy"),
        told(F.col("kind") == "SMALL").alias("v_artist"),
        told(~F.col("kind").isin("PROMO", "LARGE", "SMALL")).alias("v_general"))

    def best(c: str):
        """Best score per name (one name can come from several part types), best first."""
        once = let(F.sort_array(F.col(c)), lambda a: F.filter(a, lambda x, i: (i == 0) | (x["name"] != F.get(a, i - 1)["name"])))
        ordered = F.sort_array(F.transform(once, lambda x: F.struct(x["o"].alias("o"), x["name"].alias("name"))))
        return F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), (-x["o"]).alias("score")))

    return grouped.select("entity", F.struct(
        best("g").alias("general"), best("c").alias("character"),
        F.struct(F.col("v_char").alias("character"), F.col("v_copy").alias("copyright"),
                 F.col("v_artist").alias("artist"), F.col("v_general").alias("general")).alias("vlm")).alias("raw"))


# ------------------------------------------------------------------ fingerprints: 64-bit hash in two halves, 64-value signature
FINGERPRINTS = """
tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS tok FROM documents),
buckets AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 2))::INT % 64 AS b, count(*) AS n FROM tok WHERE tok <> '' GROUP BY 1, 2),
grid AS (SELECT x.doc_id, r.b, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT doc_id FROM buckets) x
    CROSS JOIN range(64) r(b) LEFT JOIN buckets k ON k.doc_id = x.doc_id AND k.b = r.b),
stats AS (SELECT doc_id, median(n) AS med, max(n) AS mx FROM grid GROUP BY 1),
fingerprints AS (SELECT g.doc_id AS id,
    CAST(sum(CASE WHEN n > med AND b < 32 THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS lo,
    CAST(sum(CASE WHEN n > med AND b >= 32 THEN 1::BIGINT << (b - 32) ELSE 0 END) AS BIGINT) AS hi,
    list(CAST(floor(255.0::DOUBLE * n / mx) AS INT) ORDER BY b) AS sig
  FROM grid g JOIN stats s ON s.doc_id = g.doc_id GROUP BY 1)"""


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """One row of 64 bucket counts for each text, summed by record; then median, bits and signature inside the row."""
    lowered = texts(spark, sf).select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    counts = lowered.mapInArrow(word_buckets, f"id {lowered.schema['id'].dataType.simpleString()}, h array<bigint>")
    wide = counts.groupBy("id").agg(*[F.sum(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(BUCKETS)])
    wide = wide.select("id", F.array(*[f"h{i}" for i in range(BUCKETS)]).alias("h")).withColumn("s", F.sort_array("h"))
    med = (F.col("s")[31] + F.col("s")[32]) / 2.0

    def bits(first: int):
        half = F.transform(F.slice("h", first + 1, 32),
                           lambda n, i: F.when(n > F.col("med"), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.aggregate(half, F.lit(0).cast("long"), lambda a, x: a + x)

    wide = wide.withColumn("med", med)
    return wide.select("id", bits(0).alias("lo"), bits(32).alias("hi"),
                       F.transform("h", lambda n: F.floor(F.lit(255.0) * n / F.col("s")[63]).cast("int")).alias("sig"))


# ------------------------------------------------------------------ features: vectors with a role and a manual mark
FEATURES = """
features AS (SELECT vec_id AS id, embedding, label,
    CASE WHEN label = 3 AND vec_id % 10 = 0 THEN 'ref' WHEN label = 5 AND vec_id % 10 = 1 THEN 'neg' ELSE 'pool' END AS role,
    CASE WHEN vec_id % 41 = 0 THEN 1 WHEN vec_id % 43 = 0 THEN -1 WHEN vec_id % 47 = 0 THEN 2 END AS manual FROM embeddings)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        i.alias("id"), "embedding", "label",
        F.when((F.col("label") == 3) & (i % 10 == 0), "ref").when((F.col("label") == 5) & (i % 10 == 1), "neg")
        .otherwise("pool").alias("role"),
        F.when(i % 41 == 0, 1).when(i % 43 == 0, -1).when(i % 47 == 0, 2).alias("manual"))


# ------------------------------------------------------------------ detections: boxes in a frame
FRAME = (1280.0, 980.0)
DETECTIONS = """
detections AS (SELECT l_orderkey AS entity, CASE WHEN l_linenumber % 2 = 0 THEN 'head' ELSE 'person' END AS kind,
    l_linenumber || '-' || l_partkey || '-' || l_suppkey AS box,
    max(l_quantity) * 20 AS x0, (l_suppkey % 100) * 5.0::DOUBLE AS y0,
    max(l_quantity) * 20 + 100 + (l_partkey % 200) * 1.0::DOUBLE AS x1,
    (l_suppkey % 100) * 5.0::DOUBLE + 150 + (l_partkey % 300) * 1.0::DOUBLE AS y1,
    round(max(l_extendedprice) / 110000.0, 3) AS conf FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    g = dealt(lines, lines, "l_orderkey").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(
        F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    x0, y0 = F.col("q") * 20, (F.col("l_suppkey") % 100) * 5.0
    return g.select(
        F.col("l_orderkey").alias("entity"), F.when(F.col("l_linenumber") % 2 == 0, "head").otherwise("person").alias("kind"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("box"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 100 + (F.col("l_partkey") % 200) * 1.0).alias("x1"), (y0 + 150 + (F.col("l_partkey") % 300) * 1.0).alias("y1"),
        F.round(F.col("p") / 110000.0, 3).alias("conf"))


# ------------------------------------------------------------------ runs, transactions, trace
RUNS = """
runs AS (SELECT o_orderkey AS run_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status,
    o_orderdate AS created_at, 100 + o_orderkey % 900 AS total_steps, 10 AS epochs, o_totalprice AS quoted,
    CASE o_orderkey % 3 WHEN 0 THEN o_totalprice * 0.75 WHEN 1 THEN o_totalprice END AS total FROM orders),
transactions AS (SELECT l_orderkey AS run_id, CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_linenumber = 5 THEN 'tip' ELSE 'debit' END ELSE 'credit' END AS type,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"""
TRACE = """
trace AS (SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'phase' WHEN 'error' THEN 'error' ELSE 'step' END AS type,
    CAST(json_extract_string(props, '$.k') AS INT) AS step, value / 10 AS sps, event_type AS phase FROM events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "succeeded")
        .otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"), (100 + F.col("o_orderkey") % 900).alias("total_steps"),
        F.lit(10).alias("epochs"), F.col("o_totalprice").alias("quoted"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 0.75).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice")).alias("total"))


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") != "R", F.when(F.col("l_linenumber") == 5, "tip").otherwise("debit")).otherwise("credit").alias("type"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


def trace(df: DataFrame) -> DataFrame:
    """Training events from an events frame; works on a static and on a streaming frame."""
    kind = F.col("event_type")
    return df.select(
        F.col("user_id").alias("run_id"), "event_id", "ts",
        F.when(kind == "signup", "phase").when(kind == "error", "error").otherwise("step").alias("type"),
        F.get_json_object("props", "$.k").cast("int").alias("step"), (F.col("value") / 10).alias("sps"), kind.alias("phase"))


# ------------------------------------------------------------------ files: a listing with sidecars
FILES = """
paths AS (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN '/.x' ELSE '' END || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS stem,
    length(html) AS size, regexp_extract(url, '^https?://([^/]+)', 1) AS root, html FROM pages),
files AS (SELECT page_id * 2 AS ord, root, stem || (['.png','.JPG','.txt','.caption','.db'])[CAST(page_id % 5 AS INT) + 1] AS path, size, html FROM paths
  UNION ALL SELECT page_id * 2 + 1, root, stem || '.txt', size, html FROM paths WHERE page_id % 3 = 0)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    p = table(spark, sf, "pages").select(
        i, F.concat(F.when(i % 17 == 0, "/.x").otherwise(""), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)).alias("stem"),
        F.length("html").cast("long").alias("size"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("root"), "html")
    ext = F.array(*[F.lit(e) for e in (".png", ".JPG", ".txt", ".caption", ".db")])[(i % 5).cast("int")]
    own = p.select((i * 2).alias("ord"), "root", F.concat("stem", ext).alias("path"), "size", "html")
    twin = p.where(i % 3 == 0).select((i * 2 + 1).alias("ord"), "root", F.concat("stem", F.lit(".txt")).alias("path"), "size", "html")
    return own.unionByName(twin)
