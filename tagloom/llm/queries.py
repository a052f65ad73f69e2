"""Queries of the operators: each derives its digest columns from the rows of the operator."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query
from . import bpe, conversations, exact, language, minhash, packing, quality, repeats, secrets, simhash, spelling, toxicity, vectors
from .common import documents, held_out, stash, texts

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = language.dictionaries(docs.where(~held_out(4, 2)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), "text")
    found = language.identify(rows, learned)
    return found.select("row.doc_id", "row.held_out", F.col("language.name").alias("lang_pred"), "language.score", "language.margin", "language.accepted")


@query("op7_exact", """
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", exact.full_hash("text").alias("text_sha256"))
    return exact.exact_groups(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "keep_id", "group_size", "kept", "row.text_sha256")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, kind)) for kind in secrets.KINDS]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{kind}") for n, kind in zip(counts, secrets.KINDS)]
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(F.encode(secrets.joined(base), "UTF-8"), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "place"), place="place")


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(texts(documents(spark, sf_dir)), *vocabulary).select("doc_id", "ids"), *vocabulary)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.with_edits(documents(spark, sf_dir))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), F.xxhash64("text").alias("h"), "text")
    features = stash(quality.measured(rows, ["doc_id", "held_out", "h"]))
    found = quality.score(features, quality.learn(features.where("NOT held_out"), labels))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(3, 1).alias("held_out"), "text")
    model = toxicity.learn(rows.where("NOT held_out"), labels)
    margins = toxicity.measured(rows, model, ["doc_id", "held_out"])
    margins = stash(margins) if model else margins
    found = toxicity.scored(margins, model, toxicity.cut(margins.where("NOT held_out"), labels) if model else 0.0)
    return found.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


@query("op10_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_spelling", r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL),
coded AS (SELECT run, k, hex(concat(doc_id, ':', run)) AS x FROM runs),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, crc),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON b.rest = a.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.root AND f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM ways w JOIN forms f ON f.word = w.root AND f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON e.word = f.word""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(documents(spark, sf_dir), typos=97))


@query("op12_vectors", """
WITH RECURSIVE fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
low AS (SELECT a, least(a, min(b)) AS root FROM reached GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.root, e.vec_id) AS component_id, coalesce(low.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op13_conversations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report, lines = conversations.repair(conversations.damaged(rows))
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()  # also those that lost all rows
    joined = known.unionByName(report, True).unionByName(conversations.digests(lines), True).groupBy("conv_id")
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), nothing).alias("repaired_sha256"))
