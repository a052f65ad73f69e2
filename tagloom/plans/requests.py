"""Training requests: forms to inputs, documents of runs to columns and back to forms.

Forms come from ``part``, documents of runs from ``orders`` with their ``lineitem`` rows as epochs and transactions.
"""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import requests as R
from .registry import query
from .views import table

KINDS = {
    "plain": R.Kind("alpha", {}, ("base_model", "trigger_word", "min_snr_gamma", "train_text_encoder", "text_encoder_lr"), 4),
    "large": R.Kind("beta", {"modelVariant": "l"}, ("trigger_word",), 2),
    "small": R.Kind("beta", {"modelVariant": "s"}),
}

_FORMS = """forms AS (SELECT p_partkey AS id, p_size AS z, p_name, CASE p_type WHEN 'ECONOMY' THEN 'plain' WHEN 'STANDARD' THEN 'large' WHEN 'PROMO' THEN 'small' WHEN 'LARGE' THEN 'plain' ELSE 'other' END AS kind,
    CASE WHEN p_size % 4 <> 0 THEN p_size * 100 END AS steps, CASE WHEN p_size % 5 <> 0 THEN p_size % 7 END AS batch_size, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS shuffle,
    CASE WHEN p_partkey % 4 <> 1 THEN p_size END AS keep, CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name || ' ' WHEN 1 THEN '' END AS word, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 END AS encoder,
    CASE WHEN p_size % 2 = 1 THEN p_size / 1000.0 END AS encoder_lr, CASE WHEN p_size % 6 = 0 THEN 5.0 END AS gamma, CASE p_partkey % 5 WHEN 0 THEN 'm' || p_size WHEN 1 THEN '' END AS model,
    CASE p_partkey % 4 WHEN 0 THEN ' bad ' WHEN 1 THEN ' ' END AS negative, p_brand FROM part)"""


def forms(spark, sf):
    """id, kind, form, and the project's trigger, negative, shuffle and keep."""
    i, z, when = F.col("p_partkey"), F.col("p_size"), F.when
    given = {
        "steps": when(z % 4 != 0, z * 100), "batch_size": when(z % 5 != 0, z % 7), "min_snr_gamma": when(z % 6 == 0, 5.0),
        "train_text_encoder": when(z % 3 == 0, z % 2 == 0), "text_encoder_lr": when(z % 2 == 1, z / 1000.0),
        "base_model": when(i % 5 == 0, F.concat(F.lit("m"), z.cast("string"))).when(i % 5 == 1, ""),
        "trigger_word": when(i % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(i % 3 == 1, ""),
        "shuffle_tokens": when(i % 3 == 0, i % 2 == 0), "keep_tokens": when(i % 4 != 1, z),
        "sample_negative": when(i % 4 == 0, " bad ").when(i % 4 == 1, " "), "continue_from": when(z % 8 == 0, F.col("p_brand")),
        "sample_prompts": F.array("p_name", "p_type"), "sample_cfg": when(z % 7 == 0, z / 2),
    }
    form = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(R.FORM)])
    kind = when(F.col("p_type").isin("ECONOMY", "LARGE"), "plain").when(F.col("p_type") == "STANDARD", "large").when(F.col("p_type") == "PROMO", "small").otherwise("other")
    return table(spark, sf, "part").select(
        i.alias("id"), kind.alias("kind"), form.alias("form"), F.concat(F.lit("t "), "p_brand").alias("trigger"),
        R.default_negative(when(z % 2 == 0, "worst").otherwise(""), F.col("p_brand"), z % 3 == 1).alias("negative"),
        (z % 2 == 0).alias("shuffle"), (z % 5).alias("keep"))


def inputs(spark, sf):
    items = F.array(F.struct(F.concat(F.lit("blob"), F.col("id").cast("string")).alias("url"), F.col("form.sample_prompts")[0].alias("caption")))
    built = R.build_input(F.col("kind"), F.col("form"), KINDS, model=F.col("form.base_model"), items=items, trigger=F.col("trigger"),
                          negative=F.col("negative"), shuffle=F.col("shuffle"), keep=F.col("keep"))
    return forms(spark, sf).select("id", "kind", "form", built.alias("input"))


@query("request_input", f"""WITH {_FORMS}, f AS (SELECT *, coalesce(shuffle, z % 2 = 0) AS sh, trim(coalesce(word, 't ' || p_brand)) AS w, kind = 'plain' AS p FROM forms WHERE kind <> 'other')
    SELECT id, CASE kind WHEN 'plain' THEN 'alpha' ELSE 'beta' END AS ecosystem, CASE kind WHEN 'large' THEN 'l' WHEN 'small' THEN 's' END AS variant, nullif(model, '') AS model, CAST(steps AS INT) AS steps,
    greatest(1, least(batch_size, CASE kind WHEN 'plain' THEN 4 WHEN 'large' THEN 2 ELSE 1 END)) * CASE WHEN batch_size IS NOT NULL THEN 1 END AS batch, CASE WHEN p THEN gamma END AS gamma,
    CASE WHEN p THEN encoder END AS encoder, CASE WHEN p AND coalesce(encoder, true) THEN encoder_lr END AS encoder_lr, sh AS shuffle, CAST(CASE WHEN sh THEN least(10, coalesce(keep, z % 5)) ELSE 0 END AS INT) AS keep,
    CASE WHEN kind <> 'small' THEN nullif(w, '') END AS word, CASE WHEN z % 8 = 0 THEN p_brand END AS continued, 'blob' || id AS url, p_name AS prompt,
    nullif(coalesce(trim(negative), concat_ws(', ', CASE WHEN z % 2 = 0 THEN 'worst' END, CASE WHEN z % 3 = 1 THEN p_brand END)), '') AS negative, CASE WHEN z % 7 = 0 THEN z / 2.0 END AS cfg FROM f""")
def request_input(spark, sf):
    """The inputs of all forms, read back from their documents."""
    d = inputs(spark, sf).where("input IS NOT NULL").select("id", F.from_json(F.to_json("input"), R.INPUT).alias("i"))
    return d.select(
        "id", "i.ecosystem", F.col("i.modelVariant").alias("variant"), "i.model", "i.steps", F.col("i.batchSize").alias("batch"), F.col("i.minSnrGamma").alias("gamma"),
        F.col("i.trainTextEncoder").alias("encoder"), F.col("i.textEncoderLr").alias("encoder_lr"), F.col("i.shuffleTokens").alias("shuffle"), F.col("i.keepTokens").alias("keep"),
        F.col("i.triggerWord").alias("word"), F.col("i.continueFrom").alias("continued"), F.col("i.trainingData.items")[0]["url"].alias("url"),
        F.col("i.samples.prompts")[0].alias("prompt"), F.col("i.samples.negativePrompt").alias("negative"), F.col("i.samples.cfgScale").alias("cfg"))


@query("request_unsupported", f"""WITH {_FORMS} SELECT id, unnest(list_filter([CASE WHEN nullif(model, '') IS NOT NULL THEN 'base_model' END, CASE WHEN kind IN ('small', 'other') AND nullif(word, '') IS NOT NULL THEN 'trigger_word' END,
    CASE WHEN gamma IS NOT NULL THEN 'min_snr_gamma' END, CASE WHEN encoder IS NOT NULL THEN 'train_text_encoder' END, CASE WHEN encoder_lr IS NOT NULL THEN 'text_encoder_lr' END],
    lambda f: f IS NOT NULL AND (f = 'trigger_word' OR kind <> 'plain'))) AS field FROM forms""")
def request_unsupported(spark, sf):
    """Fields that a form gives and its training type lacks."""
    return forms(spark, sf).select("id", F.explode(R.unsupported(F.col("kind"), F.col("form"), KINDS)).alias("field"))


@query("request_again", f"""WITH {_FORMS}, f AS (SELECT *, coalesce(shuffle, z % 2 = 0) AS sh, kind = 'plain' AS p FROM forms WHERE kind <> 'other')
    SELECT id, kind AS training_type, CAST(steps AS INT) AS steps, CASE WHEN p THEN nullif(model, '') END AS base_model, CASE WHEN kind <> 'small' THEN trim(coalesce(word, 't ' || p_brand)) END AS trigger_word, sh AS shuffle_tokens,
    CAST(CASE WHEN sh THEN least(10, coalesce(keep, z % 5)) ELSE 0 END AS INT) AS keep_tokens, CASE WHEN z % 8 = 0 THEN p_brand ELSE '' END AS continue_from, 2 AS prompts,
    coalesce(trim(negative), concat_ws(', ', CASE WHEN z % 2 = 0 THEN 'worst' END, CASE WHEN z % 3 = 1 THEN p_brand END)) AS sample_negative, CASE WHEN p AND coalesce(encoder, true) THEN encoder_lr END AS text_encoder_lr,
    CASE WHEN id % 3 = 1 THEN z END AS max_side, CASE WHEN id % 4 = 2 THEN z % 2 = 0 END AS only_done FROM f""")
def request_again(spark, sf):
    """The form that repeats a run: the input of a form, mapped back."""
    i, z = F.col("id"), F.col("z")
    run = F.struct(F.lit(None).cast("boolean").alias("allowMatureContent"), F.struct(F.when(i % 3 == 1, z).when(i % 3 == 0, 0).alias("max_side"), F.when(i % 4 == 2, z % 2 == 0).alias("only_done")).alias("metadata"))
    d = inputs(spark, sf).where("input IS NOT NULL").join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("z")), "id")
    return d.select("id", R.request(run, F.col("input"), KINDS).alias("r")).select(
        "id", "r.training_type", "r.steps", "r.base_model", "r.trigger_word", "r.shuffle_tokens", "r.keep_tokens", "r.continue_from",
        F.size("r.sample_prompts").alias("prompts"), "r.sample_negative", "r.text_encoder_lr", "r.max_side", "r.only_done")


def documents(spark, sf):
    """One JSON document for each run."""
    k, c, when = F.col("o_orderkey"), F.col("o_custkey"), F.when
    key = lambda mark: F.concat(F.lit(mark), k.cast("string"))
    line = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    url = when(flag != "N", F.concat(F.lit("u"), F.col("l_partkey").cast("string"))).otherwise("")
    epoch = F.struct(F.col("l_linenumber").alias("epochNumber"), F.struct(url.alias("url"), when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 2 == 0).alias("available")).alias("model"),
                     F.array(F.struct(url.alias("url")), F.struct(F.lit("x").alias("url"))).alias("samples"), when(flag == "R", "t").alias("traceUrl"))
    paid = F.struct(when(flag == "R", "credit").when(flag == "A", "debit").otherwise("other").alias("type"), F.col("l_quantity").cast("long").alias("amount"))
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(epoch).alias("epochs"), F.collect_list(paid).alias("list"))
    full = k % 9 != 0
    given = when(k % 6 != 0, F.struct(
        F.lit("beta").alias("ecosystem"), when(k % 4 == 0, "l").when(k % 4 == 1, "s").otherwise("x").alias("modelVariant"), when(full, k % 900).alias("steps"),
        when(full & (k % 3 == 0), F.lit(4)).alias("epochs"), when(full, F.lit(0.5)).alias("lr"), when(k % 5 == 1, True).alias("shuffleTokens"), key("g").alias("triggerWord")))
    step = F.struct(F.lit("training").alias("$type"), F.lit("working").alias("status"), F.col("o_orderpriority").alias("priority"), when(k % 2 == 0, key("s")).alias("startedAt"),
                    (c / 1000).alias("estimatedProgressRate"), when(k % 4 == 0, F.struct((k % 13).alias("precedingJobs"))).alias("queuePosition"), given.alias("input"),
                    when(F.col("epochs").isNotNull(), F.struct(F.lit("approved").alias("moderationStatus"), F.col("epochs"))).alias("output"))
    steps = F.concat(F.array(F.lit('{"$type":"other"}')), when(k % 7 != 0, F.array(F.to_json(step))).otherwise(F.array().cast("array<string>")))
    head = F.to_json(F.struct(
        key("").alias("id"), when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise("").alias("status"), key("c").alias("createdAt"), when(k % 3 == 0, key("w")).alias("startedAt"),
        F.struct(when(k % 5 != 0, c).alias("total"), F.struct((c % 100 * 2.5).alias("base")).alias("factors")).alias("cost"),
        F.struct(F.col("list"), when(k % 11 == 0, True).alias("insufficientBuzz")).alias("transactions"), when(k % 2 == 1, k % 3 == 0).alias("allowMatureContent")))
    text = F.concat(F.expr("substr(head, 1, length(head) - 1)"), F.lit(',"steps":['), F.array_join("steps", ","), F.lit("]}"))
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left").select(head.alias("head"), steps.alias("steps")).select(text.alias("document"))


_RUNS = """lines AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 2 = 0 ELSE l_returnflag <> 'N' END) AS ready, count(*) FILTER (l_returnflag = 'R') AS traced,
    count(*) + count(*) FILTER (l_returnflag <> 'N') AS samples, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS debit, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS credit FROM lineitem GROUP BY 1),
  runs AS (SELECT o.*, o_orderkey AS k, o_custkey AS c, o_orderkey % 7 <> 0 AS t, o_orderkey % 7 <> 0 AND o_orderkey % 6 <> 0 AS g, o_orderkey % 7 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 9 <> 0 AS p,
    l.n, l.ready, l.traced, l.samples, l.debit, l.credit FROM orders o LEFT JOIN lines l ON l.k = o.o_orderkey)"""


@query("run_summary", f"""WITH {_RUNS} SELECT CAST(k AS VARCHAR) AS id, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN t THEN 'working' END AS status, CASE WHEN t THEN 'working' END AS step_status,
    CASE WHEN t AND n > 0 THEN 'approved' END AS moderation, CASE WHEN k % 5 <> 0 THEN CAST(c AS DOUBLE) END AS cost, CASE WHEN k % 5 <> 0 AND c % 100 * 2.5 > c THEN CAST(round_even(CAST(c % 100 * 2.5 AS DOUBLE), 0) AS BIGINT) END AS cost_full,
    CAST(CASE WHEN n > 0 THEN debit - credit END AS BIGINT) AS charged, CAST(nullif(credit, 0) AS BIGINT) AS refunded, CASE WHEN t THEN o_orderpriority END AS priority, k % 11 = 0 AS insufficient_funds, 'c' || k AS created_at,
    CASE WHEN t AND k % 2 = 0 THEN 's' || k WHEN k % 3 = 0 THEN 'w' || k END AS started_at, NULL::VARCHAR AS completed_at, CASE WHEN t THEN c / 1000.0::DOUBLE END AS progress_rate, CASE WHEN t AND k % 4 = 0 THEN k % 13 END AS ahead,
    CAST(CASE WHEN p THEN k % 900 END AS INT) AS plan_steps, CASE WHEN p AND k % 3 = 0 THEN 4 END AS plan_epochs, CASE WHEN p THEN 0.5::DOUBLE END AS lr, p AS has_params,
    CASE WHEN g THEN CASE k % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'small' END END AS training_type, CASE WHEN g AND k % 4 = 0 THEN 'g' || k END AS trigger_word,
    CASE WHEN g AND k % 4 < 2 AND k % 5 = 1 THEN 0 END AS keep_tokens, CASE WHEN g AND k % 4 < 2 AND k % 2 = 1 THEN k % 3 = 0 END AS allow_mature,
    CASE WHEN t THEN coalesce(n, 0) ELSE 0 END AS epochs, CASE WHEN t THEN coalesce(ready, 0) ELSE 0 END AS available, CASE WHEN t THEN coalesce(traced, 0) ELSE 0 END AS traced, CASE WHEN t THEN coalesce(samples, 0) ELSE 0 END AS samples FROM runs""")
def run_summary(spark, sf):
    """What a list of runs shows of each run's document."""
    w = documents(spark, sf).select(F.from_json("document", R.WORKFLOW).alias("w"))
    s = w.select(*[c.alias(name) for name, c in R.summary(F.col("w"), KINDS).items()])
    plain = ["id", "status", "step_status", "moderation", "cost", "cost_full", "charged", "refunded", "priority", "insufficient_funds", "created_at", "started_at", "completed_at", "progress_rate"]
    return s.select(*plain, "queue.ahead", F.col("input_plan.steps").alias("plan_steps"), F.col("input_plan.epochs").alias("plan_epochs"), "params.lr", F.col("params").isNotNull().alias("has_params"),
                    "request.training_type", "request.trigger_word", "request.keep_tokens", "request.allow_mature", F.size("epochs").alias("epochs"),
                    F.size(F.filter("epochs", lambda e: e["available"])).alias("available"), F.size(F.filter("epochs", lambda e: e["trace_url"].isNotNull())).alias("traced"),
                    F.aggregate("epochs", F.lit(0), lambda n, e: n + F.size(e["samples"])).alias("samples"))
