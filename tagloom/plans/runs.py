"""Training runs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as U
from ..operators import order as O
from .captions import FIT_SQL, caption_fit
from .registry import query
from .views import RUNS, TRACE, runs, table, texts, trace, transactions

NOW = "1999-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("run_costs", f"""WITH {RUNS}, t AS (SELECT run_id, sum(CASE WHEN type = 'debit' THEN cents ELSE 0 END) AS debit, sum(CASE WHEN type = 'credit' THEN cents ELSE 0 END) AS credit FROM transactions GROUP BY 1)
    SELECT r.run_id, CAST(debit - credit AS BIGINT) AS charged, CAST(nullif(credit, 0) AS BIGINT) AS refunded, CASE WHEN quoted > r.total THEN CAST(round_even(quoted, 0) AS BIGINT) END AS cost_full FROM runs r LEFT JOIN t ON t.run_id = r.run_id""")
def run_costs(spark, sf):
    return U.costs(runs(spark, sf), transactions(spark, sf))


@query("type_prices", "SELECT p_partkey AS id, CASE WHEN p_type <> 'PROMO' THEN CAST(round_even(1000 * (p_size / 100.0::DOUBLE) + 10 * (p_size % 7), 0) AS BIGINT) END AS default_price FROM part")
def type_prices(spark, sf):
    per_step = F.when(F.col("p_type") != "PROMO", F.col("p_size") / 100.0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), U.price(F.lit(1000), F.lit(10), per_step, F.col("p_size") % 7).alias("default_price"))


@query("price_estimate", """SELECT o_orderkey AS id, CAST(greatest(floor((100 + o_orderkey % 900) * 0.45::DOUBLE + (1 + o_orderkey % 10) * 10 + 0.5), floor(550 * 0.8::DOUBLE + 0.5)) AS BIGINT) AS estimate FROM orders""")
def price_estimate(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), U.price_estimate(100 + k % 900, 1 + k % 10, F.lit(0.45), F.lit(10), F.lit(550)).alias("estimate"))


@query("trace_parse", f"WITH {TRACE} SELECT event_id, run_id, type, step FROM trace WHERE event_id % 11 > 0")
def trace_parse(spark, sf):
    """NDJSON lines to events: broken lines are dropped, never fatal."""
    e = table(spark, sf, "events")
    t = trace(e)
    line = F.to_json(F.struct("event_id", "run_id", "type", "step"))
    lines = t.select(F.when(F.col("event_id") % 11 == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("line"))
    j = F.from_json("line", "event_id long, run_id long, type string, step int, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(j.alias("j")).where(F.col("j._corrupt_record").isNull()).select("j.event_id", "j.run_id", "j.type", "j.step")


@query("trace_last", f"WITH {TRACE} SELECT run_id, type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(step, (ts, event_id)) AS step FROM trace GROUP BY 1, 2")
def trace_last(spark, sf):
    return U.last_events(trace(table(spark, sf, "events"))).select("run_id", "type", "event_id", "step")


PROGRESS = RUNS + ", " + TRACE + """,
plan AS (SELECT run_id, status, total_steps, epochs, CAST(run_id % 4 AS INT) AS epochs_done, CASE WHEN run_id % 5 = 0 THEN 40.0 WHEN run_id % 5 = 1 THEN 0.3 END AS rate,
    CASE WHEN run_id % 6 > 0 THEN created_at END AS started_at, CASE WHEN run_id % 3 = 0 THEN created_at + INTERVAL 900 DAY END AS complete_at,
    CASE run_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 1000 END AS max_steps, CAST(1 + run_id % 3 AS INT) AS epoch FROM runs),
last AS (SELECT run_id, arg_max(step, (ts, event_id)) FILTER (type = 'step') AS s, arg_max(sps, (ts, event_id)) FILTER (type = 'step') AS sps, max(CASE WHEN type = 'phase' THEN phase END) AS phase,
    max(CASE WHEN type = 'error' THEN phase END) AS error FROM trace GROUP BY 1),
a AS (SELECT p.*, l.s, l.sps, l.phase, l.error, coalesce(max_steps < total_steps * 0.9, false) AS per_epoch FROM plan p LEFT JOIN last l ON l.run_id = p.run_id WHERE status NOT IN ('succeeded', 'failed', 'expired', 'canceled')),
b AS (SELECT *, CASE WHEN s IS NOT NULL AND NOT per_epoch THEN coalesce(max_steps, total_steps) ELSE total_steps END AS total, s + CASE WHEN per_epoch THEN (epoch - 1) * max_steps ELSE 0 END AS r FROM a),
c AS (SELECT *, CASE WHEN r IS NOT NULL THEN least(r, total) END AS pos FROM b),
e AS (SELECT *, coalesce(pos * 1.0::DOUBLE / total, CASE WHEN epochs_done > 0 THEN epochs_done * 1.0::DOUBLE / epochs END, CASE WHEN rate > 1 THEN rate / 100 ELSE rate END) AS part FROM c),
d AS (SELECT *, CASE WHEN part IS NOT NULL THEN least(1.0, greatest(0.0, part)) END AS frac, epoch(TIMESTAMP '1999-06-01 00:00:00') - epoch(started_at) AS elapsed FROM e)"""


@query("run_progress", f"""WITH {PROGRESS} SELECT run_id, CASE WHEN started_at IS NULL THEN 'queued' ELSE 'training' END AS stage, phase, error, CAST(pos AS BIGINT) AS step, CAST(total AS BIGINT) AS total_steps,
    round_even(frac * 100, 1) AS percent, CAST(floor(coalesce(CASE WHEN sps > 0 THEN (total - pos) * sps END, CASE WHEN frac >= 0.02 AND elapsed > 0 THEN elapsed * (1 - frac) / frac END,
      CASE WHEN complete_at IS NOT NULL THEN greatest(0.0, epoch(complete_at) - epoch(TIMESTAMP '1999-06-01 00:00:00')) END)) AS BIGINT) AS remaining_seconds FROM d""")
def run_progress(spark, sf):
    k = F.col("run_id")
    plan = runs(spark, sf).select(
        "run_id", "status", "total_steps", "epochs", (k % 4).cast("int").alias("epochs_done"), F.when(k % 5 == 0, 40.0).when(k % 5 == 1, 0.3).alias("rate"),
        F.when(k % 6 > 0, F.col("created_at")).cast("timestamp").alias("started_at"), F.when(k % 3 == 0, F.col("created_at") + F.expr("INTERVAL 900 DAYS")).cast("timestamp").alias("complete_at"),
        F.when(k % 3 == 0, 100).when(k % 3 == 1, 1000).alias("max_steps"), (1 + k % 3).cast("int").alias("epoch"))
    p = U.progress(plan, trace(table(spark, sf, "events")), F.lit(NOW).cast("timestamp"))
    return p.withColumn("step", F.col("step").cast("long")).withColumn("total_steps", F.col("total_steps").cast("long"))


LOCAL = """local AS (SELECT o_orderkey AS run_id, (['preparing', 'queued', 'running', 'stopping', 'succeeded'])[CAST(o_orderkey % 5 AS INT) + 1] AS status, CAST(o_orderkey % 500 AS INT) AS step,
    CASE WHEN o_orderkey % 3 > 0 THEN CAST(500 + o_orderkey % 500 AS INT) END AS total_steps, 800 AS steps, CAST(o_orderkey % 12 AS INT) AS epochs,
    CASE o_orderkey % 4 WHEN 0 THEN ' 2.26 iter/sec' WHEN 1 THEN '1.53 sec/iter' WHEN 2 THEN '0 iter/sec' ELSE '' END AS speed FROM orders)"""


def local(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("run_id"), F.array(*[F.lit(s) for s in ("preparing", "queued", "running", "stopping", "succeeded")])[(k % 5).cast("int")].alias("status"),
        (k % 500).cast("int").alias("step"), F.when(k % 3 > 0, (500 + k % 500).cast("int")).alias("total_steps"), F.lit(800).alias("steps"), (k % 12).cast("int").alias("epochs"),
        F.when(k % 4 == 0, " 2.26 iter/sec").when(k % 4 == 1, "1.53 sec/iter").when(k % 4 == 2, "0 iter/sec").otherwise("").alias("speed"))


_SPS = "CASE WHEN speed = ' 2.26 iter/sec' THEN 1 / 2.26::DOUBLE WHEN speed = '1.53 sec/iter' THEN 1.53::DOUBLE END"


@query("parse_speed", f"WITH {LOCAL} SELECT run_id, round({_SPS}, 6) AS sps FROM local")
def parse_speed(spark, sf):
    return local(spark, sf).select("run_id", F.round(U.seconds_per_step(F.col("speed")), 6).alias("sps"))


@query("run_progress_local", f"""WITH {LOCAL}, t AS (SELECT *, coalesce(total_steps, steps) AS total, {_SPS} AS sps FROM local WHERE status <> 'succeeded')
    SELECT run_id, step, total AS total_steps, round(sps, 6) AS seconds_per_step, round_even(step * 1.0::DOUBLE / total * 100, 1) AS percent, CAST(round_even((total - step) * sps, 0) AS BIGINT) AS remaining_seconds,
      CAST(floor(step / greatest(1, ceil(steps / greatest(1, epochs)))) AS BIGINT) AS epochs_done FROM t""")
def run_progress_local(spark, sf):
    return U.local_progress(local(spark, sf)).withColumn("seconds_per_step", F.round("seconds_per_step", 6))


LOSS = """loss AS (SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS step,
    CASE WHEN l_tax > 0.01 THEN l_discount END AS value FROM lineitem)"""
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def loss(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_id"), *_LINE)
    return O.positions(rows, ["run_id"], _LINE, "step").select("run_id", "step", F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("value"))


@query("loss_curve", f"""WITH {LOSS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n, count(*) OVER (PARTITION BY run_id) AS total FROM loss WHERE value IS NOT NULL)
    SELECT run_id, CAST(floor((n - 1) / greatest(1, ceil(total / 50.0))) AS BIGINT) AS chunk, max(step) AS step, round(avg(value), 6) AS value FROM k GROUP BY 1, 2""")
def loss_curve(spark, sf):
    return U.loss_curve(loss(spark, sf), 50, 6)


@query("loss_summary", f"WITH {LOSS} SELECT run_id, arg_min(value, step) AS first, arg_max(value, step) AS last, min(value) + 0.0 AS low, max(value) + 0.0 AS high FROM loss WHERE value IS NOT NULL GROUP BY 1")
def loss_summary(spark, sf):
    kept = loss(spark, sf).where(F.col("value").isNotNull())
    return kept.groupBy("run_id").agg(F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"),
                                      (F.min("value") + 0.0).alias("low"), (F.max("value") + 0.0).alias("high"))


EPOCHS = """r AS (SELECT o_orderkey AS run_id, CAST(500 + o_orderkey % 700 AS BIGINT) AS steps, CAST(1 + o_orderkey % 9 AS BIGINT) AS epochs FROM orders),
f AS (SELECT DISTINCT l_orderkey AS run_id, CASE WHEN l_linenumber = 1 THEN 'job.safetensors' ELSE 'job_' || lpad(CAST(l_linenumber * 150 AS VARCHAR), 9, '0') || CASE WHEN l_returnflag = 'R' THEN '.tmp' ELSE '.safetensors' END END AS name, l_linenumber, l_returnflag FROM lineitem),
s AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) * 150 AS step, count(*) AS samples FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
m AS (SELECT f.run_id, CASE WHEN l_linenumber = 1 THEN steps ELSE l_linenumber * 150 END AS step, max(name) AS file FROM f JOIN r ON r.run_id = f.run_id WHERE name LIKE '%.safetensors' GROUP BY 1, 2)"""


@query("epoch_files", f"""WITH {EPOCHS}, j AS (SELECT coalesce(m.run_id, s.run_id) AS run_id, coalesce(m.step, s.step) AS step, file, coalesce(samples, 0) AS samples FROM m FULL JOIN s ON s.run_id = m.run_id AND s.step = m.step)
    SELECT j.run_id, step, file, samples, CAST(least(epochs, greatest(1, ceil(step / greatest(1, ceil(steps / epochs))))) AS BIGINT) AS epoch, file IS NOT NULL AS available FROM j JOIN r ON r.run_id = j.run_id""")
def epoch_files(spark, sf):
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    r = table(spark, sf, "orders").select(k.alias("run_id"), (500 + k % 700).cast("long").alias("steps"), (1 + k % 9).cast("long").alias("epochs"))
    nine = F.lpad((n * 150).cast("string"), 9, "0")
    line = table(spark, sf, "lineitem")
    f = line.select(F.col("l_orderkey").alias("run_id"), F.when(n == 1, "job.safetensors").otherwise(
        F.concat(F.lit("job_"), nine, F.when(F.col("l_returnflag") == "R", ".tmp").otherwise(".safetensors"))).alias("name")).distinct()
    s = line.where(F.col("l_linestatus") == "O").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("job__"), nine, F.lit("_0.jpg")).alias("name"))
    return U.epoch_files(f, s, r)


@query("run_tag", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y%m%d') || '_x' || o_custkey ELSE right('runs' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 8) END AS tag FROM orders""")
def run_tag(spark, sf):
    run = F.when(F.col("o_orderstatus") == "P", F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("-x"), F.col("o_custkey").cast("string"))) \
        .otherwise(F.concat(F.lit("runs-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), U.run_tag(run).alias("tag"))


@query("parse_times", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS at FROM orders")
def parse_times(spark, sf):
    """ISO text with Z or offset to epoch seconds, null for anything else."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("at "), day)).when(F.col("o_orderstatus") == "P", F.concat(day, F.lit("Z"))).otherwise(F.concat(day, F.lit("+00:00")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.try_to_timestamp(text).cast("long").alias("at"))




@query("model_family", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'sd15' WHEN p_partkey % 5 IN (1, 2) THEN 'sdxl' WHEN p_partkey % 5 = 4 THEN CASE WHEN p_retailprice * 5e6 > 5e9 THEN 'sdxl' ELSE 'sd15' END END AS family FROM part""")
def model_family(spark, sf):
    base = F.array(*[F.lit(x) for x in ("SD 1.5", "SDXL 1.0", "Pony", "Flux.1", "")])[(F.col("p_partkey") % 5).cast("int")]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), U.family(base, F.col("p_retailprice") * 5e6).alias("family"))


@query("run_notes", "SELECT p_partkey AS id, concat_ws(', ', 'steps=' || p_size, CASE WHEN p_size > 10 THEN 'epochs=' || (p_size % 7) END, CASE WHEN p_type = 'PROMO' THEN 'optimizerType=' || p_brand END) AS notes FROM part")
def run_notes(spark, sf):
    note = lambda k, c: F.concat(F.lit(k + "="), c.cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(
        ", ", note("steps", F.col("p_size")), F.when(F.col("p_size") > 10, note("epochs", F.col("p_size") % 7)), F.when(F.col("p_type") == "PROMO", note("optimizerType", F.col("p_brand")))).alias("notes"))


@query("preview_pick", r"""SELECT run, CASE WHEN count(*) FILTER (NOT regexp_matches(u, '(?i)\.(mp4|webm)(\?|$)')) > 0 THEN arg_min(u, k) FILTER (NOT regexp_matches(u, '(?i)\.(mp4|webm)(\?|$)')) ELSE arg_min(u, k) END AS preview
    FROM (SELECT user_id AS run, event_id AS k, 'http://h/' || event_id || CASE event_type WHEN 'view' THEN '.png' WHEN 'click' THEN '.MP4' ELSE '.webm?x=1' END AS u FROM events) GROUP BY 1""")
def preview_pick(spark, sf):
    """First picture sample, else the first sample."""
    u = F.concat(F.lit("http://h/"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "view", ".png").when(F.col("event_type") == "click", ".MP4").otherwise(".webm?x=1"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("k"), u.alias("u"))
    still = ~F.col("u").rlike(r"(?i)\.(mp4|webm)(\?|$)")
    return e.groupBy("run").agg(F.coalesce(F.min_by(F.when(still, F.col("u")), F.when(still, F.col("k"))), F.min_by("u", "k")).alias("preview"))


_DONE = "created_at + to_hours(CAST(run_id % 400 AS INT))"


def dated(spark, sf):
    k = F.col("run_id")
    return runs(spark, sf).withColumn("completed_at", F.when(k % 2 == 0, F.col("created_at") + F.make_dt_interval(F.lit(0), (k % 400).cast("int")))) \
        .withColumn("updated_at", F.col("created_at") + F.expr("INTERVAL 3 DAYS"))


_DATED = RUNS + f", dated AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN {_DONE} END AS completed_at, created_at + INTERVAL 3 DAY AS updated_at FROM runs)"


@query("active_runs", f"""WITH {_DATED} SELECT run_id, status FROM dated WHERE status NOT IN ('succeeded', 'failed', 'expired', 'canceled')
    OR (created_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND status IN ('succeeded', 'failed') AND coalesce(completed_at, updated_at) > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)""")
def active_runs(spark, sf):
    return U.active(dated(spark, sf), now()).select("run_id", "status")


@query("refund_watch", f"WITH {_DATED} SELECT run_id, status = 'failed' AND coalesce(completed_at > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR, false) AS watch FROM dated")
def refund_watch(spark, sf):
    return dated(spark, sf).select("run_id", U.watch_refund(now()).alias("watch"))


@query("stale_runs", f"WITH {_DATED} SELECT run_id FROM dated WHERE updated_at <= TIMESTAMP '{NOW}' - INTERVAL 15 SECOND")
def stale_runs(spark, sf):
    """Runs whose stored summary is too old to serve."""
    return dated(spark, sf).where(F.col("updated_at") <= now() - F.expr("INTERVAL 15 SECONDS")).select("run_id")


@query("runs_recent", f"""WITH {RUNS} SELECT run_id, c_name AS project_name, created_at FROM runs JOIN customer ON c_custkey = project_id
    WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY OR status NOT IN ('succeeded', 'failed', 'expired', 'canceled') ORDER BY created_at DESC, run_id""")
def runs_recent(spark, sf):
    """The project side is joined by size statistics, not by a forced broadcast."""
    r = runs(spark, sf).where((F.col("created_at") > now() - F.expr("INTERVAL 7 DAYS")) | ~F.col("status").isin(U.TERMINAL))
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"))
    return r.join(p, "project_id").select("run_id", "project_name", "created_at").orderBy(F.col("created_at").desc(), "run_id")


@query("runs_with_imports", """SELECT o_orderkey AS run_id, coalesce(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)), '') AS imported FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' GROUP BY 1""")
def runs_with_imports(spark, sf):
    """Imported epochs per run; the list is distinct epoch numbers, so it stays short."""
    imp = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "A").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("e"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id")).join(imp, "run_id", "left").select("run_id", F.coalesce(F.array_join(F.col("e").cast("array<string>"), ","), F.lit("")).alias("imported"))


@query("run_status_fold", """SELECT user_id AS run_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'canceled' END AS status FROM events GROUP BY 1""")
def run_status_fold(spark, sf):
    """Last outside status per job, mapped to ours."""
    e = F.col("event_type")
    outside = F.when(e == "view", "queued").when(e == "click", "running").when(e == "purchase", "completed").when(e == "error", "error").otherwise("stopped")
    m = F.create_map(*[F.lit(x) for kv in U.JOB_STATUS.items() for x in kv])
    last = table(spark, sf, "events").withColumn("o", outside).groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("o", F.struct("ts", "event_id")).alias("o"))
    return last.select("run_id", m[F.col("o")].alias("status"))


@query("recover_interrupted", f"""WITH {LOCAL} SELECT run_id, CASE WHEN status = 'preparing' THEN CASE WHEN step % 2 = 0 THEN 'failed' ELSE 'queued' END ELSE status END AS status,
    CASE WHEN status = 'preparing' AND step % 2 = 0 THEN 'interrupted' END AS error FROM local""")
def recover_interrupted(spark, sf):
    status, error = U.recover(F.col("status"), F.when(F.col("step") % 2 == 1, F.col("run_id").cast("string")).otherwise(""))
    return local(spark, sf).select("run_id", status.alias("status"), error.alias("error"))


@query("cache_hits", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 25 DAY GROUP BY 1, 2""")
def cache_hits(spark, sf):
    """Newest cached value per key that is younger than 25 days."""
    e = table(spark, sf, "events").where(F.col("ts") > F.lit("2024-01-30 12:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 25 DAYS"))
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("params_clean", """SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 2000 ELSE p_size * 100 END AS steps, greatest(1, least(CASE WHEN p_size % 4 = 3 THEN 1 ELSE p_size % 9 END, 4)) AS batch_size,
    CASE WHEN p_size % 3 = 0 THEN '512,768' WHEN p_size % 3 = 1 THEN '768,1024' ELSE '1024' END AS resolutions FROM part""")
def params_clean(spark, sf):
    z = F.col("p_size")
    given = {"steps": F.when(F.col("p_type") != "PROMO", z * 100), "batch_size": F.when(z % 4 != 3, z % 9),
             "resolutions": F.when(z % 3 == 0, F.array(F.lit(768), F.lit(512), F.lit(768))).when(z % 3 == 1, F.array(F.lit(1024), F.lit(768))).otherwise(F.array().cast("array<int>"))}
    p = U.clean_params(given, {"steps": 2000, "batch_size": 1, "resolutions": [1024]}, 4)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), p["steps"].alias("steps"), p["batch_size"].alias("batch_size"), F.array_join(p["resolutions"].cast("array<string>"), ",").alias("resolutions"))


@query("param_violations", """SELECT p_partkey AS id, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'base_model' WHEN p_size > 30 THEN 'min_snr_gamma' END AS field FROM part WHERE p_type IN ('PROMO', 'LARGE') OR p_size > 30""")
def param_violations(spark, sf):
    """Fields a training type does not have: given but unknown."""
    given = F.map_from_arrays(F.array(F.lit("trigger_word"), F.lit("base_model"), F.lit("min_snr_gamma")),
                              F.array(F.lit("x"), F.when(F.col("p_type").isin("PROMO", "LARGE"), "m"), F.when((F.col("p_size") > 30) & ~F.col("p_type").isin("PROMO", "LARGE"), "5")))
    set_ = F.map_keys(F.map_filter(given, lambda k, v: v.isNotNull()))
    extra = F.array_except(set_, F.array(F.lit("trigger_word")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(extra).alias("field"))


@query("training_input", """SELECT p_partkey AS id, least(p_size % 9 + 1, 4) AS batch, p_size % 2 = 0 AS shuffle, CASE WHEN p_size % 2 = 0 THEN least(10, p_size) ELSE 0 END AS keep, CASE WHEN p_type <> 'PROMO' THEN p_name END AS trigger_word FROM part""")
def training_input(spark, sf):
    """Merged training input: batch clamped, fixed leading pieces capped at ten and only with shuffling, trigger only where supported."""
    z, shuffle = F.col("p_size"), F.col("p_size") % 2 == 0
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.greatest(F.lit(1), F.least(z % 9 + 1, F.lit(4))).alias("batch"), shuffle.alias("shuffle"),
                                           F.when(shuffle, F.least(F.lit(10), z)).otherwise(0).alias("keep"), F.when(F.col("p_type") != "PROMO", F.trim("p_name")).alias("trigger_word"))


WORKFLOW = """'{"id":"' || o_orderkey || '","status":"' || o_orderstatus || '","cost":{"total":' || o_custkey || ',"factors":{"base":' || (o_custkey * 2) || '}},"steps":[{"$type":"other"},{"$type":"training","priority":"' || o_orderpriority || '","input":{"steps":' || (o_orderkey % 900) || ',"lr":0.5},"output":{"epochs":[{"epochNumber":1,"model":{"url":"u"}},{"epochNumber":2}]}}]}'"""


def workflows(spark, sf):
    c = lambda x: F.col(x).cast("string")
    text = F.concat(F.lit('{"id":"'), c("o_orderkey"), F.lit('","status":"'), "o_orderstatus", F.lit('","cost":{"total":'), c("o_custkey"), F.lit(',"factors":{"base":'), (F.col("o_custkey") * 2).cast("string"),
                    F.lit('}},"steps":[{"$type":"other"},{"$type":"training","priority":"'), "o_orderpriority", F.lit('","input":{"steps":'), (F.col("o_orderkey") % 900).cast("string"),
                    F.lit(',"lr":0.5},"output":{"epochs":[{"epochNumber":1,"model":{"url":"u"}},{"epochNumber":2}]}}]}'))
    schema = ("id string, status string, cost struct<total:double,factors:struct<base:double>>, steps array<struct<`$type`:string,priority:string,"
              "input:struct<steps:int,lr:double,epochs:int>,output:struct<epochs:array<struct<epochNumber:int,model:struct<url:string,available:boolean>>>>>>")
    return table(spark, sf, "orders").select(F.from_json(text, schema).alias("w"))


@query("workflow_flatten", f"""WITH w AS (SELECT {WORKFLOW} AS t FROM orders) SELECT json_extract_string(t, '$.id') AS id, json_extract_string(t, '$.status') AS status, json_extract_string(t, '$.steps[1].priority') AS priority,
    CAST(json_extract_string(t, '$.cost.total') AS DOUBLE) AS cost, CASE WHEN CAST(json_extract_string(t, '$.cost.factors.base') AS DOUBLE) > CAST(json_extract_string(t, '$.cost.total') AS DOUBLE) THEN CAST(json_extract_string(t, '$.cost.factors.base') AS BIGINT) END AS cost_full,
    CAST(json_extract_string(t, '$.steps[1].input.steps') AS INT) AS steps, 2 AS epochs, 1 AS epochs_available FROM w""")
def workflow_flatten(spark, sf):
    """One JSON document per run to columns."""
    w = workflows(spark, sf).withColumn("s", F.get(F.filter("w.steps", lambda x: x["$type"] == "training"), F.lit(0)))
    ep = F.col("s.output.epochs")
    ready = F.filter(ep, lambda e: F.coalesce(e["model"]["available"], F.coalesce(e["model"]["url"] != "", F.lit(False))))
    base, cost = F.col("w.cost.factors.base"), F.col("w.cost.total")
    return w.select("w.id", "w.status", "s.priority", cost.alias("cost"), F.when(base > cost, F.bround(base).cast("long")).alias("cost_full"),
                    F.col("s.input.steps").alias("steps"), F.size(ep).alias("epochs"), F.size(ready).alias("epochs_available"))


@query("run_request", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 900 AS INT) AS steps, 0.5::DOUBLE AS lr, '' AS trigger_word, NULL::INT AS epochs FROM orders")
def run_request(spark, sf):
    """The training input of a run mapped back to form fields."""
    w = workflows(spark, sf).withColumn("s", F.get(F.filter("w.steps", lambda x: x["$type"] == "training"), F.lit(0)))
    return w.select("w.id", F.col("s.input.steps").alias("steps"), F.col("s.input.lr").alias("lr"), F.lit("").alias("trigger_word"), F.col("s.input.epochs").alias("epochs"))


@query("fit_summary", f"""WITH fit AS ({FIT_SQL}), c AS (SELECT doc_id AS id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) - 1 AS copy FROM documents)
    SELECT count(*) AS total, count(*) FILTER (removed > 0) AS truncated, CAST(sum(removed) AS BIGINT) AS truncated_tags, count(*) FILTER (copy > 0) AS copies, count(*) FILTER (l.toxic = 1) AS blocked
    FROM fit JOIN c ON c.id = fit.id LEFT JOIN labels l ON l.doc_id = fit.id""")
def fit_summary(spark, sf):
    """Counters of a preparation: shortened captions, removed tags, copies, blocked records."""
    d = texts(spark, sf).select(F.col("doc_id").alias("id"), F.sha1("text").alias("blob"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    j = O.positions(d, ["blob"], ["id"]).join(caption_fit(spark, sf).select("id", "removed"), "id").join(lab, "id", "left")
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("removed") > 0).alias("truncated"), F.sum("removed").alias("truncated_tags"),
                 F.count_if(F.col("pos") > 1).alias("copies"), F.count_if(F.col("toxic") == 1).alias("blocked"))
