"""Training runs: prices, costs, progress, loss, epochs and status."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import positions

# ---- fixed values ----
TERMINAL = ["succeeded", "failed", "expired", "canceled"]
ACTIVE = ["preparing", "queued", "running", "stopping"]
JOB_STATUS = {"queued": "queued", "running": "running", "stopping": "stopping", "completed": "succeeded", "error": "failed",
              "stopped": "canceled"}
POINTS = 300
PRICE_FLOOR = 0.8
# ---- end of fixed values ----


def price(steps: Column, epochs: Column, per_step: Column, per_epoch: Column) -> Column:
    """Half-even rounding; null where a type has no price."""
    return F.bround(steps * per_step + epochs * per_epoch).cast("long")


def price_estimate(steps: Column, epochs: Column, per_step: Column, per_epoch: Column, default: Column) -> Column:
    """Half-up rounding, never below 80 % of the default configuration."""
    return F.greatest(F.floor(steps * per_step + epochs * per_epoch + 0.5), F.floor(default * PRICE_FLOOR + 0.5)).cast("long")


def costs(runs: DataFrame, transactions: DataFrame) -> DataFrame:
    """charged = debits - credits (null without transactions; other types count for nothing), refunded = credits or null, cost_full = the base
    price ``quoted`` where it is above ``total``, the price after discounts. Amounts in cents, so sums are exact whatever the order."""
    of = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("cents")).otherwise(0)).alias(kind)
    t = transactions.groupBy("run_id").agg(of("debit"), of("credit"))
    j = runs.join(t, "run_id", "left")
    return j.select("run_id", (F.col("debit") - F.col("credit")).alias("charged"), F.nullif(F.col("credit"), F.lit(0)).alias("refunded"),
                    F.when(F.col("quoted") > F.col("total"), F.bround(F.col("quoted")).cast("long")).alias("cost_full"))


def last_events(trace: DataFrame) -> DataFrame:
    """Last event of each type per run, as an aggregate; the same plan serves a stream in update mode."""
    return trace.groupBy("run_id", "type").agg(F.max_by(F.struct("event_id", "ts", "step", "sps", "phase"), F.struct("ts", "event_id")).alias("e")) \
        .select("run_id", "type", "e.*")


def progress(runs: DataFrame, trace: DataFrame, now: Column) -> DataFrame:
    """Progress of open runs from the last trace events.

    ``runs``: run_id, status, total_steps, epochs, epochs_done, rate, started_at, complete_at (timestamps), max_steps, epoch.
    """
    is_step = F.col("type") == "step"
    last = trace.groupBy("run_id").agg(
        F.max_by(F.when(is_step, F.struct("step", "sps")), F.when(is_step, F.struct("ts", "event_id"))).alias("s"),
        F.max_by(F.when(F.col("type") == "phase", F.col("phase")), F.when(F.col("type") == "phase", F.struct("ts", "event_id"))).alias("phase"),
        F.max_by(F.when(F.col("type") == "error", F.col("phase")), F.when(F.col("type") == "error", F.struct("ts", "event_id"))).alias("error"))
    j = runs.where(~F.col("status").isin(TERMINAL)).join(last, "run_id", "left")
    per_epoch = F.coalesce((F.col("max_steps") < F.col("total_steps") * 0.9) & (F.col("epochs") > 0), F.lit(False))
    raw = F.col("s.step") + F.when(per_epoch, (F.coalesce("epoch", F.lit(1)) - 1) * F.col("max_steps")).otherwise(0)
    j = j.withColumn("total", F.when(F.col("s.step").isNotNull() & ~per_epoch, F.coalesce("max_steps", "total_steps")).otherwise(F.col("total_steps"))) \
         .withColumn("at", F.when(raw.isNotNull(), F.least(raw, F.coalesce("total", raw))))
    rate = F.when(F.col("rate") > 1, F.col("rate") / 100).otherwise(F.col("rate"))
    part = F.coalesce(F.when(F.col("total") > 0, F.col("at") / F.col("total")),
                      F.when((F.col("epochs") > 0) & (F.col("epochs_done") > 0), F.col("epochs_done") / F.col("epochs")), rate)
    j = j.withColumn("frac", F.when(part.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)))) \
         .withColumn("elapsed", (now.cast("long") - F.col("started_at").cast("long")))
    by_speed = F.when((F.col("s.sps") > 0) & (F.col("total") > 0), (F.col("total") - F.col("at")) * F.col("s.sps"))
    by_time = F.when((F.col("frac") >= 0.02) & (F.col("elapsed") > 0), F.col("elapsed") * (1 - F.col("frac")) / F.col("frac"))
    by_queue = F.when(F.col("complete_at").isNotNull(), F.greatest(F.lit(0.0), F.col("complete_at").cast("double") - now.cast("double")))
    return j.select(
        "run_id", F.when(F.col("started_at").isNull(), "queued").otherwise("training").alias("stage"), "phase", "error",
        F.col("at").alias("step"), F.col("total").alias("total_steps"), F.bround(F.col("frac") * 100, 1).alias("percent"),
        F.floor(F.coalesce(by_speed, by_time, by_queue)).cast("long").alias("remaining_seconds"))


def seconds_per_step(speed: Column) -> Column:
    n = F.regexp_extract(speed, r"^\s*([\d.]+)\s*(sec/iter|iter/sec)", 1).try_cast("double")
    unit = F.regexp_extract(speed, r"^\s*([\d.]+)\s*(sec/iter|iter/sec)", 2)
    return F.when(n > 0, F.when(unit == "sec/iter", n).otherwise(1 / n))


def save_every(steps: Column, epochs: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(steps / F.greatest(F.lit(1), epochs))).cast("long")


def local_progress(runs: DataFrame) -> DataFrame:
    """``runs``: run_id, status, step, total_steps, steps, epochs, speed."""
    total, step, sps = F.coalesce("total_steps", "steps"), F.coalesce("step", F.lit(0)), seconds_per_step(F.col("speed"))
    return runs.where(F.col("status").isin(ACTIVE)).select(
        "run_id", step.alias("step"), total.alias("total_steps"), sps.alias("seconds_per_step"),
        F.bround(step / total * 100, 1).alias("percent"), F.bround((total - step) * sps).cast("long").alias("remaining_seconds"),
        F.floor(step / save_every(F.col("steps"), F.col("epochs"))).cast("long").alias("epochs_done"))


def loss_curve(loss: DataFrame, points: int = POINTS, digits: int = 5) -> DataFrame:
    """At most ``points`` averages per run. ``loss``: run_id, step (unique), value. A long run stays spread."""
    kept = positions(loss.where(F.col("value").isNotNull()), ["run_id"], ["step"], "n")
    sizes = kept.groupBy("run_id").agg(F.greatest(F.lit(1), F.ceil(F.max("n") / points)).alias("size"))
    return kept.join(sizes, "run_id").groupBy("run_id", F.floor((F.col("n") - 1) / F.col("size")).alias("chunk")).agg(
        F.max("step").alias("step"), F.bround(F.avg("value"), digits).alias("value"))


def epoch_files(files: DataFrame, samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Model file and sample count per saved step. ``files``/``samples``: run_id, name. ``runs``: run_id, steps, epochs."""
    numbered = F.regexp_extract("name", r"_(\d{9})\.safetensors$", 1)
    f = files.where(F.endswith(F.col("name"), F.lit(".safetensors"))).join(runs, "run_id").select(
        "run_id", F.when(numbered != "", numbered.try_cast("long")).otherwise(F.col("steps")).alias("step"), "name") \
        .groupBy("run_id", "step").agg(F.max("name").alias("file"))
    mark = F.regexp_extract("name", r"__(\d{9})_\d+\.\w+$", 1)
    s = samples.where((mark != "") & ~F.endswith(F.col("name"), F.lit(".thumb.jpg"))) \
        .groupBy("run_id", mark.cast("long").alias("step")).agg(F.count("*").alias("samples"))
    j = f.join(s, ["run_id", "step"], "full").join(runs, "run_id")
    epoch = F.least(F.col("epochs"), F.greatest(F.lit(1), F.ceil(F.col("step") / save_every(F.col("steps"), F.col("epochs")))))
    return j.select("run_id", "step", "file", F.coalesce("samples", F.lit(0).cast("long")).alias("samples"), epoch.cast("long").alias("epoch"),
                    F.col("file").isNotNull().alias("available"))


def family(base: Column, size: Column) -> Column:
    known = F.when(F.startswith(base, F.lit("SD 1")), "sd15").when(base.rlike("SDXL|Illustrious|NoobAI|Pony|Animagine"), "sdxl")
    return F.when(F.coalesce(base, F.lit("")) != "", known).otherwise(F.when(size > 5e9, "sdxl").otherwise("sd15"))


def run_tag(run: Column) -> Column:
    shape = r"^\d+-(\d{8})\d*-(\w+)$"
    short = F.regexp_replace(run, r"\W+", "")
    return F.when(run.rlike(shape), F.concat(F.regexp_extract(run, shape, 1), F.lit("_"), F.regexp_extract(run, shape, 2))) \
        .otherwise(F.right(short, F.lit(8)))


def clean_params(params: dict[str, Column], defaults: dict[str, object], max_batch: int) -> dict[str, Column]:
    filled = {k: F.coalesce(params[k], F.lit(v)) if k in params else F.lit(v) for k, v in defaults.items() if k != "resolutions"}
    filled["batch_size"] = F.greatest(F.lit(1), F.least(filled["batch_size"].cast("int"), F.lit(max_batch)))
    wanted = F.sort_array(F.array_distinct(params["resolutions"]))
    fallback = F.array(*[F.lit(x) for x in defaults["resolutions"]])
    filled["resolutions"] = F.when(F.size(wanted) > 0, wanted).otherwise(fallback)
    return filled


def active(runs: DataFrame, now: Column) -> DataFrame:
    """Open runs, and those that ended well or badly within a day; runs older than a week only if open."""
    open_ = ~F.col("status").isin(TERMINAL)
    recent = (F.col("created_at") > now - F.expr("INTERVAL 7 DAYS")) & F.col("status").isin("succeeded", "failed") & (
        F.coalesce("completed_at", "updated_at") > now - F.expr("INTERVAL 24 HOURS"))
    return runs.where(open_ | recent)


def watch_refund(now: Column) -> Column:
    """Cancelled or failed runs are watched for an hour: a refund may come late."""
    return F.col("status").isin("canceled", "failed") & F.coalesce(now - F.expr("INTERVAL 1 HOUR") < F.col("completed_at"), F.lit(False))


def recover(status: Column, job: Column) -> tuple[Column, Column]:
    """After a restart: preparing without a job failed, preparing with one is queued."""
    cut = status == "preparing"
    none = F.coalesce(job, F.lit("")) == ""
    return F.when(cut & none, "failed").when(cut, "queued").otherwise(status), F.when(cut & none, "interrupted")
