"""Structured Streaming forms: the given event table is read as a stream and run to its end."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as U
from ..sources import merged as M
from ..streaming import jobs as J
from ..streaming import trace as T
from ..streaming import ttl as TTL
from .registry import query
from .views import TRACE, table, trace


def stream(spark, sf, name="events"):
    schema = table(spark, sf, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)  # a stream reads folders only


def events(spark, sf):
    e = stream(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return T.event_time(e)


_N = "count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents"


@query("events_tumbling", f"SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, {_N} FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    """Events per day and type, streamed in update mode with an hour of lateness."""
    s = T.windowed(events(spark, sf), "1 hour", F.window("ts", "1 day"), ["event_type"])
    flat = s.select(F.col("w.start").cast("long").alias("start"), "event_type", "n", "cents")
    return J.drain_update(flat, "tumbling", ["start", "event_type"])


@query("events_sliding", f"""SELECT CAST(s AS BIGINT) AS start, event_type, {_N} FROM (SELECT *, unnest([CAST(epoch(date_trunc('hour', ts)) AS BIGINT), CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 3600]) AS s FROM events) GROUP BY 1, 2""")
def events_sliding(spark, sf):
    """Two-hour windows every hour."""
    s = T.windowed(events(spark, sf), "1 hour", F.window("ts", "2 hours", "1 hour"), ["event_type"])
    return J.drain_update(s.select(F.col("w.start").cast("long").alias("start"), "event_type", "n", "cents"), "sliding", ["start", "event_type"])


@query("events_session", f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, {_N} FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    """Sessions with a two-hour gap in append mode: the watermark closes a session, the end of input closes the open ones."""
    def closed(e):
        s = T.windowed(e, "1 hour", F.session_window("ts", "2 hours"), ["user_id"])
        return s.select("user_id", F.unix_micros("w.start").alias("start"), "n", "cents")

    return J.drain_closed(events(spark, sf).select("user_id", "ts", "cents"), closed, "session")


@query("cache_sights", """WITH RECURSIVE ordered AS (SELECT user_id || '/' || event_type AS key, epoch_us(ts) AS ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    walk AS (SELECT key, ts, event_id, n, ts AS stored, event_id AS value, false AS hit FROM ordered WHERE n = 1
      UNION ALL SELECT o.key, o.ts, o.event_id, o.n, CASE WHEN o.ts // 1000 - w.stored // 1000 < 86400000 THEN w.stored ELSE o.ts END,
        CASE WHEN o.ts // 1000 - w.stored // 1000 < 86400000 THEN w.value ELSE o.event_id END, o.ts // 1000 - w.stored // 1000 < 86400000
      FROM walk w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1)
    SELECT key, value, hit, count(*) AS sights FROM walk GROUP BY ALL""")
def cache_sights(spark, sf):
    """Hits and misses of a cache whose entries live for a day, as keyed state that timers free."""
    e = events(spark, sf).select(F.concat_ws("/", "user_id", "event_type").alias("key"), "ts", F.col("event_id").alias("value"))
    with J.timed_state(spark):
        seen = J.drain_append(TTL.cached(e, days=1), "cache", "update")
    return seen.groupBy("key", "value", "hit").agg(F.count("*").alias("sights"))


@query("silent_runs", """SELECT user_id AS run_id, epoch_us(max(ts)) // 1000 AS updated_ms, arg_max(event_type, (ts, event_type = 'purchase')) <> 'purchase' AND max(epoch_us(ts)) // 1000 + 259200000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) AS stale
    FROM events GROUP BY 1""")
def silent_runs(spark, sf):
    """Runs that have not been heard of for three days when the stream ends and have not ended themselves; timers find them."""
    e = events(spark, sf).select(F.col("user_id").alias("run_id"), "ts", (F.col("event_type") == "purchase").alias("ended"))
    with J.timed_state(spark):
        found = J.drain_update(TTL.silent(e, 3 * 86400), "silent", ["run_id"])
    return found.select("run_id", F.unix_millis("updated_at").alias("updated_ms"), "stale")


@query("stream_dedup", "SELECT user_id, event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    """One arrival per run, type and day."""
    e = events(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("long"))
    kept = T.drop_duplicates(e, ["user_id", "event_type", "day"], "30 days")
    return J.drain_append(kept.select("user_id", "event_type", "day"), "dedup")


@query("trace_last_stream", f"WITH {TRACE} SELECT run_id, type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(step, (ts, event_id)) AS step FROM trace GROUP BY 1, 2")
def trace_last_stream(spark, sf):
    """The batch plan of trace_last, unchanged, on a stream."""
    s = U.last_events(trace(stream(spark, sf))).select("run_id", "type", "event_id", "step")
    return J.drain_update(s, "last", ["run_id", "type"])


@query("merge_stream", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts,
    arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2 HAVING arg_max(value, (ts, event_id)) >= 10""")
def merge_stream(spark, sf):
    """Newest event of each user and type, merged into a table batch by batch; a small value takes the key out of the table."""
    place, s = J.new_place(spark, "merge"), stream(spark, sf).select("user_id", "event_type", "event_id", "ts", "value")
    J.merge_into(s, place + "/table", ["user_id", "event_type"], ["ts", "event_id"], place + "/state", F.col("value") < 10).awaitTermination()
    return M.merged(spark, place + "/table", s.schema)


@query("incremental_features", """SELECT sha256(text) AS sha, length(text) AS chars, len(string_split(text, ' ')) AS words, CASE WHEN bool_or(lang = 'en') THEN 1 ELSE 2 END AS run
    FROM documents WHERE text IS NOT NULL GROUP BY text""")
def incremental_features(spark, sf):
    """Features of each distinct text, computed in the first of two runs that meets it: the English documents, then all. Texts are known by their hash."""
    place, docs = J.new_place(spark, "features"), stream(spark, sf, "documents").where("text IS NOT NULL")
    for run, some in ((1, docs.where("lang = 'en'")), (2, docs)):
        measured = lambda d, run=run: d.select("sha", F.length("text").cast("long").alias("chars"), F.size(F.split("text", " ")).cast("long").alias("words"), F.lit(run).alias("run"))
        J.append_missing(some.select(F.sha2("text", 256).alias("sha"), "text"), place + "/table", ["sha"], measured, f"{place}/state{run}").awaitTermination()
    return J.features(spark, place + "/table", "sha string, chars long, words long, run int").drop("part")
