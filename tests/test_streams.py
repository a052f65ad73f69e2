"""Stream queries over tables that are folders of part files, and what else lost rows silently."""
import duckdb
import pytest

import __spark_entry__ as entry
from tagloom.operators import captions as K
from tagloom.operators import grids as G
from tagloom.operators import names as NM
from tagloom.operators import runs as U
from tagloom.sources import files as S
from tagloom.streaming import jobs as J
from tagloom.streaming import trace as T
from tagloom.streaming import ttl
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    where = tmp_path_factory.mktemp("parts")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{where}/events.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["events_tumbling", "events_sliding", "events_session", "stream_dedup", "trace_last_stream", "cache_sights", "silent_runs", "merge_stream"])
def test_folder_of_part_files(spark, parts, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{parts}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, parts).toPandas()
    key = sorted(want.columns)
    assert len(got) == len(want) > 0
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, want[key].values.tolist()))


def test_undecodable_image_keeps_its_row(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no picture")
    images = S.read_images(spark, str(tmp_path))
    assert [r.error for r in images.collect()] == ["cannot be decoded"]
    assert [r.sig for r in S.fingerprint(images).collect()] == [None] and [r.rects for r in S.detect_regions(images).collect()] == [None]


def test_wide_and_tall_rectangles(spark):
    cells = [("wide", x, 0) for x in range(5, 30)] + [("tall", 0, y) for y in range(40)] + [("gap", x, 0) for x in (1, 2, 3, 9)]
    area = {r.grid: r.area for r in G.largest_area(G.run_heights(spark.createDataFrame(cells, "grid string, x int, y int"))).collect()}
    assert area == {"wide": 25, "tall": 40, "gap": 3}


def test_long_literal_slots(spark):
    rows = [(1, "g", "x"), (2, "g", "x_1234567890"), (3, "g", "x"), (4, "g", "x_99999999999999999999999"), (5, "g", "x_2")]
    got = {r.id: r.stem for r in NM.unique_stems(spark.createDataFrame(rows, "id long, g string, base string"), "g", "id").collect()}
    assert got[1] == "x" and got[2] == "x_1234567890" and got[4] == "x_99999999999999999999999" and len({v.lower() for v in got.values()}) == 5


def test_only_credits_are_refunds(spark):
    runs = spark.createDataFrame([(1, 10.0, 8.0), (2, 10.0, 10.0), (3, 10.0, None)], "run_id long, quoted double, total double")
    paid = spark.createDataFrame([(1, "debit", 100), (1, "tip", 30), (2, "debit", 50), (2, "credit", 20)], "run_id long, type string, cents long")
    got = {r.run_id: (r.charged, r.refunded, r.cost_full) for r in U.costs(runs, paid).collect()}
    assert got == {1: (100, None, 10), 2: (30, 20, None), 3: (None, None, None)}


def test_last_score_of_a_name_counts(spark):
    df = spark.sql("SELECT array('aa bb', 'cc', 'AA BB') AS tags, array(named_struct('name', 'aa_bb', 'score', 0.9D), named_struct('name', 'aa bb', 'score', 0.1D)) AS general")
    rows = df.select(F.explode(K._scored(F.col("tags"), F.col("general"))).alias("x")).select("x.t", "x.score").collect()
    assert sorted((r.t, r.score) for r in rows) == [("AA BB", 0.1), ("aa bb", 0.1), ("cc", None)]


def test_scores_of_many_and_repeated_tags(spark):
    """Twenty thousand tags in one record, a third of them one tag, within seconds."""
    import random
    import time

    draw = random.Random(1)
    tags = [draw.choice(["hot tag", "HOT_TAG", f"t{draw.randint(0, 9000)}", f"u{k}"]) for k in range(20_000)]
    general = [(f"t{k}", k / 9000) for k in range(9000)] + [("hot_tag", 0.2), ("hot tag", 0.7), ("t1", None), ("t2", 0.9)]
    df = spark.createDataFrame([(tags, general), (["a"], None), ([], [("a", 0.5)])], "tags array<string>, general array<struct<name:string,score:double>>")
    start = time.time()
    got = [r.x for r in df.select(K._scored(F.col("tags"), F.col("general")).alias("x")).collect()]
    assert time.time() - start < 60
    known = {n.replace("_", " "): s for n, s in general}
    assert {(x.i, x.t, x.score) for x in got[0]} == {(k, t, known.get(t.lower().replace("_", " "))) for k, t in enumerate(tags)}
    assert [(x.t, x.score) for x in got[1]] == [("a", None)] and got[2] == []


def test_append_missing_computes_each_id_once(spark, tmp_path):
    """Two streams into one target: ids that are there are not computed, failed ones again, unfinished batches do not count."""
    target, seen = str(tmp_path / "out"), []

    def compute(d):
        seen.append(sorted(r.id for r in d.collect()))
        return d.withColumn("twice", F.col("id") * 2).withColumn("error", F.when(F.col("id") % 10 == 3, "unreadable"))

    spark.range(20).union(spark.range(5)).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        J.append_missing(stream, target, ["id"], compute, str(tmp_path / f"state{k}"), buckets=4).awaitTermination()
    assert seen == [list(range(20)), [3, 13]]
    (tmp_path / "out" / "part=feed-0").mkdir()
    rows = J.features(spark, target, "id long, twice long")
    assert sorted((r.id, r.twice) for r in rows.collect()) == [(k, 2 * k) for k in range(20) if k % 10 != 3]
    assert J.features(spark, str(tmp_path / "none"), "id long").count() == 0


def test_append_missing_after_a_failure(spark, tmp_path):
    """The first try writes its features but not its keys; the second gives each row once."""
    from tagloom.sources import merged as M

    spark.range(20).write.parquet(str(tmp_path / "in"))
    target, state, commit = str(tmp_path / "out"), str(tmp_path / "state"), M._commit

    def run():
        J.append_missing(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), target, ["id"], lambda d: d.withColumn("x", F.lit(1)), state).awaitTermination()

    with pytest.MonkeyPatch.context() as m, pytest.raises(Exception):
        m.setattr(M, "_commit", lambda *a: 1 / 0)
        run()
    assert J.features(spark, target, "id long, x int").count() == 0 and M._commit is commit
    run()
    run()
    assert sorted(r.id for r in J.features(spark, target, "id long, x int").collect()) == list(range(20))


def arrivals(spark, folder, batches, schema):
    """One file, and so one micro-batch, for each list of rows; days since 2024 become times."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400)).drop("day")
        df.coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(folder))


def days(at):
    return (at - __import__("datetime").datetime(2024, 1, 1)).total_seconds() / 86400


def test_cached_keys_expire(spark, tmp_path):
    """A key is a hit within 25 days and a miss after; when the watermark has passed, its state is gone."""
    batches = [[("k", 0.0, 1), ("j", 0.5, 9), ("k", 0.25, 7)], [("k", 24.0, 2)], [("k", 25.0, 3)], [("z", 60.0, 4)], [("z", 61.0, 5)]]
    progress = []
    with J.timed_state(spark):
        s = ttl.cached(arrivals(spark, tmp_path / "in", batches, "key string, day double, value long"))
        rows = J.drain_update(s, "ttl", ["key", "ts"], progress).where("ts is not null").collect()
    assert sorted((r.key, days(r.ts), r.value, r.hit) for r in rows) == [
        ("j", 0.5, 9, False), ("k", 0.0, 1, False), ("k", 0.25, 1, True), ("k", 24.0, 1, True), ("k", 25.0, 3, False), ("z", 60.0, 4, False), ("z", 61.0, 4, True)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in progress if p["stateOperators"])
    assert max(held) > held[-1] and removed > 0  # k and j went, z is left


def test_timers_report_silent_runs(spark, tmp_path):
    """Run 1 falls silent, run 2 comes back, run 3 has ended, run 4 keeps the watermark going."""
    batches = [[(1, 0.0, False), (2, 0.0, False), (3, 0.0, False), (3, 0.5, True)], [(4, 4.0, False)], [(4, 4.5, False)], [(4, 5.0, False), (2, 4.9, False)], [(4, 6.0, False)]]
    with J.timed_state(spark):
        s = ttl.silent(arrivals(spark, tmp_path / "in", batches, "run_id long, day double, ended boolean"), 3 * 86400)
        told = J.drain_append(s, "silent", "update").collect()
    told = sorted((r.run_id, days(r.updated_at), r.stale) for r in told)
    assert told == [(1, 0.0, False), (1, 0.0, True), (2, 0.0, False), (2, 0.0, True), (2, 4.9, False), (3, 0.5, False), (4, 4.0, False), (4, 4.5, False), (4, 5.0, False), (4, 6.0, False)]


def test_sessions_close_by_watermark_and_at_the_end(spark, tmp_path):
    batches = [[(1, 0.0, 5), (1, 0.05, 5)], [(2, 1.0, 1)], [(2, 1.05, 1), (1, 1.06, 2)]]
    events = arrivals(spark, tmp_path / "in", batches, "user_id long, day double, cents long")

    def closed(e):
        return T.windowed(e, "1 hour", F.session_window("ts", "2 hours"), ["user_id"]).select("user_id", "w.start", "n", "cents")

    rows = J.drain_closed(events, closed, "sessions").collect()
    assert sorted((r.user_id, days(r.start), r.n, r.cents) for r in rows) == [(1, 0.0, 2, 10), (1, 1.06, 1, 2), (2, 1.0, 2, 2)]


def test_streams_without_input(spark, tmp_path):
    spark.createDataFrame([], "run_id long, ts timestamp, ended boolean").write.parquet(str(tmp_path / "none"))
    empty = spark.readStream.schema("run_id long, ts timestamp, ended boolean").parquet(str(tmp_path / "none"))
    with J.timed_state(spark):
        assert J.drain_update(ttl.silent(empty, 60), "none", ["run_id"]).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ttl.ROCKS
    counted = lambda e: T.windowed(e.select("run_id", "ts", F.lit(1).alias("cents")), "1 hour", F.session_window("ts", "2 hours"), ["run_id"]).select("run_id", "n")
    assert J.drain_closed(empty, counted, "none").count() == 0
