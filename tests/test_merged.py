"""Tables that batches are merged into, against a dict."""
import os
import random

import pytest
from pyspark.sql import functions as F

from tagloom.sources import merged as M
from tagloom.streaming import jobs as J

SCHEMA = "k string, at long, v long"


def rows(spark, path):
    return sorted(((r.k, r.at, r.v) for r in M.merged(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()), key=repr)


def test_batches_against_a_dict(spark, tmp_path):
    """Older rows lose, equal ones go to the later batch, gone keys leave and come back, null keys count, one key is hot."""
    draw, path, held = random.Random(3), str(tmp_path / "t"), {}
    for batch in range(6):
        given = [(draw.choice(["hot", None, *map(str, range(30))]), draw.randint(0, 9), draw.randint(-2, 8)) for _ in range(60)]
        given = list({(k, at): (k, at, v) for k, at, v in given}.values())  # no ties inside a batch
        assert M.merge(spark.createDataFrame(given, SCHEMA), path, ["k"], ["at"], batch, gone=F.col("v") < 0, buckets=5)
        for k, at, v in sorted(given, key=lambda r: r[1]):
            if k not in held or held[k][0] <= at:
                held[k] = (at, v)
        held = {k: r for k, r in held.items() if r[1] >= 0}
        assert rows(spark, path) == sorted(((k, *r) for k, r in held.items()), key=repr)
    assert M.version(spark, path).number == 5
    M.tidy(spark, path, keep=1)
    assert rows(spark, path) == sorted(((k, *r) for k, r in held.items()), key=repr)
    assert set(os.listdir(tmp_path / "t" / "data")) == set(M.version(spark, path).parts.values())


def test_repeated_batch_and_other_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([("a", 1, v)], SCHEMA) for v in (1, 2))
    assert M.merge(one, path, ["k"], ["at"], 0, "x") and M.merge(two, path, ["k"], ["at"], 0, "y")
    assert not M.merge(one, path, ["k"], ["at"], 0, "x")
    assert rows(spark, path) == [("a", 1, 2)] and M.version(spark, path).batches == {"x": 0, "y": 0}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    M.merge(spark.createDataFrame([(str(k), 1, k) for k in range(200)], SCHEMA), path, ["k"], ["at"], 0, buckets=16)
    before = M.version(spark, path).parts
    M.merge(spark.createDataFrame([("7", 2, 70)], SCHEMA), path, ["k"], ["at"], 1, buckets=99)
    after = M.version(spark, path)
    assert after.buckets == 16 and sum(before[k] != after.parts[k] for k in before) == 1
    assert len(rows(spark, path)) == 200 and ("7", 2, 70) in rows(spark, path)


def test_two_writers_of_one_version(spark, tmp_path):
    """The second of two that plan the same version fails, and the first one's rows stay."""
    path = str(tmp_path / "t")
    M.merge(spark.createDataFrame([("a", 1, 1)], SCHEMA), path, ["k"], ["at"], 0, "x")
    with pytest.raises(Exception, match="exist"):
        M._commit(spark, path, M.Version(0, 1))
    assert rows(spark, path) == [("a", 1, 1)]


def test_empty_batches_and_tables(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], SCHEMA)
    assert rows(spark, path) == []
    assert M.merge(none, path, ["k"], ["at"], 0) and rows(spark, path) == []
    some = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA)
    assert M.missing(some, path, ["k"], some.schema).count() == 2
    M.merge(some.limit(1), path, ["k"], ["at"], 1)
    assert [r.k for r in M.missing(some, path, ["k"], some.schema).collect()] == ["b"]


def test_one_shuffle_of_old_rows(spark, tmp_path):
    """Rows that meet by bucket are not shuffled again by key."""
    both = spark.createDataFrame([("a", 1, 1, 0, 1)], SCHEMA + ", _new int, _bucket int").repartition(8, "_bucket")
    plan = M.latest(both, ["_bucket", "k"], ["at", "_new"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_stream_in_many_batches(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([("a", k, k), (f"n{k}", 0, k)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    def run():
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        J.merge_into(s, str(tmp_path / "t"), ["k"], ["at"], str(tmp_path / "state"), buckets=4).awaitTermination()
    run()
    run()
    assert rows(spark, str(tmp_path / "t")) == [("a", 3, 3)] + [(f"n{k}", 0, k) for k in range(4)]
    assert M.version(spark, str(tmp_path / "t")).number >= 3
