import random

from pyspark.sql import functions as F

from tagloom.plans import views


def test_large_tables_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    """A task of a large table gets about ROWS rows whatever the session's number of shuffle partitions; the rows stay the same."""
    rnd = random.Random(4)
    parts = [(k, f"red ring {k % 7}", "PROMO" if k % 3 else "LARGE") for k in range(30)] + [(None, "x y", "PROMO")]
    lines = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(33)]), rnd.randrange(5), rnd.randrange(9), float(rnd.randrange(1, 50)), 100.0 * k) for k in range(900)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    schema = "l_orderkey long, l_partkey long, l_linenumber long, l_suppkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = str(tmp_path)
    plain = [sorted(map(repr, view(spark, sf).collect())) for view in (views.tag_scores, views.detections)]
    monkeypatch.setattr(views, "ROWS", 20)
    for view, want in zip((views.tag_scores, views.detections), plain):
        rows = view(spark, sf)
        assert sorted(map(repr, rows.collect())) == want and want
        assert rows.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0] <= 120
        assert rows.rdd.getNumPartitions() == 45  # one shuffle serves the counts by tag and those by record
