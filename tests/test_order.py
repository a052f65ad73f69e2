import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import names as NM
from tagloom.operators import order as O


@pytest.mark.parametrize("parts", [1, 8, 32])
def test_positions_with_a_hot_group(spark, parts):
    df = spark.range(3000).repartition(parts).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 3001).alias("o"))
    got = O.positions(df, ["g"], ["o"]).toPandas()
    want = got.sort_values(["g", "o"]).groupby("g").cumcount() + 1
    assert (got.sort_values(["g", "o"])["pos"].to_numpy() == want.to_numpy()).all()
    n = O.number_rows(df.select("o"), ["o"]).toPandas().sort_values("o")["n"]
    assert list(n) == list(range(1, 3001))


def test_evenly_spaced(spark):
    pick = lambda n, k: [r["id"] for r in O.evenly_spaced(spark.range(n), ["id"], k).orderBy("pick").collect()]
    assert pick(10, 3) == [0, 5, 9] and pick(2, 3) == [0, 1] and pick(1, 3) == [0] and pick(0, 3) == []


def sequential(names):
    used, out = set(), []
    for base in names:
        stem, k = base, 2
        while stem.lower() in used:
            stem, k = f"{base}_{k}", k + 1
        used.add(stem.lower())
        out.append(stem)
    return out


def stems(spark, lists):
    pdf = pd.DataFrame([(g, i, n) for g, names in lists.items() for i, n in enumerate(names)], columns=["g0", "at", "base"])
    got = NM.unique_stems(spark.createDataFrame(pdf), "g0", "at").toPandas().sort_values(["g0", "at"])
    return {g: list(p["stem"]) for g, p in got.groupby("g0")}


def test_stems_match_the_sequential_rule(spark):
    import random

    rnd = random.Random(5)
    pool = ["a", "A", "a_2", "a_3", "a_2_2", "a_4", "b", "b_2", "a_02", "img_0001", "a_2_3", "A_2", "c_1", "c", "a_3_2"]
    lists = {f"p{i}": [rnd.choice(pool[: rnd.randint(2, len(pool))]) for _ in range(rnd.randint(1, 40))] for i in range(60)}
    lists["known"] = ["a", "a", "a_2"]
    lists["hot"] = ["x"] * 500 + ["x_7", "x_600", "x_20_2", "x_20"] + ["x"] * 200
    got = stems(spark, lists)
    assert got["known"] == ["a", "a_2", "a_2_2"]
    for g, names in lists.items():
        assert got[g] == sequential(names), g


def test_unique_names(spark):
    df = spark.createDataFrame([(0, "x.png"), (1, "X.PNG"), (2, "noext"), (3, "noext"), (4, "x.png")], "id int, name string")
    got = [r["unique"] for r in NM.unique_names(df, [], ["id"]).orderBy("id").collect()]
    assert got == ["x.png", "X (2).PNG", "noext", "noext (2)", "x (3).png"]


def test_first_of_a_group_that_crosses_partitions(spark):
    df = spark.range(1000).repartition(16).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("g"), "id")
    assert all(r["first"] == (0 if r["id"] < 900 else r["id"]) for r in O.positions(df, ["g"], ["id"], first="id").collect())
