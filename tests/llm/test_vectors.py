"""Links and components of vectors against all pairs."""
import numpy as np
import pytest

from tagloom.llm import vectors
from tagloom.llm.queries import LLM_ORACLES, LLM_QUERIES


def unit(v):
    if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    x = np.array(v, dtype=float) / max(abs(x) for x in v)
    return x / np.sqrt(x @ x)


def all_pairs(rows, threshold=0.95):
    """(vec_id, links, smallest reachable id) of every row, sorted."""
    known = [(i, None if i is None else unit(v)) for i, v in rows]
    link = [[b for b, (_, y) in enumerate(known) if b != a and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold]
            for a, (_, x) in enumerate(known)]
    out = []
    for a in range(len(known)):
        seen, todo = {a}, [a]
        while todo:
            fresh = set(link[todo.pop()]) - seen
            seen |= fresh
            todo += fresh
        ids = [known[b][0] for b in seen if known[b][0] is not None]
        out.append((known[a][0], len(link[a]), min(ids) if ids else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id").collect()), key=repr)


def drawn(kind):
    rng = np.random.default_rng(1)
    centres, rows = rng.normal(size=(60, 12)), []
    for i in range(400):
        v = centres[i % 60] + rng.normal(size=12) * 0.12
        rows.append((i, [float(np.float32(x)) for x in v * (1 + i % 3)]))
    odd = [(400, rows[3][1]), (401, rows[3][1]), (402, None), (403, []), (404, [0.0] * 12), (405, [1.0, None] + [1.0] * 10), (406, [float("nan")] + [1.0] * 11),
           (407, [1.0, 2.0]), (408, [2.0, 4.0]), (409, [float("inf")] * 12), (None, rows[3][1]), (407, [5.0, -1.0]), (408, [1.0, 2.0]), (408, [1.0, 2.0])]
    if kind == "double":  # squares of these overflow or vanish
        odd += [(410, [1e200] * 12), (411, [-1e-200] * 12), (412, [3e200] * 12), (413, [4e-320] * 12)]
    return rows + odd


@pytest.mark.parametrize("kind, tile", [("float", 8192), ("double", 40)])
def test_links_of_all_pairs(spark, kind, tile):
    rows = drawn(kind)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, h int, cell string").repartition(5)
    assert rows_of(vectors.near_vectors(df, tile=tile)) == all_pairs(rows)


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in (centre + rng.normal(size=16) * 0.05 if i % 3 == 0 else rng.normal(size=16))]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(vectors.near_vectors(df, tile=64)) == all_pairs(rows)


def test_wide_short_and_empty(spark):
    rng = np.random.default_rng(3)
    wide = [(i, [float(x) for x in rng.normal(size=600) * np.arange(1, 601) * (1 if i % 2 else 0.1)]) for i in range(6)]
    wide += [(9, wide[0][1][:-1] + [0.5])]
    short = [(i, [float(x)]) for i, x in enumerate([1, -2, 3, 0.5, -0.1])]
    for rows in (wide, short, []):
        assert rows_of(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == all_pairs(rows)


def test_tiles_far_apart_do_not_meet():
    """Boxes of distant cells exclude each other, so the pairs of tiles stay far below all of them."""
    import pandas as pd

    k = vectors.AXES + 1
    at = np.repeat(np.linspace(-1, 1, 40)[:, None], k, axis=1) / 3
    sides = {f"{name}{j}": at[:, j] + d for name, d in (("lo", -0.01), ("hi", 0.01)) for j in range(k)}
    boxes = pd.DataFrame({"cell": np.arange(40), "n": 10_000} | sides)
    pairs = sum(len(m) for _, _, m in vectors._meetings(boxes, 8192, 0.95))
    assert 40 <= pairs < 40 * 41 / 2 / 2


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, LLM_QUERIES["op12_vectors"](spark, sf).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == sorted(con.execute(LLM_ORACLES["op12_vectors"]).fetchall())
