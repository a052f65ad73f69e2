import json
import math
import os
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.functions import pixels as PX
from tagloom.functions.vectors import euclidean, manhattan
from tagloom.operators import imports as I
from tagloom.operators import match as M
from tagloom.operators import score as SC
from tagloom.sources import export as X
from tagloom.sources import files as S
from tagloom.sources import projects as P_
from tagloom.streaming import jobs as J
from tagloom.streaming import trace as T


def png(path, a):
    """Minimal writer for an RGB array."""
    h, w, _ = a.shape
    raw = b"".join(b"\0" + a[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_listing_and_archives(spark, tmp_path):
    os.makedirs(tmp_path / "a" / ".hid")
    for name in ("a/x.PNG", "a/x.txt", "a/y.doc", "a/.hid/z.png"):
        (tmp_path / name).write_bytes(b"1")
    assert sorted(r.path for r in S.list_files(spark, str(tmp_path)).collect()) == ["a/x.PNG", "a/x.txt"]
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("../in/p.jpg", b"pic")
        z.writestr("__MACOSX/p.jpg", b"no")
    (tmp_path / "bad.zip").write_bytes(b"junk")
    got = sorted((os.path.basename(r.archive), r.path, r.error) for r in S.read_archives(spark, str(tmp_path / "*.zip")).collect())
    assert got == [("bad.zip", None, "corrupt archive"), ("g.zip", "../in/p.jpg", None)]


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 200, (54, 96, 3))
    marked = base.copy()
    marked[10:40, 20:60] = 255
    for name, a in (("one.png", base), ("two.png", base), ("mark.png", marked)):
        png(tmp_path / name, a)
    images = S.read_images(spark, str(tmp_path))
    fp = {os.path.basename(r.path): (r.lo, r.hi, tuple(r.sig)) for r in S.fingerprint(images).collect()}
    assert fp["one.png"] == fp["two.png"] != fp["mark.png"] and len(fp["one.png"][2]) == 3072
    regions = {os.path.basename(r.path): r for r in S.detect_regions(images).collect()}
    assert regions["one.png"].rects == []
    assert regions["mark.png"].rects == [[round(20 / 96, 3), round(10 / 54, 3), round(40 / 96, 3), round(30 / 54, 3)]]


def _plain(values, to, kind):
    """One line of bytes resampled by the definition, in whole numbers."""
    scale, out = len(values) / to, []
    wide = max(scale, 1.0)
    reach = (0.5 if kind == "box" else 3.0) * wide
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    kernel = (lambda x: float(-0.5 < x <= 0.5)) if kind == "box" else (lambda x: sinc(x) * sinc(x / 3) if -3 <= x < 3 else 0.0)
    for k in range(to):
        centre = (k + 0.5) * scale
        window = range(max(0, int(centre - reach + 0.5)), min(len(values), int(centre + reach + 0.5)))
        share = [kernel((x - centre + 0.5) / wide) for x in window]
        whole = [int(s / sum(share) * 4194304 + (0.5 if s >= 0 else -0.5)) for s in share]
        out.append(min(255, max(0, sum(w * int(values[x]) for w, x in zip(whole, window)) + 2097152 >> 22)))
    return out


@pytest.mark.parametrize("kind", ["box", "lanczos"])
@pytest.mark.parametrize("height, width", [(54, 96), (32, 32), (7, 131), (1, 1), (300, 33)])
def test_resampling_by_definition(kind, height, width):
    a = np.random.default_rng(height).integers(0, 256, (height, width)).astype(np.uint8)
    a[: height // 2] = np.where(a[: height // 2] > 127, 255, 0)  # overshoot is cut off
    across = np.array([_plain(line, 32, kind) for line in a])
    want = np.array([_plain(line, 32, kind) for line in across.T]).T
    for cells in (1 << 22, 200):
        assert (PX.resample(a, 32, 32, kind, cells) == want).all()
        assert (PX.resample(np.stack([a, a], 2), 32, 32, kind, cells)[:, :, 1] == want).all()
    if (height, width) == (32, 32):
        assert (want == a).all()


def test_fingerprint_bits(spark, tmp_path):
    """Bits and thumbnail of a picture from the definition, brightest and plain pictures included."""
    rng = np.random.default_rng(5)
    shown = {"noise.png": rng.integers(0, 256, (50, 80, 3)), "plain.png": np.full((9, 5, 3), 255), "ramp.png": np.add.outer(np.arange(64), np.arange(40))[:, :, None].repeat(3, 2)}
    for name, a in shown.items():
        png(tmp_path / name, a)
    fp = {os.path.basename(r.path): r for r in S.fingerprint(S.read_images(spark, str(tmp_path))).collect()}
    for name, a in shown.items():
        bright = [[int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 32768 >> 16 for r, g, b in line] for line in a]
        across = np.array([_plain(line, 32, "lanczos") for line in bright])
        small = np.array([_plain(line, 32, "lanczos") for line in across.T]).T.astype(float)
        c = np.array([[math.cos(math.pi * (2 * x + 1) * u / 64) * math.sqrt((1 if u else 0.5) / 16) for x in range(32)] for u in range(32)])
        low = (c @ small @ c.T)[:8, :8].ravel()
        if name == "noise.png":  # no ties with the median
            assert fp[name].hi << 32 | fp[name].lo == int("".join("1" if v > np.median(low) else "0" for v in low), 2)
        thumb = np.stack([np.array([_plain(line, 32, "box") for line in np.array([_plain(line, 32, "box") for line in a[:, :, k]]).T]).T for k in range(3)], 2)
        assert list(fp[name].sig) == thumb.ravel().tolist()


def test_largest_rect():
    rng = np.random.default_rng(4)
    for _ in range(60):
        g = rng.random((7, 9)) < 0.7
        best = max((h * w for y in range(7) for x in range(9) for h in range(1, 8 - y) for w in range(1, 10 - x) if g[y : y + h, x : x + w].all()), default=0)
        area, x, y, w, h = S.largest_rect(g)
        assert area == best == w * h and g[y : y + h, x : x + w].all()


def test_lossy(spark):
    webp = lambda *chunks: b"RIFF\0\0\0\0WEBP" + b"".join(t + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for t, d in chunks)
    rows = [(b"\xff\xd8\xff\xe0",), (webp((b"VP8X", b"abc"), (b"VP8L", b"z")),), (webp((b"ICCP", b"ab"), (b"VP8 ", b"z")),), (b"\x89PNG",)]
    assert [r[0] for r in spark.createDataFrame(rows, "c binary").select(S.is_lossy(F.col("c"))).collect()] == [True, False, True, False]


def test_dictionary_and_jsonl(spark, tmp_path):
    (tmp_path / "t.csv").write_text("tag_id,name,category,count\n1,general,9,5\n2,ann,4,3\n3,hat,0,2\n")
    assert [r.category for r in S.tag_dictionary(spark, str(tmp_path / "t.csv")).collect()] == ["rating", "character", "general"]
    df = spark.createDataFrame([("a", ".png", "hi é")], "stem string, ext string, caption string")
    X.write_jsonl(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"file_name": "a.png", "text": "hi é"}


def test_pack(spark):
    rows = [("r", f"{i // 2:03d}.{'png' if i % 2 else 'txt'}", 10) for i in range(100)] + [("big", f"{i}.png", 60_000_000) for i in range(4)]
    got = I.pack_batches(spark.createDataFrame(rows, "root string, path string, size long")).toPandas()
    r = got[got.root == "r"].groupby("batch")["files"].sum()
    assert list(r) == [40, 40, 20] and sorted(got[got.root == "big"]["batch"]) == [0, 0, 1, 1]


def plain_scores(d, role):
    """Median to the other references, and the smallest to a negative for the pool."""
    refs, negs, out = [i for i, r in enumerate(role) if r == "ref"], [i for i, r in enumerate(role) if r == "neg"], {}
    for i, r in enumerate(role):
        others = [d[i, j] for j in refs if j != i]
        if r != "neg":
            out[i] = (round(float(np.median(others)), 5) if others else None, round(float(min(d[i, j] for j in negs)), 5) if negs and r == "pool" else None)
    return out


def scored(df, **k):
    return {r.id: (r.score if r.score is None else round(r.score, 5), r.neg_score if r.neg_score is None else round(r.neg_score, 5)) for r in SC.ref_scores(df, euclidean, **k).collect()}


@pytest.mark.parametrize("refs, size, gather", [(7, 1024, 256), (7, 3, 256), (40, 8, 5), (41, 1024, 1), (1, 5, 0)])
def test_scores_in_blocks(spark, refs, size, gather):
    """One block or many; distances gathered at once, or the middle ranks found by counting first."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(refs + 33, 8)).astype(np.float32).astype(float)
    v[refs // 2 : refs] = v[0] if refs > 10 else v[refs // 2 : refs]  # a crowd of equal references
    role = ["ref"] * refs + ["neg"] * 3 + ["pool"] * 30
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "role": role, "embedding": [list(map(float, x)) for x in v]}), "id long, role string, embedding array<float>")
    assert scored(df, size=size, gather=gather) == plain_scores(np.linalg.norm(v[:, None] - v[None], axis=2), role)


def test_scores_of_many_references_and_awkward_rows(spark):
    """Held references and blocks of them agree; repeated ids share their distances, null vectors and null ids have no score."""
    rng = np.random.default_rng(3)
    rows = [(k, "ref" if k % 5 == 0 else "neg" if k % 7 == 1 else "pool", list(map(float, rng.normal(size=4)))) for k in range(300)]
    plain = spark.createDataFrame(rows, "id long, role string, embedding array<double>")
    assert scored(plain) == scored(plain, resident=0, size=16, gather=4) == scored(plain, resident=0)
    plan = SC.ref_scores(plain)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")  # no row for every record and range
    odd = spark.createDataFrame(rows + [rows[2], (None, "pool", [0.0] * 4), (999, "pool", None), (1000, "ref", None)], "id long, role string, embedding array<double>")
    got = scored(odd)
    assert got[999] == got[None] == (None, None) and got[2] == scored(plain)[2] and got[7] == scored(plain)[7]
    assert SC.ref_scores(odd, euclidean).where("id = 2").count() == 4


@pytest.mark.parametrize("refs", [2001, 2000, 3, 2, 1])
def test_near_rows_share_what_they_know_of_references(spark, tmp_path, refs):
    """Under a metric that keeps the triangle inequality most distances are not needed; scores are those of all of them, also where many are equal."""
    folder = str(tmp_path)

    def counting(rows, heads):
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(f"{len(rows) * len(heads)}\n")
        return manhattan(rows, heads)

    counting.triangle = True
    rng = np.random.default_rng(11)
    crowd = lambda n: rng.random((8, 3))[np.arange(n) % 8] + rng.random((n, 3)) / 10_000
    v = np.concatenate([crowd(refs), rng.random((60, 3)), crowd(2000), np.repeat(rng.integers(0, 3, (40, 3)) / 2, 5, axis=0)])
    role = ["ref"] * refs + ["neg"] * 60 + ["pool"] * 2200
    v[: refs // 4] = v[0]
    v[refs + 1] = v[refs]
    rows = pd.DataFrame({"id": range(len(v)), "role": role, "embedding": [list(map(float, x)) for x in v]})
    got = {r.id: (r.score, r.neg_score) for r in SC.ref_scores(spark.createDataFrame(rows, "id long, role string, embedding array<double>"), counting).collect()}
    for i, r in enumerate(role):
        d = sum(np.abs(v[: refs + 60, k] - v[i, k]) for k in range(3))
        others = np.delete(d[:refs], i) if r == "ref" else d[:refs]
        assert r == "neg" or got[i] == (float(np.median(others)) if len(others) else None, float(d[refs:].min()) if r == "pool" else None)
    asked = sum(int(x) for f in tmp_path.iterdir() for x in f.read_text().split())
    assert refs < 2000 or asked < len(v) * refs / 2


def test_near_rows_with_awkward_ids_and_numbers(spark):
    """Repeated ids share their distances; a null vector, a null id and numbers without end are scored as by a metric that promises nothing."""
    rng = np.random.default_rng(13)
    rows = [(k, "ref" if k % 9 == 0 else "neg" if k % 50 == 1 else "pool", [float(x) for x in rng.random(3)]) for k in range(1500)]
    rows += [rows[2], rows[9], (4, "pool", [9.0, 9.0, 9.0]), (9, "pool", [0.0, 0.0, 0.0]), (None, "pool", [0.0] * 3), (2000, "pool", None), (2001, "pool", [float("inf"), 0.0, 0.0]), (2002, "ref", None)]
    df = spark.createDataFrame(rows, "id long, role string, embedding array<double>").withColumn("more", F.col("id") + 1)
    read = lambda metric: sorted(map(repr, SC.ref_scores(df, metric, carry=("more",)).collect()))
    plain = lambda a, b: sum(np.abs(a[:, None, k] - b[None, :, k]) for k in range(a.shape[1]))
    got = read(manhattan)
    assert got == read(plain) and len(got) > 1400
    assert SC.ref_scores(df, manhattan).where("id = 2").count() == 4


def test_scores_of_odd_distances(spark):
    """Far apart by many orders of magnitude, endless, or no distance at all; string ids; no references."""
    d = {f"r{k}": x for k, x in enumerate([0.0, 1e-300, 1e-9, 1.0, 2.0, 1e300, 1.7e308, float("inf"), float("inf"), 3.0])}
    rows = [(k, "ref", [x]) for k, x in d.items()] + [("p", "pool", [0.0]), ("q", "pool", [float("nan")])]
    df = spark.createDataFrame(rows, "id string, role string, embedding array<double>")
    metric = lambda a, b: np.abs(b.T - a * 0)
    got = {r.id: r.score for r in SC.ref_scores(df, metric, size=4, gather=1).collect()}
    want = sorted(d.values())
    assert got["p"] == (want[4] + want[5]) / 2 and got["q"] is None
    for k, x in d.items():
        rest = sorted(y for j, y in d.items() if j != k)
        assert x == float("inf") or got[k] == rest[4]  # inf * 0 is no distance
    assert SC.ref_scores(df.where("role = 'pool'")).where("score is not null").count() == 0

def test_decisions(spark):
    s = M.Session(threshold=0.2, people_mode="crop", recover=0.1, include=["a"], exclude=["b"])
    rows = [(1, 0.2, None, None, None, ["a"]), (2, 0.2, 0.2, None, None, ["a"]), (3, 0.25, None, None, "found", ["a"]), (4, 0.1, None, -1, None, ["a"]),
            (5, 0.9, None, 1, None, ["b", "a"]), (6, 0.9, None, 2, None, None), (7, 0.1, None, None, None, None), (8, None, None, None, None, ["a"])]
    df = spark.createDataFrame(rows, "id int, score double, neg_score double, manual int, judge string, tags array<string>").withColumn("role", F.lit("pool")).withColumn("model", F.lit("default"))
    assert [r.id for r in M.matches(df, s).collect()] == [1, 3, 6]
    why = {r.id: r.block and (r.block.kind, r.block.tag) for r in M.decided(df, s).collect()}
    assert why[5] == ("excluded", "b") and why[7] == ("untagged", None) and why[1] is None


def test_trace_stream_drops_broken_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"run_id":1,"ts":"2024-01-01T00:00:00Z","type":"step","step":3}\n{broken\n{"run_id":1,"type":"phase","phase":"x"}\n{"run_id":2,"ty')
    rows = J.drain_append(T.read_trace(spark, str(tmp_path / "in")), "t").orderBy("type").collect()
    assert [(r.type, r.step) for r in rows] == [("phase", None), ("step", 3)]


def test_incremental_append(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for ids in ([1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(src)
        J.append_missing(spark.readStream.schema("id long").parquet(src), out, "id", lambda d: d.withColumn("f", F.col("id") * 2), state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_archives_are_read_in_stretches(spark, tmp_path):
    """Many members over several tasks, a member with broken bytes, and an archive of nothing."""
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(60):
            z.writestr(f"d{k % 3}/{k:03d}.txt", os.urandom(500) + bytes([k]))
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    data = bytearray((tmp_path / "many.zip").read_bytes())
    at = data.find(b"d1/007.txt") + len(b"d1/007.txt") + 20
    data[at] ^= 0xFF
    (tmp_path / "hurt.zip").write_bytes(bytes(data))
    for stretch in (S.RANGE, 2000):
        got = S.read_archives(spark, str(tmp_path / "*.zip"), stretch).withColumn("task", F.spark_partition_id()).collect()
        rows = {(os.path.basename(r.archive), r.path): (r.content, r.error) for r in got}
        assert len(rows) == len(got) == 120, [(k, v) for k, v in rows.items() if v[1]]
        assert rows["hurt.zip", "d1/007.txt"] == (None, "corrupt member")
        assert all(rows[a, f"d{k % 3}/{k:03d}.txt"][0][-1] == k for a in ("many.zip", "hurt.zip") for k in range(60) if (a, k) != ("hurt.zip", 7))
        assert len({r.task for r in got}) > (1 if stretch == 2000 else 0)


def test_caption_files(spark, tmp_path):
    rows = [(f"img/{k % 4}_x/{k:03d}.txt", f"caption {k} é") for k in range(200)] + [("top.txt", None)]
    df = spark.createDataFrame(rows, "caption_path string, caption string").withColumn("other", F.lit(1)).repartition(5)
    for _ in range(2):  # the same again changes nothing
        X.write_captions(df, str(tmp_path / "out"))
        found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
        assert found.pop("_SUCCESS") == "201"
        assert found == {p: (t or "") + "\n" for p, t in rows}
        assert not list((tmp_path / "out").glob("_staging*"))
    bad = df.withColumn("caption_path", F.when(F.col("caption_path") == "top.txt", F.lit("top.txt/below.txt")).otherwise(F.col("caption_path")))
    with pytest.raises(Exception):
        X.write_captions(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").glob("_staging*"))


def free_by_trying(rows, present):
    """Names by the rule: who asks first for a free number gets it, then the others take the next free numbers."""
    import re

    def asks(name):
        m = re.fullmatch(r"(.+) \(([1-9]\d*)\)(\.[^.]*)?", name)
        stem, ext = (m[1], m[3] or "") if m else os.path.splitext(name)
        return stem, ext, int(m[2]) if m else 1

    used, out = {(s.lower(), e.lower(), n) for s, e, n in map(asks, present)}, {}
    for k, name in rows:
        s, e, n = asks(name)
        if (s.lower(), e.lower(), n) not in used:
            used.add((s.lower(), e.lower(), n))
            out[k] = s + (f" ({n})" if n > 1 else "") + e
    for k, name in rows:
        if k not in out:
            s, e, _ = asks(name)
            n = next(n for n in range(1, 10_000) if (s.lower(), e.lower(), n) not in used)
            used.add((s.lower(), e.lower(), n))
            out[k] = s + (f" ({n})" if n > 1 else "") + e
    return out


def test_import_into_a_project_is_done_once(spark, tmp_path):
    import random

    draw = random.Random(4)
    names = ["a.png", "A.png", "a (2).png", "a (4).PNG", "b", "b (2)", "c.tar.gz", "a (1).png"]
    rows = [(k, draw.choice(names), draw.choice([None, f"h{draw.randint(0, 80)}"])) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, sha1 string").withColumn("more", F.lit(1))
    path = str(tmp_path / "project")
    schema = "id long, name string, sha1 string"
    present, added = [], set()
    for batch, part in (("one", rows[:40]), ("two", rows[40:]), ("one", rows[:40]), ("two", rows[40:])):  # the second round repeats the first
        plan = {r.id: (r.reason, r.given) for r in P_.to_project(df.where(F.col("id").isin([r[0] for r in part])), path, batch).collect()}
        held = P_.project(spark, path, schema).collect()
        if batch not in added:
            seen, fresh = {h for _, h in present}, []
            for k, name, h in part:
                if h is None or h not in seen:
                    fresh.append((k, name))
                    seen.add(h)
            want = free_by_trying(fresh, [n for n, _ in present])
            assert plan == {k: (None, want[k]) if k in want else ("duplicate", None) for k, _, _ in part}
            present += [(want[k], h) for k, _, h in part if k in want]
            added.add(batch)
        assert sorted((r.name, r.sha1 or "") for r in held) == sorted((n, h or "") for n, h in present)
    assert len({n.lower() for n, _ in present}) == len(present)
    (tmp_path / "project" / "batch=two" / "_SUCCESS").unlink()  # a batch that did not end does not count
    assert {r.batch for r in P_.project(spark, path, schema).collect()} == {"one"}
    twice = P_.to_project(df, path, "three", allow_duplicates=True)
    assert twice.where("reason IS NOT NULL").count() == 0 and P_.project(spark, path, schema).where("batch = 'three'").count() == 120
