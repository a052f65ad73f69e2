"""Spelling variants against all pairs of words."""
import random
import re
import zlib
from collections import Counter

import pytest

from tagloom.llm import spelling
from tagloom.llm.queries import LLM_QUERIES


def plain_words(rows, typos=None):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    """By definition: some code point of one taken out, or both the same but for one place."""
    if abs(len(a) - len(b)) == 1:
        short, long = sorted((a, b), key=len)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def drawn(seed, letters="abcé", count=400):
    draw = random.Random(seed)
    words = set()
    while len(words) < count:
        w = "".join(draw.choice(letters) for _ in range(draw.randint(5, 8)))
        k = draw.randrange(len(w))
        words |= {w, w[:k] + w[k + 1 :] + "x" * 2, w[:k] + draw.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :] + "z"}
    return {w: draw.choice([3, 4, 6, 12, 24, 50]) for w in words if len(w) >= 5}


@pytest.mark.parametrize("seat", [32768, 20])
def test_variants_of_all_pairs(spark, seat):
    n = drawn(1)
    n |= {"a" * 40: 3, "a" * 41: 9, "a" * 39 + "b": 4, "a" * 33: 3, "a" * 32: 3}  # beyond the largest counted letter
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert got(spelling.variants(df, seat)) == plain_variants(n)


def test_hot_leaf(spark):
    """Words of one vector of letter groups, more than a tile holds."""
    letters = "aiqyáéíñù"  # code points that leave 1 modulo 8, and others
    n = drawn(2, "aiqy", 300) | drawn(3, letters, 100)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.variants(df, 16)) == plain_variants(n)


@pytest.mark.parametrize("typos", [None, 3])
def test_counted_words(spark, typos):
    rows = [(1, "Apple apple APPLE éAPPLE Éapple"), (2, None), (3, ""), (None, "Apple apples, apples ünder"), (4, "x" * 100_000 + " grüße Grüße GRÜßE grüße"),
            (5, "日本apple語apple Ωmega ×mega÷ mega×mega ǅapple applé apple_apple 1apple2"), (6, "Kelvin Kelvin kelvin kelvin ſtreet street street street")]
    rows += [(k, "Apple orange orange banana") for k in range(7, 40)] * 2
    df = spark.createDataFrame([(a, b, "w", 3) for a, b in rows], "doc_id long, text string, word string, n int")
    assert dict(map(tuple, spelling.counted(df, typos).collect())) == plain_words(rows, typos)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.counted(docs, 97)).count() == 0
    assert got(spelling.variants(spark.createDataFrame([("lonely", 3)], "word string, n long"))) == [("lonely", None, "lonely", 3, 0, None)]


def test_search_finds_each_pair_once():
    draw = random.Random(4)
    vs = {bytes(draw.randint(0, 2) for _ in range(spelling.GROUPS)) for _ in range(3000)}
    children = {}
    for v in vs:
        for depth in range(spelling.GROUPS):
            children.setdefault(v[:depth], set()).add(v[depth])
    found = {(v, u) for v in list(vs)[:200] for u in spelling.within(v, children)}
    for v in list(vs)[:200]:
        for u in vs:
            more, less = sum(max(0, b - a) for a, b in zip(v, u)), sum(max(0, a - b) for a, b in zip(v, u))
            if v != u and more <= 1 and less <= 1:
                assert ((v, u) in found) != (v in spelling.within(u, children))
            elif v != u:
                assert (v, u) not in found


def test_query_equals_all_pairs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_words(docs, 97)
    found = got(LLM_QUERIES["op11_spelling"](spark, sf))
    assert {r[0]: r[3] for r in found} == want
    cut = {}  # near words by what is left when one place is blanked or taken out
    for w in want:
        for k in range(len(w)):
            cut.setdefault(w[:k] + "\0" + w[k + 1 :], set()).add(w)
            cut.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        cut.setdefault(w, set()).add(w)
    near = {w: {v for k in range(len(w)) for x in (w[:k] + "\0" + w[k + 1 :], w[:k] + w[k + 1 :]) for v in cut[x] if one_edit(w, v)} | {v for v in cut[w] if one_edit(w, v)} for w in want}
    assert {r[0]: r[4] for r in found} == {w: len(v) for w, v in near.items()}
