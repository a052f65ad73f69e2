import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from tagloom import settings as C
from tagloom.functions import replies as R
from tagloom.functions import tags as T
from tagloom.operators import captions as K
from tagloom.operators import edits as E
from tagloom.operators import imports as I
from tagloom.operators import policy as P
from tagloom.operators import select as S


def one(spark, c, **cols):
    df = spark.range(1).select(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [
    (r"tokai_teio_\(umamusume\)", "tokai teio (umamusume)"), ("^_^", "^_^"), ("score_8_up", "score_8_up"), ("rating_safe", "rating_safe"),
    ("  a__b  c ", "a b c"), ("Score_9", "Score_9"), ("plain", "plain"), ("||_||", "||_||"), ("source_x y", "source x y"), ("a\tb", "a b"), ("_", "")])
def test_canon(spark, raw, want):
    assert one(spark, T.canon(F.lit(raw))) == want == T.canon_text(raw)
    assert one(spark, T.canon(F.lit(want))) == want


def test_split_and_format(spark):
    assert one(spark, T.split_tags(F.lit("a_b, A b,\nc ,, ^_^"))) == ["a b", "c", "^_^"] == T.split_text("a_b, A b,\nc ,, ^_^")
    assert one(spark, T.format_tag(F.lit("a (b)"), False, True)) == r"a_\(b\)" == T.format_text("a (b)", False, True)
    assert one(spark, T.format_tag(F.lit("score_9"), False, False)) == "score_9"


def test_globs(spark):
    hit = lambda tag, *p: one(spark, T.matches_globs(F.lit(tag), p))
    assert hit("Red_Hair", "red*") and hit("abc", "a[!x]c") and not hit("axc", "a[!x]c") and hit("a.c", "a.c") and not hit("abc", "a.c") and hit("abc", "?bc")


@pytest.mark.parametrize("tag,group,want", [("light_brown hair", "hair_color", True), ("brown hair ribbon", "hair_color", False),
                                            ("photo_(medium)", "style_medium", True), ("1990s (style)", "style_medium", True), ("horns", "body", True)])
def test_prune_groups(spark, tag, group, want):
    assert one(spark, T.matches_groups(F.lit(tag), [group], C.PRUNE_GROUPS)) is want


def test_policy(spark):
    flag = lambda tags, rating=None, nl="": one(spark, P.policy_flag(F.array(*[F.lit(t) for t in tags]), F.lit(rating).cast("string"), F.lit(nl)))
    assert flag(["baby", "smile"]) is None and flag(["smile"], "explicit") is None
    assert flag(["Child", "baby"], "questionable") == "baby, child"
    assert flag(["baby"], "general", "a nude statue") == "baby" and flag(["baby"], None, "denuded hills") is None
    assert flag(["aged_down", "nsfw"]) == "aged down"


def cap(spark, tags, nl="", rating=None, names=(), extra=(), **s):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    profile = s.pop("profile", "illustrious")
    return one(spark, K.build_caption(arr(tags), F.lit(nl), F.lit(rating).cast("string"), arr(names), arr(extra), C.defaults_for(profile, **s)))


def test_captions(spark):
    tags = ["1girl", "solo", "long hair", "school uniform"]
    assert cap(spark, tags, trigger="mychar") == "mychar, 1girl, solo, long hair, school uniform"
    assert cap(spark, tags, rating="general", profile="pony_v6", trigger="mychar") == "mychar, source_anime, rating_safe, 1girl, solo, long hair, school uniform"
    assert cap(spark, tags, rating="general", profile="noobai_xl", trigger="mychar") == "mychar, 1girl, solo, general, long hair, school uniform"
    assert cap(spark, ["1girl", "ann", "hat"], rating="general", names=["Ann"], profile="animagine_xl") == "1girl, ann, safe, hat"
    assert cap(spark, tags, "A  MyChar smiles. ", profile="flux1_dev", trigger="mychar") == "mychar, A mychar smiles."
    assert cap(spark, tags, "MYCHAR smiles.", profile="flux1_dev", trigger="mychar") == "mychar smiles."
    assert cap(spark, ["hat"], "a photo.", profile="sdxl_base", trigger="x") == "x, a photo, hat"
    assert cap(spark, ["hat"], "", caption_mode="trigger_only") == "hat"
    assert cap(spark, ["Hat"], "", append_tags="hat, new") == "Hat, new"
    assert cap(spark, ["a (b)"], escape_parentheses=True, underscore_to_space=False) == r"a_\(b\)"
    assert cap(spark, [], "cost $5 for mychar", profile="flux1_dev", trigger="$1") == "$1, cost $5 for mychar"


def test_hints(spark):
    h = lambda p, **s: K.training_hints(C.defaults_for(p, **s))
    assert h("pony_v6", trigger="x") == {"shuffle_caption": True, "keep_tokens": 3}
    assert h("anima", trigger="x") == h("flux1_dev") == {"shuffle_caption": False, "keep_tokens": 0}
    assert h("sdxl_base", add_quality_tags=True, quality_tags="a, b") == {"shuffle_caption": True, "keep_tokens": 3}


def test_select_tags(spark):
    raw = F.expr("""struct(array(struct('blue_hair' as name, 0.9D as score), struct('smile' as name, 0.5D as score), struct('1girl' as name, 0.4D as score), struct('low' as name, 0.1D as score)) as general,
        array(struct('ann_(x)' as name, 0.9D as score)) as character, struct(array('Ann (x)') as character, array('show') as copyright, array('bob') as artist, array('hat', 'Smile') as general) as vlm)""")
    sel = lambda **s: one(spark, S.select_tags(raw, C.defaults_for("anima", **s)))
    assert sel() == ["1girl", "ann (x)", "smile"]
    assert sel(vlm_tags="merge", vlm_artist_tags=True) == ["1girl", "ann (x)", "show", "@bob", "smile", "hat"]
    assert sel(vlm_tags="only", trigger="hat") == ["Ann (x)", "show", "Smile"]
    assert sel(max_tags=2, prune_groups=[]) == ["1girl", "ann (x)"]


def sequential_fit(spark, rows, s, limit):
    """Remove one tag at a time and rebuild, as the rule is written."""
    out = {}
    df_rows = [(i, r["tags"], r["nl"], r["rating"]) for i, r in rows.items()]
    build = lambda frame: {r.id: r.c for r in spark.createDataFrame(frame, "id int, tags array<string>, nl string, rating string").select(
        "id", K.build_caption(F.col("tags"), F.col("nl"), F.col("rating"), F.array().cast("array<string>"), F.array().cast("array<string>"), s).alias("c")).collect()}
    first = build(df_rows)
    trial, plan = [], {}
    for i, r in rows.items():
        if len(first[i]) <= limit:
            out[i] = (first[i], 0)
            continue
        keep = {T.canon_text(k).lower() for k in T.split_text(s["block_tag"])}
        score = {T.canon_text(n).lower(): v for n, v in r["general"]}
        order = sorted((k for k in range(len(r["tags"])) if r["tags"][k].lower() not in keep),
                       key=lambda k: (r["tags"][k].lower() not in score, score.get(r["tags"][k].lower(), 0), -k))
        plan[i] = order
        for n in range(1, len(order) + 1):
            trial.append((i * 1000 + n, [t for k, t in enumerate(r["tags"]) if k not in order[:n]], r["nl"], r["rating"]))
    built = build(trial) if trial else {}
    for i, order in plan.items():
        n = next((n for n in range(1, len(order) + 1) if len(built[i * 1000 + n]) <= limit), None)
        if n:
            out[i] = (built[i * 1000 + n], n)
        else:
            text = (built[i * 1000 + len(order)] if order else first[i])[:limit]
            out[i] = (text[: text.rfind(",")] if "," in text else text, len(order))
    return out


@pytest.mark.parametrize("profile,mode", [("noobai_xl", "tags"), ("sdxl_base", "hybrid"), ("flux1_dev", "natural")])
def test_fit_removes_as_the_rule_says(spark, profile, mode):
    rnd = random.Random(9)
    words = [f"w{i}" * (1 + i % 4) for i in range(30)] + ["white rectangle", "general", "Trig"]
    rows = {}
    for i in range(40):
        tags = rnd.sample(words, rnd.randint(0, 20))
        rows[i] = {"tags": tags, "nl": " ".join(rnd.choices(["red", "sky,", "dog."], k=rnd.randint(0, 30))), "rating": rnd.choice(["general", None]),
                   "general": [(t, rnd.choice([0.2, 0.4, 0.6])) for t in tags if rnd.random() < 0.7]}
    s = C.defaults_for(profile, trigger="trig", caption_mode=mode, append_tags="w1, last")
    df = spark.createDataFrame([(i, r["tags"], r["nl"], r["rating"], r["general"]) for i, r in rows.items()],
                               "id int, tags array<string>, nl string, rating string, general array<struct<name:string,score:double>>")
    e = F.array().cast("array<string>")
    got = {r.id: (r.caption, r.removed) for r in K.fit_captions(df.withColumn("names", e).withColumn("extra", e), s, 90).collect()}
    assert got == sequential_fit(spark, rows, s, 90)
    assert all(len(c) <= 90 for c, _ in got.values())


@pytest.mark.parametrize("wanted", [["removed"], ["caption", "removed"]])
def test_fixed_pieces_are_made_once_for_a_record(spark, wanted):
    """Whatever columns are asked for, no tag makes the pieces of the caption anew: the lambda over tags looks into a list that is bound outside."""
    row = [(1, ["a"], "b", "general", [], [], [("a", 0.5)])]
    df = spark.createDataFrame(row, "id int, tags array<string>, nl string, rating string, names array<string>, extra array<string>, general array<struct<name:string,score:double>>")
    fitted = K.fit_captions(df, C.defaults_for("noobai_xl", trigger="the", append_tags="white rectangle", max_tags=0)).select(*wanted)
    looks = fitted._jdf.queryExecution().optimizedPlan().toString().split("array_contains(")[1:]
    assert any(x.startswith("lambda fixed") for x in looks) and not any(x.startswith(("CASE", "if", "array_distinct", "transform")) for x in looks)


def test_sidecar(spark):
    tags, nl = I.parse_sidecar(F.lit("1girl, solo, Trig, a girl is standing in the rain alone.\nend."), "trig")
    assert one(spark, tags) == ["1girl", "solo"] and one(spark, nl) == "a girl is standing in the rain alone., end."


def test_replies(spark):
    assert one(spark, R.clean(F.lit('<think>x\ny</think>"**This image shows in the picture, a  dog**"'))) == "A dog"
    assert one(spark, R.refused(F.lit(" As an AI I can"))) and not one(spark, R.refused(F.lit("a sorry dog")))
    tags = one(spark, R.parse_tags(F.lit("`artist: Bo_b, copyright: y, 1girl, rating: safe, meta: z, one two three four five six seven, 1Girl.`")))
    assert [(t.part, t.tag) for t in tags] == [("artist", "bo b"), ("copyright", "y"), ("general", "1girl"), ("general", "z")]
    j = spark.createDataFrame([('x {"a":1} ```json\n{"tags": ["a"], "n": {"b": 2}}``` {',), ("none",)], "r string").select(R.parse_object(F.col("r")).alias("j")).collect()
    assert j[0].j.tags == ["a"] and j[1].j is None


def test_reply_errors_stay_in_their_row(spark):
    def reply(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    got = R.answer(spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1), "p", reply).collect()
    assert [(r.reply, r.error) for r in got] == [("A", None), (None, "refused"), ("C", None)]


def test_edits(spark):
    t = F.array(F.lit("a"), F.lit("B"), F.lit("c d"))
    assert one(spark, E.add(t, "b, e", "front")) == ["e", "a", "B", "c d"] and one(spark, E.remove(t, "c*, b")) == ["a"]
    assert one(spark, E.replace(t, "b", "x, A")) == ["a", "x", "c d"]


def test_predictions_load_once_and_keep_nulls(spark):
    from tagloom.operators.tagger import predictions

    rows = [(k, [float(k), 0.2] if k % 3 else None, "keep") for k in range(10)]
    labels = [("r", "rating"), ("a", "general"), ("b", "general"), ("c", "character")]
    load = lambda: lambda x: np.stack([x[:, 0] / 10, x[:, 1], x[:, 1], x[:, 0] / 100], axis=1)
    got = {r["general_"]: r for r in predictions(spark.createDataFrame(rows, "general_ long, v array<float>, note string"), load, "v", 2, labels).collect()}
    assert got[3]["general"] is None and got[3]["rating"] is None and got[3]["note"] == "keep"
    assert [tuple(x) for x in got[7]["rating"]] == [("r", 0.7)] and [x["name"] for x in got[7]["general"]] == ["a", "b"] and got[7]["character"] == []


def test_texts_fold_one_at_a_time():
    """A batch of texts is never held as Python strings together."""
    import pyarrow as pa

    from tagloom.functions.paths import _folded, ascii_fold

    assert [_folded(t) for t in ("Ünïcode ﬁx", "plain", "", "日本", None)] == ["Unicode fix", "plain", "", "", None]
    assert isinstance(ascii_fold.func(pa.array(["é", None])), pa.Array)


def test_plain_tags_are_canonical():
    """What the short test lets through needs no other look."""
    import re

    from tagloom.functions.tags import _PLAIN, canon_text

    plain = re.compile(_PLAIN.replace(r"\z", r"\Z"))
    for t in ("", "red ring", "a (b)", "solo", "x:y", "é", "a_b", "a  b", " a", "a ", "a\n", "a\tb", "a\\b", "\\(a\\)", "0_0"):
        assert bool(plain.match(t)) == (t in ("", "red ring", "a (b)", "solo", "x:y")), t
        assert not plain.match(t) or canon_text(t) == t
