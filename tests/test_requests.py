import json

from pyspark.sql import functions as F

from tagloom.operators import requests as R
from tagloom.plans.requests import KINDS


def summaries(spark, documents):
    d = spark.createDataFrame(list(enumerate(documents)), "n int, document string").select("n", F.from_json("document", R.WORKFLOW).alias("w"))
    return {r.n: r for r in d.select("n", *[c.alias(k) for k, c in R.summary(F.col("w"), KINDS).items()]).collect()}


def test_awkward_documents(spark):
    """Null, broken and empty documents, no training step, steps without input or output, half-filled epochs and payments."""
    epochs = [{}, {"epochNumber": 2, "model": {"url": ""}, "samples": [{"url": ""}, {}, {"url": "a"}]}, {"model": {"url": "u", "available": False}}, {"model": {"available": True}}]
    paid = [{"type": "debit", "amount": 5}, {"type": "debit"}, {"type": "credit", "amount": 2}, {"type": None, "amount": 9}]
    full = {"id": "x", "status": "", "steps": [{"$type": "other", "status": "no"}, {"$type": "training", "status": "s", "input": {"ecosystem": "alpha", "model": "", "keepTokens": 3},
            "output": {"epochs": epochs}}, {"$type": "training", "status": "late"}], "transactions": {"list": paid}, "cost": {"total": 2, "factors": {"base": 2.5}}}
    got = summaries(spark, [None, "{", "{}", '{"steps": [{"$type": "other"}]}', json.dumps(full), '{"steps": [{"$type": "training", "input": {"ecosystem": "alien"}}], "transactions": {"list": []}}'])
    for n in (0, 1, 2, 3, 5):
        r = got[n]
        assert (r.status, r.cost_full, r.charged, r.refunded, r.params, r.request, r.epochs, r.insufficient_funds) == (None, None, None, None, None, None, [], False)
    r = got[4]
    assert (r.status, r.charged, r.refunded, r.cost_full, r.params) == ("s", 3, 2, 2, None)
    assert [(e.epoch, e.available, e.url, e.samples) for e in r.epochs] == [(None, False, None, []), (2, False, "", ["a"]), (None, False, "u", []), (None, True, None, [])]
    q = r.request
    assert (q.training_type, q.base_model, q.trigger_word, q.shuffle_tokens, q.keep_tokens, q.continue_from, q.sample_prompts) == ("plain", None, "", None, None, "", [])


def test_round_trip(spark):
    """What an input is mapped back to gives the same input again, for each training type."""
    schema = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in R.StructType.fromDDL(R.FORM)])
    form = schema.withField("steps", F.lit(70)).withField("batch_size", F.lit(9)).withField("keep_tokens", F.lit(40)).withField("train_text_encoder", F.lit(False)) \
        .withField("text_encoder_lr", F.lit(0.1)).withField("trigger_word", F.lit(" a\t")).withField("sample_prompts", F.array(F.lit("p"))).withField("sample_cfg", F.lit(2.0))
    rest = {"model": F.lit("m"), "items": F.array(F.struct(F.lit("u").alias("url"), F.lit("c").alias("caption"))), "trigger": F.lit("t"), "negative": F.lit("n"), "shuffle": F.lit(True), "keep": F.lit(2)}
    run = F.from_json(F.lit("{}"), R.WORKFLOW)
    d = spark.createDataFrame([(k,) for k in [*KINDS, "none"]], "kind string").select("kind", R.build_input(F.col("kind"), form, KINDS, **rest).alias("a"))
    d = d.withColumn("q", R.request(run, F.col("a"), KINDS)).withColumn("b", R.build_input(F.col("q.training_type"), F.col("q"), KINDS, **rest))
    got = {r.kind: r for r in d.collect()}
    assert got.pop("none").a is None
    for kind, r in got.items():
        assert r.a == r.b and r.q.training_type == kind
        assert (r.a.batchSize, r.a.keepTokens, r.a.textEncoderLr) == (KINDS[kind].max_batch, 10, None)
        assert r.a.triggerWord == ("a" if "trigger_word" in KINDS[kind].special else None)
