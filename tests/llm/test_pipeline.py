"""The pipeline against its stages done one after the other in plain Python."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import language, packing, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run(spark, documents):
    import public_tokenizers

    classify = language.Classifier(language.dictionaries(documents))
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if classify(t)[0] != "und" and classify(t)[2] > language.NARROW]
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    rows = sorted(first.values())
    prints, parent = [simhash.fingerprint(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    rows = [r for i, r in enumerate(rows) if root(i) == i]
    encode = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = encode([secrets.redacted(t, secrets.find(t))])[0] + np.array([packing.CLOSING], "<u4").tobytes()
        for k in range(0, len(ids), 4 * packing.CAPACITY):
            want[i, hashlib.sha256(ids[k:k + 4 * packing.CAPACITY]).hexdigest()] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], hashlib.sha256(r["ids"]).hexdigest()) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // packing.CAPACITY)


def test_stages_keep_columns_and_take_no_rows(spark, documents):
    extra = documents.withColumn("row", documents.doc_id).withColumn("length", documents.text).limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SF).columns == extra.columns
        assert stage(spark, extra.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, extra.where("false"), SF).count() == 0
