"""The pipeline: each stage against a brute-force version on its own input."""


import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from peakloom.llm.common import table
from test_corpus import normal, plain_hits, texts_of
from test_near_dedup import plain_kept

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(texts_of(docs)) if "doc_id" in docs.columns and "text" in docs.columns else None
        docs = stage(spark, docs, SMALL)
        seen.append((name, before, docs.collect()))
        if name != "bpe":
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[-1][2], docs.schema).repartition(3)
    after = {name: ({r.doc_id for r in rows}, before) for name, before, rows in seen}

    kept, before = after["quality classifier"]
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    assert kept <= {i for i, _ in before} and np.mean([i in kept for i, _ in before if labels.get(i) == 1]) > 0.95

    kept, before = after["exact dedup"]
    first = {}
    for i, t in before:
        first.setdefault(normal(t), i)
    assert kept == set(first.values())

    kept, before = after["near-dedup"]
    assert kept == set(plain_kept(before))

    kept, before = after["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    assert kept == {i for i, _, hit, _ in plain_hits(before, items) if not hit}

    name, before, rows = seen[-1]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.ids) for r in rows) == [(i, lib.encode(t, add_special_tokens=False).ids) for i, t in before]


def test_awkward_rows(spark, awkward, nothing):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SMALL)
        assert 0 < out.count() <= awkward.count()
        assert stage(spark, nothing, SMALL).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and 0 < out.count() < table(spark, SMALL, "documents").count()
