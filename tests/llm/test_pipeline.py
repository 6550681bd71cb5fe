import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, common, ngram_join, packing, quality, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Every stage on its own input: what it keeps, its columns, and the last one's pieces."""
    docs = common.table(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.stored(stage(spark, docs, SMALL), f"test-{name}")
        after = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns
        assert not Counter(after) - Counter(before)
        kept = {r.doc_id for r in after}
        if name == "quality_rules":
            found = [quality.measures(r.text or "") for r in before]
            model = quality.fit_counts(Counter(map(quality.votes, found)))
            assert kept == {r.doc_id for r, m in zip(before, found) if not quality.base_failed(m.n_words, m.n_repeat_words) and model.posterior(quality.votes(m)) >= 0.5}
        if name == "toxicity":
            scored = toxicity.toxicity(spark.createDataFrame(before), common.table(spark, SMALL, "labels")).collect()
            assert kept == {r.doc_id for r in scored if not r.predicted}
        if name == "ngram_jaccard_join":
            hashes = ngram_join.WordHashes()
            sets = {r.doc_id: set(ngram_join.shingles(r.text, 5, hashes).tolist()) for r in before}
            near = lambda a, b: a and b and 10 * len(a & b) >= 8 * len(a | b)
            assert all(any(near(sets[i], sets[k]) for k in sets if k < i) for i in sets.keys() - kept)
            assert not any(near(sets[a], sets[b]) for a in kept for b in kept if a < b)
    texts = {r.doc_id: r.text for r in before}
    encode = bpe.encoder(bpe.default_path()).encode
    own = {}
    for r in after:
        own.setdefault(r.doc_id, []).append(r)
    assert own.keys() == texts.keys()
    for i, pieces in own.items():
        ids = np.frombuffer(encode(texts[i]) + b"\0\0\0\0", "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) == pieces[0].doc_tokens


def test_run_equals_the_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SMALL), f"again-{name}")
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(got.columns) == sorted(docs.columns) == sorted(n for n in packing.PIECES.names)
    assert Counter(map(tuple, got.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))


@pytest.mark.parametrize("change", ["empty", "extra"])
def test_empty_and_extra_columns(spark, change):
    docs = common.table(spark, SMALL, "documents")
    docs = docs.limit(0) if change == "empty" else docs.limit(60).select("*", F.lit("x").alias("text_hash"), F.lit(1).alias("n_words"), F.lit(2).alias("score"), F.lit(3).alias("set_id"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert name == "packing" or out.columns == docs.columns
        docs = common.stored(out, f"odd-{name}")
    assert (docs.count() == 0) == (change == "empty")
