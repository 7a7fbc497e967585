"""Which terms the index of the benchmark has, and what its decomposition covers."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from trailspark.llm import decontaminate
from trailspark.llm.common import table


def test_frequent_terms_are_those_of_all_documents(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(w for k, w in enumerate(words) if i % 41 > k) or "none" for i in range(410)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ix = decontaminate.index(docs, [b"quite another item of the benchmark"], max_sample=3, max_terms=5)
    top = np.concatenate(decontaminate.terms([b"w0 w1 w2 w3 w4", b"quite another item of the benchmark"]))
    assert sorted(ix.codes.tolist()) == sorted(set(top.tolist()))


def test_the_decomposition_covers_all_documents(spark, monkeypatch):
    """No share of the documents is drawn, and the product over their passages is that of the whole matrix."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(130))) for _ in range(300)] + [None, ""]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [b"w1 w2 w3 w4 w5", b"w9 quite another item"]
    ix = decontaminate.index(docs, items, dimensions=5)
    monkeypatch.setattr(decontaminate, "in_share", lambda *a: F.lit(False))
    again = decontaminate.index(docs, items, dimensions=5)
    assert np.allclose(ix.weights @ ix.weights.T, again.weights @ again.weights.T, atol=1e-4)

    vocabulary, heavy = decontaminate.Vocabulary(ix.codes), np.arange(len(ix.codes)) % 7 > 0
    q = np.random.default_rng(1).standard_normal((len(ix.codes), 5)).astype(np.float32)
    want = np.zeros(q.shape)
    for code in decontaminate.terms([t.encode() for t in texts if t]):
        ids = vocabulary.ids(code)
        for a in range(0, len(ids), decontaminate.WINDOW):
            n = np.bincount(ids[a : a + decontaminate.WINDOW], minlength=len(q)) * heavy
            want += np.outer(n, n @ q)
    assert np.allclose(decontaminate._over_passages(docs, ix.codes, heavy, q), want, rtol=1e-4, atol=1e-3)


def test_ids_of_terms_whose_last_bits_are_shared():
    codes = np.array([3, 9, 3 + (1 << 40), 1 << 50], np.uint64)
    asked = np.array([9, 3, 4, 3 + (1 << 41), 3 + (1 << 40), 9 + (1 << 40), 1 << 50], np.uint64)
    assert decontaminate.Vocabulary(codes).ids(asked).tolist() == [1, 0, -1, -1, 2, -1, 3]


def test_the_pipelines_stage_draws_no_share(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(decontaminate, "in_share", lambda *a: drawn.append(a) or F.lit(True))
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents").limit(30)
    assert 0 < corpus_pipeline.decontaminate_benchmark(spark, docs, small).count() <= 30 and not drawn
