"""Held-out quality of the passage classifier, gradients, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from panelfold.llm import passages


def test_held_out_accuracy(spark):
    from panelfold.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op3_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_gradients():
    """One step of training lowers the loss on separable bags."""
    rng = np.random.default_rng(1)
    row = np.repeat(np.arange(60), rng.integers(1, 5, 60))
    x = rng.normal(size=(len(row), passages.FEATURES)).astype(np.float32)
    y = (np.arange(60) % 2).astype(float)
    first = np.searchsorted(row, np.arange(60))
    x[first, 3] += 3 * y  # one passage of a bag tells its label
    model = passages.Attention().fit(x, row, y, epochs=60)
    assert np.mean((model.score(x, row, 60) > 0.5) == y) > 0.95


def test_features_of_whole_and_empty_texts():
    texts = [b"", b"one two", b"  ", ("word " * 1000).encode(), "äöü ÄÖÜ!!".encode()]
    x, row = passages.passage_features(texts)
    assert row.tolist() == [0, 1, 2] + [3] * 16 + [4]
    assert not x[0].any() and not x[2].any() and np.isfinite(x).all()
    alone, _ = passages.passage_features([texts[3]])
    assert np.allclose(alone, x[row == 3])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i} text " * 40 if i % 2 else f"W{i}!! ### $$$ " * 40) for i in range(60)]
                                 + [(None, None), (99, ""), (1, "word1 text"), (1, "word1 text")],
                                 "doc_id bigint, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (5, None), (777, 0)],
                                   "doc_id bigint, quality int")
    model = passages.train(docs, labels)
    found = passages.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    kept = passages.good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= set(range(1, 60, 2))
    assert not {r["doc_id"] for r in kept.collect()} & set(range(0, 60, 2))
    assert passages.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in passages.score(docs, None).collect()} == {0.5}
    assert passages.good(docs.limit(0), model).count() == 0
