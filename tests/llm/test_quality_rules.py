"""The fit of the quality classifier."""

import tracemalloc

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from shelfseek.llm import linear, quality_rules


def test_fit_holds_blocks_of_products(monkeypatch):
    """The fit equals one over whole arrays and holds little more than its rows."""
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(linear.SIZE, 2000, False)).astype(np.int32), rng.random(2000).astype(np.float32))
            for _ in range(600)] + [(np.zeros(0, np.int32), np.zeros(0, np.float32))]
    y = np.arange(601) % 2
    tracemalloc.start()
    model = linear.fit(rows, y, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * sum(len(a) for a, _ in rows)
    monkeypatch.setattr(linear, "BLOCK_FEATURES", 1 << 40)
    whole = linear.fit(rows, y, steps=2)
    assert np.array_equal(whole.weights, model.weights) and whole.bias == model.bias


def test_fit_leaves_the_features_in_a_task(spark, docs_of, no_docs, monkeypatch):
    """The driver gets the model alone, the same one as from collected features."""
    docs = docs_of([f"{'good plain words' if i % 2 else 'bad # $ % noise'} of text {i}" for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows, y = quality_rules.unpack(quality_rules.sparse_rows(
        quality_rules.labelled_sample(docs, labels, "quality")).toArrow())
    want = quality_rules.fit_calibrated(rows, y, linear.SIZE)

    def refused(self):
        raise AssertionError("collected")

    monkeypatch.setattr(DataFrame, "toArrow", refused)
    model = quality_rules.train(docs, labels)
    assert np.array_equal(model.weights, want.weights)
    assert (model.bias, model.slope, model.shift) == (want.bias, want.slope, want.shift)
    assert quality_rules.train(docs, labels.filter("quality = 1")) is None
    assert quality_rules.train(no_docs, labels) is None
