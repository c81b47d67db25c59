"""The segmented index against an index built anew, after every change."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shelfseek.operators import documents as docs_ops
from shelfseek.operators.suggest import suggestion_offers
from shelfseek.operators.trigram import trigram_index
from shelfseek.plans import hybrid, segments
from shelfseek.sources import tables
from shelfseek.streaming.sync import sync_stream
from test_jobs import built, catalogue
from test_search import QUERY, documents, filters

WORDS = "red blue widget gadget super mini pro café".split()


def catalogue_rows(rng, ids):
    return [dict(title=" ".join(rng.choices(WORDS, k=3)), company=rng.choice(["Acme", "Bolt", None]),
                 category_title=rng.choice(["Toys", "Tools"])) for _ in ids]


def some_documents(spark, rng, ids):
    made = documents(spark, catalogue_rows(rng, ids)).collect()
    rows = [tuple(r.asDict() | {"product_id": i})for i, r in zip(ids, made)]
    names = documents(spark, []).columns
    return spark.createDataFrame([tuple((made[k].asDict() | {"product_id": i})[c] for c in names)
                                  for k, i in enumerate(ids)], documents(spark, []).schema) if rows else documents(spark, [])


def some_vectors(spark, rng, ids):
    return spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in ids],
                                 "product_id string, embedding array<float>")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def search(spark, index):
    rows = []
    for i, raw in enumerate(["red widget", "blue", "acme", "gadgt super", "-red widget"]):
        q = dict.fromkeys(QUERY) | {"q_id": f"q{i}", "raw": raw, "q_embedding": [1.0, 0.5, 0.2, 0.1]}
        rows.append(tuple(q[c] for c in QUERY))
    return rows_of(hybrid.hybrid_search(spark.createDataFrame(rows, filters.QUERY_DDL), index))


def same_as_built(spark, index, docs, vectors):
    again = hybrid.SearchIndex.over(docs, vectors)
    for kind in ("documents", "embeddings", "postings", "offers"):
        got, right = getattr(index, kind), getattr(again, kind)
        assert rows_of(got.select(*right.columns)) == rows_of(right), kind
    held = [r[0] for r in docs.selectExpr("md5(lower(title))").collect()]
    grams = index.trigrams.filter(F.col("value_key").isin(held) & (F.col("field") == "title"))
    right = trigram_index(docs).filter("field = 'title'")
    assert rows_of(grams.select(*right.columns)) == rows_of(right)


@pytest.mark.parametrize("few", [True, False])
def test_changes_equal_a_new_index(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(segments, "FEW_ID_BYTES", -1)
    rng, root = random.Random(1), str(tmp_path / "index")
    ids = [str(i) for i in range(60)]
    docs = tables.stored(some_documents(spark, rng, ids), "d")
    vectors = tables.stored(some_vectors(spark, rng, ids[:40]), "v")
    assert segments.create(root, docs, vectors, 2) == 1
    first = segments.read(spark, root)
    before = rows_of(first.documents)
    changes = [(["3", "4", "99"], ["4", "50"], ["7"]), ([], [], ["3", "99", "nope"]), (["3", "7"], [], [])]
    for number, (changed, moved, gone) in enumerate(changes if few else changes[:1]):
        new = tables.stored(some_documents(spark, rng, changed), "n")
        newer = tables.stored(some_vectors(spark, rng, moved), "m")
        out = spark.createDataFrame([(i,) for i in gone], "product_id string")
        for _ in range(1 if number else 2):  # a repeated change changes nothing
            segments.change(spark, root, documents=new, embeddings=newer, deleted=out)
        docs = tables.stored(docs_ops.without(docs_ops.upserted(docs, new), out), "d")
        vectors = tables.stored(docs_ops.without(docs_ops.upserted(vectors, newer), out), "v")
        same_as_built(spark, segments.read(spark, root), docs, vectors)
    assert search(spark, segments.read(spark, root)) == search(spark, hybrid.SearchIndex.over(docs, vectors))
    assert rows_of(first.documents) == before, "a reader keeps the version it opened"
    segments.merge(spark, root)
    assert len(segments.segments_of(spark, root)) == 1
    same_as_built(spark, segments.read(spark, root), docs, vectors)
    assert rows_of(segments.read(spark, root, 1).documents) == before


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_bytes_are_in_proportion_and_segments_merge(spark, tmp_path, monkeypatch):
    rng, root = random.Random(2), str(tmp_path / "index")
    ids = [str(i) for i in range(3000)]
    segments.create(root, some_documents(spark, rng, ids), some_vectors(spark, rng, ids), 1)
    base = bytes_below(f"{root}/segments")
    segments.change(spark, root, documents=some_documents(spark, rng, ["1", "2"]), embeddings=some_vectors(spark, rng, ["1"]))
    assert bytes_below(f"{root}/segments") - base < base / 4 and len(segments.segments_of(spark, root)) == 2
    segments.change(spark, root, documents=some_documents(spark, rng, ids[:700]))
    assert len(segments.segments_of(spark, root)) == 1, "a fifth of the first segment was dropped"
    assert segments.read(spark, root).documents.count() == 3000
    monkeypatch.setattr(segments, "MAX_SEGMENTS", 2)
    for i in range(2):
        segments.change(spark, root, deleted=spark.createDataFrame([(str(i),)], "product_id string"))
    assert len(segments.segments_of(spark, root)) == 1 and segments.read(spark, root).documents.count() == 2998


def test_segments_are_read_without_a_shuffle(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "index")
    ids = [str(i) for i in range(200)]
    segments.create(root, some_documents(spark, rng, ids), some_vectors(spark, rng, ids), 4)
    segments.change(spark, root, documents=some_documents(spark, rng, ["1"]))
    index = segments.read(spark, root)
    plan = index.postings.groupBy("product_id", "term").count()
    assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_version_is_written_once(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "index")
    segments.create(root, some_documents(spark, rng, ["1"]), some_vectors(spark, rng, ["1"]), 1)
    with pytest.raises(Exception, match="exists"):
        segments.publish(spark, root, segments.segments_of(spark, root), 1)
    other = str(tmp_path / "branch")
    segments.branch(spark, other, root)
    segments.change(spark, other, deleted=spark.createDataFrame([("1",)], "product_id string"))
    assert segments.read(spark, root).documents.count() == 1 and segments.read(spark, other).documents.count() == 0


def test_a_table_name_stands_for_one_path(spark, tmp_path):
    rows = spark.createDataFrame([("1", 1)], "product_id string, n int")
    for place in ("old", "new"):
        rows.write.parquet(str(tmp_path / place))
    tables.open_bucketed(spark, "one_name", str(tmp_path / "old"), "product_id", 1)
    assert tables.open_bucketed(spark, "one_name", str(tmp_path / "old"), "product_id", 1).count() == 1
    with pytest.raises(ValueError, match="one_name"):
        tables.open_bucketed(spark, "one_name", str(tmp_path / "new"), "product_id", 1)


def test_stream_writes_segments(spark, tmp_path):
    t, root = catalogue(spark), str(tmp_path / "index")
    stale = built(spark, t).withColumn("title", F.lit("stale"))
    gone = stale.filter("product_id = 'p2'").withColumn("product_id", F.lit("gone"))
    segments.create(root, stale.unionByName(gone), t["product_embeddings"].select("product_id", "embedding"), 2)
    changes, batches = str(tmp_path / "changes"), (["p1", "p1", None], ["p3", "gone"], ["p1"])
    for ids in batches:
        spark.createDataFrame([(i,) for i in ids], "product_id string").write.mode("append").json(changes)
        sync_stream(
            spark.readStream.schema("product_id string").json(changes),
            lambda: tuple(t[n] for n in ("products", "product_details", "categories", "subcategories", "leaf_categories")),
            root, str(tmp_path / "cp"),
            lambda ids: ids.select("product_id", F.array(F.lit(0.5), F.lit(0.25)).cast("array<float>").alias("embedding"))
        ).awaitTermination()
    index = segments.read(spark, root)
    assert {r["product_id"]: r["title"] for r in index.documents.collect()} == {"p1": "New", "p2": "stale", "p3": None}
    assert {r["product_id"]: r["embedding"] for r in index.embeddings.collect()} == {"p1": [0.5, 0.25], "p3": [0.5, 0.25]}
    assert ("New",) in {(r["suggestion"],) for r in index.offers.collect()}
    assert rows_of(index.offers) == rows_of(suggestion_offers(index.documents).select(*index.offers.columns))
