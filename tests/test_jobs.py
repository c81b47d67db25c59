"""Documents, embedding jobs, reports, stores and streams on small frames."""

import datetime as dt
import json
import sys
from decimal import Decimal

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shelfseek import fixtures as fx, schema
from shelfseek.functions import ladders, vectors
from shelfseek.operators import clusters, conform, documents, embed, quality, suggest, vector
from shelfseek.plans import jobs, registry, segments, similar
from shelfseek.sources import images, tables

# The fetcher and encoder below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
DAY = dt.datetime(2024, 1, 1)


def frame(spark, table, rows):
    names = schema.columns(table)
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema.DDL[table])


def catalogue(spark):
    return {
        "categories": frame(spark, "categories", [dict(uuid="c1", category_title="Toys", slug="toys")]),
        "subcategories": frame(spark, "subcategories", [
            dict(uuid="s1", sub_category_title="Cars", sub_category_slug="cars", category_id="c1")]),
        "leaf_categories": frame(spark, "leaf_categories", [
            dict(id="l1", category_id="c1", subcategory_id="gone", leaf_category_title="Fast",
                 leaf_category_slug=None, slug="fast")]),
        "scrape_runs": frame(spark, "scrape_runs", [dict(id="r1", keyword="k", status="done")]),
        "products": frame(spark, "products", [
            dict(id="p1", title="", company="Acme", product_url="u1", image_url="i1",
                 category_id="c1", subcategory_id="s1", leaf_category_id="l1", created_at=DAY),
            dict(id="p2", title="Two", product_url="u1", image_url=" ", category_id="zz"),
            dict(id="p3", image_url="i3", created_at=DAY, updated_at=dt.datetime(2025, 1, 1))]),
        "product_details": frame(spark, "product_details", [
            dict(id="d1", product_id="p1", scrape_run_id="r1", success=True, product_title="Old",
                 scraped_at=DAY, created_at=DAY, original_price=Decimal("5.00")),
            dict(id="d2", product_id="p1", scrape_run_id="r1", success=True, product_title="New",
                 supplier_name="S", scraped_at=dt.datetime(2024, 3, 1), created_at=DAY,
                 promotional_price=Decimal("4.00")),
            dict(id="d3", product_id="p1", success=False, product_title="Undated",
                 created_at=dt.datetime(2025, 1, 1))]),
        "product_detail_variants": frame(spark, "product_detail_variants", [
            dict(uuid="v1", product_id="p1", product_detail_id="d1", variant_index=0),
            dict(uuid="v2", product_id="p2", product_detail_id="d2", variant_index=0)]),
        "product_scrape_results": frame(spark, "product_scrape_results", [
            dict(id="x1", scrape_run_id="r1", product_id="p2"),
            dict(id="x2", scrape_run_id="r1", product_id="p1")]),
        "product_embeddings": frame(spark, "product_embeddings", [
            dict(id="e1", product_id="p1", embedding=[1.0, 0.0])]),
        "product_search_documents": frame(spark, "product_search_documents", [
            dict(product_id="p1"), dict(product_id="p3")]),
    }


def built(spark, t, ids=None):
    taxonomy = [t[n] for n in ("categories", "subcategories", "leaf_categories")]
    if ids is None:
        return documents.build_documents(t["products"], t["product_details"], *taxonomy)
    return documents.documents_for(ids, t["products"], t["product_details"], *taxonomy)


def test_document_rules(spark):
    rows = {r["product_id"]: r for r in built(spark, catalogue(spark)).collect()}
    p1 = rows["p1"]
    assert p1["title"] == "New" and p1["lexical_title"] == ""
    assert p1["company"] == "Acme" and p1["leaf_category_slug"] == "fast"
    assert p1["original_price"] == Decimal("4.00") == p1["sortable_price"]
    assert p1["updated_at"] == dt.datetime(2024, 3, 1)
    assert p1["search_text"] == "p1  new acme s toys toys cars cars fast"
    assert rows["p2"]["category_id"] is None and rows["p2"]["updated_at"] is None
    assert rows["p3"]["title"] is None and rows["p3"]["updated_at"] == dt.datetime(2025, 1, 1)


def test_sync_upsert_delete(spark):
    t = catalogue(spark)
    ids = spark.createDataFrame([("p1",), ("p1",), ("nope",)], "product_id string")
    full = built(spark, t)
    assert [r["product_id"] for r in built(spark, t, ids).collect()] == ["p1"]
    stale = full.withColumn("title", F.lit("stale"))
    mixed = {r["product_id"]: r["title"] for r in
             documents.upserted(stale, built(spark, t, ids)).collect()}
    assert mixed == {"p1": "New", "p2": "stale", "p3": "stale"}
    status = {r[0]: r[1] for r in documents.sync_status(ids, t["products"]).collect()}
    assert status == {"p1": "indexed", "nope": "missing"}
    assert documents.without(full, ids).count() == 2
    good, bad = documents.split_ids(spark.createDataFrame(
        [("6f9619ff-8b86-d011-b42d-00c04fc964ff",), ("x",), (None,)], "product_id string"))
    assert good.count() == 1 and bad.filter("error is not null").count() == 2


def test_latest_attempt_counts(spark):
    products = frame(spark, "products", [dict(id=i, image_url="u") for i in ("a", "b", "c")])
    none = frame(spark, "product_embeddings", [])
    tries = [("1", "a", "RETRY", 1), ("2", "a", "FAILED", 2), ("3", "a", "RETRY", 3), ("4", "b", "RETRY", 1),
             ("5", "b", "FAILED", 2)]
    status = frame(spark, "product_embedding_status", [
        dict(id=i, product_id=p, status=s, attempted_at=dt.datetime(2024, 1, n)) for i, p, s, n in tries])
    due = embed.pending_retry(products, none, status, F.lit(DAY))
    assert sorted(r["id"] for r in due.collect()) == ["a", "c"]
    assert [r["id"] for r in embed.pending_retry(products, none, status, F.lit(DAY), 1).collect()] == ["a"]


def test_missing_columns_are_reported(spark):
    t = catalogue(spark)
    t["products"] = t["products"].drop("created_at")
    empty = {(r["table_name"], r["column_name"]): r["n_rows"] for r in quality.null_violations(t).collect()}
    assert empty[("products", "created_at")] == t["products"].count()
    t["products"] = t["products"].drop("product_url")
    with pytest.raises(ValueError, match="products.product_url"):
        quality.duplicate_keys(t)
    with pytest.raises(ValueError, match="categories"):
        quality.orphans({n: df for n, df in t.items() if n != "categories"})


def test_orphans_duplicates_nulls(spark):
    t = catalogue(spark)
    lost = {(r["table_name"], r["column_name"], r["missing_key"]) for r in quality.orphans(t).collect()}
    assert lost == {("leaf_categories", "subcategory_id", "gone"), ("products", "category_id", "zz")}
    twice = {(r["table_name"], r["key_value"], r["n_rows"]) for r in quality.duplicate_keys(t).collect()}
    assert twice == {("products", "u1", 2)}
    empty = {(r["table_name"], r["column_name"]): r["n_rows"] for r in quality.null_violations(t).collect()}
    assert empty[("leaf_categories", "leaf_category_slug")] == 1
    assert ("products", "id") not in empty


def test_cascades(spark):
    t = catalogue(spark)
    left = quality.delete_cascade(t, "products", spark.createDataFrame([("p1",)], "key string"))
    counts = {n: df.count() for n, df in left.items()}
    # The variant of p2 hangs on a detail of p1 and goes with it.
    assert counts["products"] == 2 and counts["product_details"] == 0
    assert counts["product_detail_variants"] == 0 and counts["product_embeddings"] == 0
    assert counts["product_scrape_results"] == 1 and counts["categories"] == 1
    left = quality.delete_cascade(t, "scrape_runs", spark.createDataFrame([("r1",)], "key string"))
    assert left["product_scrape_results"].count() == 0
    assert left["product_details"].filter("scrape_run_id is not null").count() == 0
    assert left["product_details"].count() == 3 and left["scrape_runs"].count() == 0


def test_conform(spark):
    now = F.lit(DAY)
    old = spark.createDataFrame([("a", "home-items")], "id string, slug string")
    sub = conform.conform(old, "subcategories", now).first()
    assert (sub["uuid"], sub["sub_category_slug"], sub["created_at"]) == ("a", "home-items", DAY)
    both = spark.createDataFrame([("a", "b")], "id string, uuid string")
    assert conform.conform(both, "categories", now).columns[-1] == "id"
    variant = conform.conform(spark.createDataFrame(
        [("v", "12", "raw"), ("w", "many", "raw")], "uuid string, stock_quantity string, raw string"),
        "product_detail_variants", now)
    assert "raw" not in variant.columns
    assert {r["uuid"]: r["stock_quantity"] for r in variant.collect()} == {"v": 12, "w": None}
    leaf = conform.backfill_leaf_categories(frame(spark, "leaf_categories", [
        dict(id="l", slug="red-shoes"), dict(id="m", slug="x", leaf_category_slug="y-z")]))
    assert {r["id"]: (r["leaf_category_slug"], r["leaf_category_title"]) for r in leaf.collect()} == {
        "l": ("red-shoes", "Red Shoes"), "m": ("y-z", "Y Z")}


def fetch(url, headers, timeout):
    assert headers["Referer"] == url and timeout == 15.0
    if url == "busy":
        raise embed.FetchFailed("busy", 503)
    if url == "gone":
        raise embed.FetchFailed("gone", 404)
    if url == "cut":
        raise OSError("connection reset")
    return b"" if url == "empty" else url.encode() * 9


def picky():
    encoder = embed.HashEncoder(16)

    def encode(items):
        if any(i == b"broken" * 9 for i in items):
            raise ValueError("cannot decode")
        return encoder(items)
    return encode


def test_index_products(spark):
    urls = ["ok", "busy", "gone", "cut", "broken", "ok2", None, "  ", "ok"]
    products = frame(spark, "products", [dict(id=f"p{i}", image_url=u) for i, u in enumerate(urls)])
    stored = frame(spark, "product_embeddings", [dict(id="e", product_id="p8", embedding=[1.0])])
    ids = spark.createDataFrame([(f"p{i}",) for i in range(9)] + [("none",), ("p0",)],
                                "product_id string")
    out = embed.index_products(ids, products, stored, fetch, picky).cache()
    rows = {r["product_id"]: r for r in out.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        "p0": "indexed", "p1": "failed", "p2": "failed", "p3": "failed", "p4": "failed",
        "p5": "indexed", "p6": "skipped", "p7": "skipped", "p8": "skipped", "none": "failed"}
    assert [rows[f"p{i}"]["retryable"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert rows["p4"]["reason"] == "cannot decode" and rows["p4"]["http_status"] == 400
    assert np.linalg.norm(rows["p0"]["embedding"]) == pytest.approx(1, abs=1e-6)
    fresh = embed.new_embeddings(out, F.lit(DAY)).collect()
    assert {r["product_id"] for r in fresh} == {"p0", "p5"} and all(r["id"] for r in fresh)
    waiting = embed.retry_rows(out, F.lit(DAY), F.lit(DAY))
    assert {(r["product_id"], r["status"]) for r in waiting.collect()} == {
        ("p1", "RETRY"), ("p2", "FAILED"), ("p3", "RETRY"), ("p4", "FAILED")}
    due = embed.pending_retry(products, stored, waiting, F.lit(DAY))
    assert {r["id"] for r in due.collect()} == {"p0", "p1", "p3", "p5", "p7"}
    assert {r["id"] for r in embed.pending(products, stored).collect()} == {
        "p0", "p1", "p2", "p3", "p4", "p5", "p7"}


def test_jobs_store_what_they_did(spark, tmp_path):
    t = catalogue(spark)
    taxonomy = [t[n] for n in ("categories", "subcategories", "leaf_categories")]
    root = str(tmp_path / "d")
    source = (t["products"], t["product_details"], *taxonomy)
    assert jobs.rebuild_documents(root, t["product_embeddings"], 2, *source) == 3
    opened = segments.read(spark, root)
    stale = opened.documents.withColumn("title", F.lit("stale"))
    segments.create(root, stale, t["product_embeddings"], 2)
    ids = spark.createDataFrame([("p1",), ("zz9",), ("?",)], "product_id string")
    status = jobs.sync_documents(root, ids, *source, pattern="^[a-z0-9]+$")
    assert {r[0]: r[1] for r in status.collect()} == {"p1": "indexed", "zz9": "missing",
                                                      "?": "rejected"}
    titles = lambda index: {r["product_id"]: r["title"] for r in index.documents.collect()}
    assert titles(segments.read(spark, root)) == {"p1": "New", "p2": "stale", "p3": "stale"}
    assert titles(opened) == {"p1": "New", "p2": "Two", "p3": None}, "a reader keeps its version"
    urls = ["ok", "busy", "ok2"]
    products = frame(spark, "products", [
        dict(id=f"p{i}", image_url=u, updated_at=dt.datetime(2024, 1, 1 + i)) for i, u in enumerate(urls)])
    none = frame(spark, "product_embeddings", [])
    one = jobs.index_pending(products, none, fetch, picky, limit=1)
    assert [(r["product_id"], r["status"]) for r in one.collect()] == [("p2", "indexed")]
    paths = str(tmp_path / "e"), str(tmp_path / "s")
    every = jobs.index_pending(products, none, fetch, picky)
    assert jobs.store_outcomes(every, none, *paths, F.lit(DAY), F.lit(DAY)) == {
        "indexed": 2, "failed": 1}
    kept = tables.read_table(spark, paths[0], "product_embeddings")
    assert {r["product_id"] for r in kept.collect()} == {"p0", "p2"}
    again = jobs.index_pending(products, kept, fetch, picky)
    assert [(r["product_id"], r["retryable"]) for r in again.collect()] == [("p1", True)]
    waiting = tables.read_table(spark, paths[1], "product_embedding_status")
    assert [r["status"] for r in waiting.collect()] == ["RETRY"]


def test_texts_and_insert_if_absent(spark):
    texts = spark.createDataFrame([(1, "red ring"), (2, "  "), (3, None)], "i int, text string")
    rows = {r["i"]: r for r in embed.embed_texts(texts, picky).collect()}
    assert len(rows[1]["embedding"]) == 16 and rows[1]["error"] is None
    assert rows[2]["embedding"] is None and rows[3]["error"] == "no text to embed"
    stored = frame(spark, "product_embeddings", [dict(id="e1", product_id="a", embedding=[1.0])])
    offered = frame(spark, "product_embeddings", [
        dict(id="e2", product_id="a", embedding=[2.0]), dict(id="e4", product_id="b", embedding=[4.0]),
        dict(id="e3", product_id="b", embedding=[3.0])])
    assert [r["id"] for r in documents.inserted_if_absent(stored, offered).collect()] == ["e3"]


def test_image_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"abc" * 10)
    (tmp_path / "c.jpg").write_bytes(b"x" * 200)
    fits, large = images.read_images(spark, str(tmp_path), max_bytes=100)
    fits = fits.unionByName(fits.select(F.lit("b.jpg").alias("path"), F.lit(0).cast("long").alias(
        "length"), F.lit("").cast("binary").alias("content")))
    rows = {r["path"][-5:]: r["error"] for r in embed.embed_images(fits, embed.HashEncoder).collect()}
    assert rows == {"a.jpg": None, "b.jpg": "image is empty"}
    assert [r["path"][-5:] for r in large.collect()] == ["c.jpg"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([1.0, 0.0], [0.0, 0.0])],
                               "a array<float>, b array<float>")
    rows = df.select(vectors.cosine_similarity(F.col("a"), F.col("b")).alias("s"),
                     vectors.l2_normalize(F.col("b")).alias("u"),
                     vectors.vector_from_text(vectors.vector_to_text(F.col("a"))).alias("c"),
                     "a").collect()
    assert rows[0]["s"] == pytest.approx(1) and rows[1]["s"] is None and rows[1]["u"] is None
    assert rows[0]["u"] == pytest.approx([0.6, 0.8]) and all(r["c"] == r["a"] for r in rows)


def test_display_values(spark):
    df = spark.createDataFrame([(0.12345,), (0.8,), (0.59999,), (-0.00005,)], "s double")
    rows = df.select(ladders.display_similarity(F.col("s")).alias("d"),
                     ladders.similarity_band(F.col("s")).alias("b")).collect()
    assert [r["d"] for r in rows] == [0.1235, 0.8, 0.6, 0.0]
    assert [r["b"] for r in rows] == ["low", "high", "low", "low"]


def test_image_paging(spark):
    ddl = "q_id string, q_embedding array<float>, page int, per_page int, limit int, threshold double"
    rows = [("a", None, None, None, None, None), ("b", None, 0, None, 70, 0.9),
            ("c", None, 3, 500, 10, None), ("d", None, 2, -1, 10, None)]
    got = {r["q_id"]: (r["page"], r["per_page"], r["threshold"], r["depth"])
           for r in similar.paged(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"a": (1, 50, 0.5, 50), "b": (1, 70, 0.9, 70), "c": (3, 200, 0.5, 600),
                   "d": (2, 50, 0.5, 100)}


def test_clusters_with_all_lists_are_exact(spark, sf, index, tmp_path):
    asked = registry._image_queries(spark, sf, threshold=-1.0, per_page=20)
    centres = clusters.train(index.embeddings, lists=8)
    numbered = clusters.store_lists(index.embeddings, centres, str(tmp_path / "lists"))
    assert numbered.count() == index.embeddings.count()
    right = similar.similar_products(asked, index.documents, index.embeddings)
    every = similar.similar_products(asked, index.documents, numbered,
                                     clusters.nearest_lists(asked, centres, 8))
    some = similar.similar_products(asked, index.documents, numbered,
                                    clusters.nearest_lists(asked, centres, 4))
    assert all(r["recall"] == 1.0 for r in clusters.recall(right, every, 20).collect())
    share = [r["recall"] for r in clusters.recall(right, some, 20).collect()]
    assert sum(share) / len(share) > 0.6


def test_wide_or_many_queries_probe_their_lists(spark, monkeypatch):
    """Beyond one block of queries the grid looks at the same lists."""
    vectors = spark.createDataFrame([(str(i), [float(i % 2), 1.0, float(i)], i % 2) for i in range(40)],
                                    "product_id string, embedding array<float>, list_no int")
    asked = spark.createDataFrame([(f"q{i}", [1.0, 0.0, float(i)], 100, -1.0) for i in range(9)],
                                  "q_id string, q_embedding array<float>, depth int, threshold double")
    lists = spark.createDataFrame([(f"q{i}", i % 2) for i in range(9)], "q_id string, list_no int")

    def found():
        rows = vector.scan(vectors, asked, lists).collect()
        return sorted((r["q_id"], r["product_id"], r["similarity"]) for r in rows if r["product_id"])

    one = found()
    assert {int(q[1:]) % 2 == int(p) % 2 for q, p, _ in one} == {True} and len(one) == 9 * 20
    monkeypatch.setattr(vector, "MAX_QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "CELL_VECTORS", 7)
    assert found() == one


def test_probing_reads_only_its_lists(spark, index, tmp_path):
    centres = clusters.train(index.embeddings, lists=8)
    clusters.store_lists(index.embeddings, centres, str(tmp_path / "lists"))
    vectors = clusters.open_lists(spark, str(tmp_path / "lists"))
    asked = index.embeddings.limit(1).select(F.col("product_id").alias("q_id"), F.col("embedding").alias(
        "q_embedding"), F.lit(5).alias("depth"), F.lit(-1.0).alias("threshold"))
    asked = tables.stored(asked, "asked")
    plan = vector.scan(vectors, asked, clusters.nearest_lists(asked, centres, 1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list_no" in plan


def test_suggestions(spark, sf, index):
    asked = spark.createDataFrame([("a", "RE", 3), ("b", "r", None), ("c", None, None),
                                   ("d", "nation-1", 99)], "q_id string, raw string, limit int")
    got = {}
    for r in suggest.suggest(asked, index.offers).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["suggestion"])
    assert set(got) == {"a", "d"} and len(got["a"]) == 3 and len(got["d"]) == 8
    assert all(s.startswith("red") for s in got["a"]) and got["d"][0] == "NATION_1"


def test_json_bodies(spark, sf):
    bodies = {r["q_id"]: json.loads(r["body"]) for r in registry.result_bodies(spark, sf).collect()}
    assert bodies["q12"] == {"query": None, "normalizedQuery": "", "page": 0, "size": 20,
                             "totalResults": 0, "hasMore": False, "suggestions": [], "results": []}
    assert bodies["q10"]["page"] == 3 and bodies["q10"]["normalizedQuery"] == ""
    first = bodies["q01"]["results"][0]
    assert first["title"] == "red widget" and "similarity" not in first
    assert set(first["category"]) == {"id", "title", "slug"}
    assert all(None not in r.values() for b in bodies.values() for r in b["results"])
    image = json.loads(registry.image_bodies(spark, sf).first()["body"])
    assert image["success"] and image["error"] is None and image["code"] == 200
    assert image["payload"]["perPage"] == 5 and len(image["payload"]["data"]) <= 5
    assert image["payload"]["lastPage"] == -(-image["payload"]["total"] // 5)


def test_fixture_documents_are_unique(spark, sf):
    docs = fx.documents(spark, sf)
    assert docs.count() == docs.select("product_id").distinct().count()


def test_documents_of_many_ids_copy_no_id(spark, sf, monkeypatch):
    """Many ids give the documents that few give, and are not repeated to meet the details."""
    from shelfseek import fixtures as fx
    from shelfseek.operators import documents, joins

    tables = (fx.products(spark, sf), fx.product_details(spark, sf), *fx.taxonomy(spark, sf))
    ids = spark.createDataFrame([("3",), ("7",), ("7",), (None,), ("nowhere",)], "product_id string")
    few = sorted(documents.documents_for(ids, *tables).collect(), key=str)
    for module in (documents, joins):
        monkeypatch.setattr(module, "are_small", lambda *frames, **_: [len(frames) > 1] * len(frames))
    many = documents.documents_for(ids, *tables)
    assert sorted(many.collect(), key=str) == few and len(few) == 2
    assert "sequence(0, 31" not in many._jdf.queryExecution().toString()
