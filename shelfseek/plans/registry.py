"""Named queries over the test tables, as the driver and the bench run them."""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfseek import fixtures as fx, schema
from shelfseek.functions import ladders, text, vectors
from shelfseek.operators import (clusters, conform, documents, embed, exact, filters, lexical,
                                 lookups, nearest, quality, suggest, trigram, vector)
from shelfseek.plans import hybrid, jobs, responses, segments, similar
from shelfseek.session import shared_dir
from shelfseek.sources import images, tables
from shelfseek.streaming.sync import sync_stream

_built: dict[tuple, hybrid.SearchIndex] = {}


# What a product and its rows in the search tables take, and how much a bucket should hold.
PRODUCT_BYTES, BUCKET_BYTES, MIN_BUCKETS = 8_000, 128 << 20, 8


def _buckets(n_products: int, row_bytes: float = PRODUCT_BYTES) -> int:
    """Buckets by the size of what they hold."""
    return max(MIN_BUCKETS, math.ceil(n_products * row_bytes / BUCKET_BYTES))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The search documents of a data folder, read back if they were written before."""
    written = _built.get((spark.sparkContext.applicationId, d, "documents"))
    return fx.documents(spark, d) if written is None else written


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents as the index has them, for queries that read no other search table.

    Without an index they are written alone, on first use in a session.
    """
    if (spark.sparkContext.applicationId, d, "root") in _built:
        return search_index(spark, d).documents
    key = (spark.sparkContext.applicationId, d, "documents")
    if key not in _built:
        _built[key] = tables.stored(_documents(spark, d), "documents")
    return _built[key]


def stored_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as the index has them; written alone like ``stored_documents``."""
    if (spark.sparkContext.applicationId, d, "root") in _built:
        return search_index(spark, d).embeddings
    key = (spark.sparkContext.applicationId, d, "embeddings")
    if key not in _built:
        _built[key] = tables.stored(fx.product_embeddings(spark, d), "embeddings")
    return _built[key]


def index_root(spark: SparkSession, d: str) -> str:
    """The folder of a data folder's search index, built on first use in a session."""
    key = (spark.sparkContext.applicationId, d, "root")
    if key not in _built:
        root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        segments.create(root, _documents(spark, d), fx.product_embeddings(spark, d),
                        _buckets(fx.table(spark, d, "part").count()))
        _built[key] = root
    return _built[key]


def search_index(spark: SparkSession, d: str) -> hybrid.SearchIndex:
    """The stored search tables of a data folder."""
    key = (spark.sparkContext.applicationId, d, "parts")
    if key not in _built:
        _built[key] = segments.read(spark, index_root(spark, d), 1)
    return _built[key]


def _branch(spark: SparkSession, d: str, name: str) -> str:
    """An index of its own that begins with the stored one."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    segments.branch(spark, root, index_root(spark, d), 1)
    return root


def article_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and postings of the long texts."""
    key = (spark.sparkContext.applicationId, d, "articles")
    if key not in _built:
        name = f"articles_{uuid.uuid4().hex}"
        texts = fx.table(spark, d, "documents").agg(
            F.count("*"), F.avg(F.octet_length("text"))).first()
        buckets = _buckets(texts[0], 4 * (texts[1] or 0))
        docs = tables.write_bucketed(fx.articles(spark, d), f"{name}_documents",
                                     f"{shared_dir(spark)}/{name}/documents", "product_id", buckets)
        _built[key] = (docs, tables.write_bucketed(
            lexical.postings(docs), f"{name}_postings", f"{shared_dir(spark)}/{name}/postings",
            "product_id", buckets, "term", "product_id"))
    return _built[key]


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _shown(docs: DataFrame) -> DataFrame:
    """Documents with prices as doubles and times as text, for comparison."""
    return docs.select(*[
        _stamp(c) if c == "updated_at" else
        F.col(c).cast("double").alias(c) if c.endswith("_price") else F.col(c)
        for c in docs.columns])


# --- sources and documents ------------------------------------------------------------------

def latest_detail(spark, d):
    return documents.latest_details(fx.product_details(spark, d)).select(
        "product_id", "id", _stamp("scraped_at"), _stamp("created_at"), "product_title",
        "supplier_name", F.col("original_price").cast("double").alias("original_price"))


def latest_scrape(spark, d):
    return documents.latest_scrapes(fx.product_scrape_results(spark, d)).select(
        "product_id", "id", "scrape_status", F.col("price").cast("double").alias("price"))


def build_documents(spark, d):
    return _shown(fx.documents(spark, d))


def _changed_ids(spark, d):
    """Products with a purchase event, as the feed of changes."""
    return fx.product_scrape_results(spark, d).filter(
        "scrape_status = 'purchase'").select("product_id")


def _outdated(docs: DataFrame) -> DataFrame:
    return docs.withColumn("title", F.lit("outdated")).withColumn(
        "sortable_price", F.lit(None).cast("decimal(12,2)"))


def _shown_sync(docs):
    return _shown(docs).select("product_id", "title", "company", "sortable_price", "updated_at")


def sync_documents(spark, d):
    fresh = documents.documents_for(_changed_ids(spark, d), fx.products(spark, d),
                                    fx.product_details(spark, d), *fx.taxonomy(spark, d))
    return _shown_sync(documents.upserted(_outdated(search_index(spark, d).documents), fresh))


def sync_status(spark, d):
    asked = fx.table(spark, d, "events").select(
        F.concat(F.when(F.col("event_type") == "error", "x").otherwise(""), F.col("user_id")
                 ).alias("product_id"))
    good, bad = documents.split_ids(asked.distinct(), "^[0-9]+$")
    status = documents.sync_status(good, fx.products(spark, d))
    return status.unionByName(bad.select("product_id", F.lit("rejected").alias("status")))


def _streamed(spark: SparkSession, d: str) -> str:
    """An index with an old state of the purchased products, brought up to date by a stream of purchases."""
    key = (spark.sparkContext.applicationId, d, "streamed")
    if key not in _built:
        root = _branch(spark, d, "streamed")
        old = search_index(spark, d)
        wrong = _outdated(old.documents).join(_changed_ids(spark, d), "product_id", "left_semi")
        vectors = old.embeddings.join(_changed_ids(spark, d), "product_id", "left_semi").withColumn(
            "embedding", F.reverse("embedding"))
        segments.change(spark, root, documents=wrong, embeddings=vectors)
        n_parts = fx.table(spark, d, "part").count()
        events = fx.table(spark, d, "events")
        changes = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
                   .parquet(d).filter("event_type = 'purchase'")
                   .select((F.col("event_id") % n_parts).cast("string").alias("product_id")))
        sync_stream(
            changes, lambda: (fx.products(spark, d), fx.product_details(spark, d), *fx.taxonomy(spark, d)), root,
            f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}",
            lambda ids: fx.product_embeddings(spark, d).join(ids, "product_id", "left_semi")).awaitTermination()
        _built[key] = root
    return _built[key]


def stream_sync(spark, d):
    return _shown_sync(segments.read(spark, _streamed(spark, d)).documents)


def hybrid_streamed(spark, d):
    """Search in the index that the stream brought up to date."""
    index = segments.read(spark, _streamed(spark, d))
    return _hits(hybrid.hybrid_search(_with(fx.queries(spark, d), sort="relevance", page=0), index))


def delete_documents(spark, d):
    return documents.without(search_index(spark, d).documents, _changed_ids(spark, d)).select(
        "product_id", "title")


def vector_codec(spark, d):
    coded = fx.table(spark, d, "embeddings").select(
        "vec_id", "embedding", vectors.vector_to_text(F.col("embedding")).alias("coded"))
    back = coded.withColumn("back", vectors.vector_from_text(F.col("coded")))
    total = F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select(
        "vec_id", F.size("back").alias("width"), (F.col("back") == F.col("embedding")).alias("same"),
        F.round(total, 6).alias("total"),
        F.round(vectors.norm(vectors.l2_normalize(F.col("back"))), 4).alias("unit"))


# --- queries, filters and candidates ----------------------------------------------------------

def normalize_queries(spark, d):
    """Every turn of every conversation taken as a raw query."""
    turns = fx.texts(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("q_id"), F.col("text").alias("raw"),
        F.col("role").alias("category"), F.lit(None).cast("string").alias("shop"),
        F.lit(None).cast("double").alias("min_price"), F.lit(None).cast("double").alias("max_price"),
        F.lit(None).cast("string").alias("sort"), F.col("turn").cast("int").alias("page"),
        F.length("text").alias("size"), F.lit(None).cast("array<float>").alias("q_embedding"))
    return filters.normalize_queries(turns).select(
        "q_id", "normalized", "ts_query", "phrase_query", F.size("tokens").alias("n_tokens"),
        "f_category", "sort", "page", "size", "threshold", "depth", "vector_depth", "blank")


def _batch(spark, d, embedded=False):
    return filters.query_batch(filters.normalize_queries(fx.queries(spark, d, embedded)))


def filter_documents(spark, d):
    return filters.filter_documents(filters.normalize_queries(fx.queries(spark, d, False)),
                                    search_index(spark, d).documents)


def filter_pages(spark, d):
    """Every product asks for those of a like price, some also for its category or its shop."""
    docs, none, number = search_index(spark, d).documents, F.lit(None), F.col("product_id").cast("long")
    price = F.col("sortable_price").cast("double")
    asked = docs.select(
        F.col("product_id").alias("q_id"), F.lit("anything").alias("raw"),
        F.when(number % 3 == 0, F.col("category_title")).alias("category"),
        F.when(number % 5 == 0, F.col("company")).alias("shop"),
        F.when(number % 7 != 0, price - 50.0).alias("min_price"), F.when(number % 7 < 6, price + 50.0).alias("max_price"),
        none.cast("string").alias("sort"), F.lit(0).alias("page"), F.lit(20).alias("size"),
        none.cast("array<float>").alias("q_embedding"))
    return filters.filter_pages(filters.normalize_queries(asked), docs, 20)


def exact_candidates(spark, d):
    return exact.exact_candidates(_batch(spark, d), search_index(spark, d).values)


def postings(spark, d):
    return lexical.postings(fx.documents(spark, d))


def article_postings(spark, d):
    """Postings of the whole long texts, summed up per term."""
    return lexical.postings(fx.articles(spark, d)).groupBy("term", "weight").agg(
        F.count("*").alias("n"), F.countDistinct("product_id").alias("n_docs"),
        F.sum("pos").alias("sum_pos"))


def lexical_candidates(spark, d):
    index = search_index(spark, d)
    return lexical.lexical_candidates(_batch(spark, d), index.postings, index.documents)


def _passage_queries(spark, d):
    none = F.lit(None)
    return fx.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("q_id"), F.col("text").alias("raw"),
        none.cast("string").alias("category"), none.cast("string").alias("shop"),
        none.cast("double").alias("min_price"), none.cast("double").alias("max_price"),
        none.cast("string").alias("sort"), F.lit(0).alias("page"), F.lit(60).alias("size"),
        none.cast("array<float>").alias("q_embedding"))


def lexical_passages(spark, d):
    """Every benchmark passage searched for in the whole long texts."""
    docs, index = article_index(spark, d)
    batch = filters.query_batch(filters.normalize_queries(_passage_queries(spark, d)))
    return lexical.lexical_candidates(batch, index, docs)


def lexical_phrases(spark, d):
    """The same passages with every two words joined by an apostrophe, so that they must stand side by side."""
    docs, index = article_index(spark, d)
    joined = _passage_queries(spark, d).withColumn("raw", F.regexp_replace("raw", r"(\S+)\s+(\S+)", "$1'$2"))
    return lexical.lexical_candidates(filters.query_batch(filters.normalize_queries(joined)), index, docs)


def trigram_candidates(spark, d):
    index = search_index(spark, d)
    return trigram.trigram_candidates(_batch(spark, d), index.trigrams, index.values)


def semantic_candidates(spark, d):
    index = search_index(spark, d)
    return vector.semantic_candidates(_batch(spark, d, True), index.documents, index.embeddings)


# --- hybrid search ------------------------------------------------------------------------------

def _hits(rows: DataFrame) -> DataFrame:
    return rows.select(
        "q_id", "rank", "product_id", "title", "company", "category_title",
        F.col("original_price").cast("double").alias("original_price"), _stamp("updated_at"),
        *hybrid.SCORES, "final_score", "match_type", "highlight",
        F.array_join("matched_fields", ",").alias("matched_fields"), "total", "has_more")


def _search(spark, d, queries):
    return _hits(hybrid.hybrid_search(queries, search_index(spark, d)))


def _with(queries, **values):
    for name, value in values.items():
        queries = queries.withColumn(name, F.lit(value).cast(queries.schema[name].dataType))
    return queries


def _sorted_search(mode):
    def run(spark, d):
        return _search(spark, d, _with(fx.queries(spark, d), sort=mode, page=0))
    return run


def hybrid_page2(spark, d):
    return _search(spark, d, _with(fx.queries(spark, d), sort="relevance", page=1, size=15))


def hybrid_filtered(spark, d):
    return _search(spark, d, _with(fx.queries(spark, d), category=" Asia ", min_price=20000.0,
                                   max_price=80000.0, page=0))


def hybrid_no_embedding(spark, d):
    return _search(spark, d, fx.queries(spark, d, False))


def name_queries(spark, d):
    """Every distinct product name, brand and category level as a query."""
    part = fx.table(spark, d, "part")
    names = (part.select(F.col("p_name").alias("raw"))
             .unionByName(part.select(F.col("p_brand").alias("raw")))
             .unionByName(part.select(F.col("p_type").alias("raw")))
             .unionByName(fx.table(spark, d, "nation").select(F.col("n_name").alias("raw")))
             .unionByName(fx.table(spark, d, "region").select(F.col("r_name").alias("raw")))
             .distinct())
    none = F.lit(None)
    return names.select(
        F.col("raw").alias("q_id"), "raw", none.cast("string").alias("category"),
        none.cast("string").alias("shop"), none.cast("double").alias("min_price"),
        none.cast("double").alias("max_price"), none.cast("string").alias("sort"),
        F.lit(0).alias("page"), F.lit(20).alias("size"),
        none.cast("array<float>").alias("q_embedding"))


def _updated(spark: SparkSession, d: str) -> str:
    """An index after an update: purchased products deleted, signed-up ones renamed and synced."""
    key = (spark.sparkContext.applicationId, d, "updated")
    if key not in _built:
        products = fx.products(spark, d)
        events = fx.product_scrape_results(spark, d)
        renamed = events.filter("scrape_status = 'signup'").select("product_id").distinct()
        title = F.when(F.col("title") != "", F.concat(F.lit("new "), "title")).otherwise(F.col("title"))
        fresh = documents.documents_for(renamed, products.withColumn("title", title),
                                        fx.product_details(spark, d), *fx.taxonomy(spark, d))
        root = _branch(spark, d, "updated")
        segments.change(spark, root, documents=fresh)
        segments.change(spark, root, deleted=_changed_ids(spark, d))
        _built[key] = root
    return _built[key]


def hybrid_updated(spark, d):
    return _hits(hybrid.hybrid_search(_with(fx.queries(spark, d), sort="relevance", page=0),
                                      segments.read(spark, _updated(spark, d))))


class LengthEncoder:
    """Stand-in encoder: a unit vector along the text's length; refuses lengths that 5 divides."""

    def __call__(self, items: list[str]) -> list[list[float]]:
        if any(len(i) % 5 == 0 for i in items):
            raise ValueError("refused")
        return [[float(k == len(i) % 64) for k in range(64)] for i in items]


def hybrid_encoded(spark, d):
    """Every name as a query without a vector: encoded inside the search, refused texts without semantic part."""
    queries = name_queries(spark, d).drop("q_embedding")
    return hybrid.encoded_search(queries, search_index(spark, d), LengthEncoder).select(
        "q_id", "rank", "product_id", "lexical_score", "semantic_score", "match_type", "total", "has_more")


def hybrid_batch(spark, d):
    return _search(spark, d, name_queries(spark, d))


# --- similarity -----------------------------------------------------------------------------------

def _image_queries(spark, d, page=1, per_page=None, threshold=0.2):
    return fx.label_vectors(spark, d).select(
        F.col("label").cast("string").alias("q_id"), "q_embedding",
        F.lit(page).alias("page"), F.lit(per_page).cast("int").alias("per_page"),
        F.lit(None).cast("int").alias("limit"), F.lit(threshold).alias("threshold"))


def _similar(spark, d, **asked):
    return similar.similar_products(_image_queries(spark, d, **asked), stored_documents(spark, d),
                                    stored_embeddings(spark, d))


def _shown_similar(rows):
    return rows.select(
        "q_id", "rank", "product_id", "title", "company", "category_title", "similarity",
        F.col("original_price").cast("double").alias("original_price"), "match_type", "highlight",
        F.array_join("matched_fields", ",").alias("matched_fields"), "total", "has_more")


def similar_products(spark, d):
    return _shown_similar(_similar(spark, d, page=1))


def similar_page2(spark, d):
    return _shown_similar(_similar(spark, d, page=2, per_page=7))


def similar_all_pairs(spark, d):
    """Every vector as a query against all others: counts and nearest neighbour."""
    docs, embeddings = stored_documents(spark, d), stored_embeddings(spark, d)
    asked = embeddings.select(
        F.col("product_id").alias("q_id"), F.col("embedding").alias("q_embedding"),
        F.lit(1).alias("page"), F.lit(2).alias("per_page"), F.lit(None).cast("int").alias("limit"),
        F.lit(0.3).alias("threshold"))
    return similar.similar_products(asked, docs, embeddings).select(
        "q_id", "rank", "product_id", "similarity", "total")


def similar_count(spark, d):
    return similar.similar_totals(_image_queries(spark, d), stored_documents(spark, d), stored_embeddings(spark, d))


def similarity_bands(spark, d):
    rows = _similar(spark, d, page=1, per_page=200)
    return rows.select("q_id", "product_id", ladders.similarity_band(F.col("score")).alias("band"),
                       F.format_number(ladders.similarity_percent(F.col("score")), 1)
                       .alias("percent"))


def _pictured(index: hybrid.SearchIndex) -> DataFrame:
    """Vectors of the products with a picture, and when those changed."""
    shown = index.documents.filter("image_url is not null").select("product_id", "updated_at")
    return index.embeddings.select("product_id", "embedding").join(shown, "product_id")


def coded_lists(spark: SparkSession, d: str) -> nearest.CodedLists:
    """Coded lists around centres trained on all vectors; built on first use in a session."""
    key = (spark.sparkContext.applicationId, d, "lists")
    if key not in _built:
        vectors = _pictured(search_index(spark, d))
        _built[key] = nearest.store(vectors, clusters.train(vectors),
                                    f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}")
    return _built[key]


def ann_search(spark, d):
    """Every fiftieth vector searched in the trained lists: neighbours, recall, and whether bounds spared vectors."""
    index = search_index(spark, d)
    lists = coded_lists(spark, d)
    asked = index.embeddings.filter(F.col("product_id").cast("long") % 50 == 0).select(
        F.col("product_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    found = tables.stored(nearest.search(asked, lists, _pictured(index), 10), "nearest")
    right = similar.similar_products(asked.select(
        "*", F.lit(1).alias("page"), F.lit(10).alias("per_page"), F.lit(None).cast("int").alias("limit"),
        F.lit(-1.0).alias("threshold")), index.documents, index.embeddings)
    listed = found.groupBy("q_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "product_id"))), lambda r: r["product_id"]),
                     ",").alias("neighbours"),
        (F.max("compared") < int(lists.count.sum())).alias("fewer"))
    return clusters.recall(right, found, 10).join(listed, "q_id")


def result_bodies(spark, d):
    queries = fx.queries(spark, d)
    normalized = filters.normalize_queries(queries)
    index = search_index(spark, d)
    rows = tables.stored(hybrid.hybrid_search(queries, index), "page")
    tips = suggest.fallback_suggestions(normalized, rows, index.offers)
    return responses.text_response(normalized, rows, tips)


def result_json(spark, d):
    """The JSON pages, read back: what a client finds in them."""
    ddl = ("query string, normalizedQuery string, page int, size int, totalResults long, hasMore boolean, "
           "suggestions array<string>, results array<struct<id: string, title: string, company: string, "
           "originalPrice: double, category: struct<id: string, title: string, slug: string>>>")
    rows = result_bodies(spark, d).select("q_id", F.from_json("body", ddl).alias("b"))
    return rows.select(
        "q_id", "b.query", F.col("b.normalizedQuery").alias("normalized"), "b.page", "b.size",
        F.col("b.totalResults").alias("total"), F.col("b.hasMore").alias("has_more"),
        F.array_join("b.suggestions", "|").alias("suggestions"), *_listed("b.results"))


def _listed(results: str):
    """The ids, titles and category slugs of a page in order, and the sum of its prices."""
    joined = lambda field: F.array_join(F.transform(results, lambda r: F.coalesce(field(r), F.lit("-"))), "|")
    prices = F.aggregate(results, F.lit(0.0), lambda s, r: s + F.coalesce(r["originalPrice"], F.lit(0.0)))
    return (joined(lambda r: r["id"]).alias("ids"), joined(lambda r: r["title"]).alias("titles"),
            joined(lambda r: r["category"]["slug"]).alias("slugs"), F.round(prices, 2).alias("prices"))


def image_bodies(spark, d):
    docs, embeddings = stored_documents(spark, d), stored_embeddings(spark, d)
    asked = _image_queries(spark, d, page=1, per_page=5)
    totals = similar.similar_totals(asked, docs, embeddings)
    rows = similar.similar_products(asked, docs, embeddings)
    return responses.image_response(asked, totals, rows)


def image_json(spark, d):
    """The JSON pages of the image search, read back."""
    ddl = ("success boolean, code int, payload struct<total: long, currentPage: int, perPage: int, lastPage: long, "
           "data: array<struct<id: string, title: string, originalPrice: double, similarity: double, "
           "category: struct<slug: string>>>>")
    rows = image_bodies(spark, d).select("q_id", F.from_json("body", ddl).alias("b")).select("q_id", "b.*")
    return rows.select(
        "q_id", "success", "code", "payload.total", F.col("payload.currentPage").alias("page"),
        F.col("payload.perPage").alias("per_page"), F.col("payload.lastPage").alias("last_page"),
        *_listed("payload.data"))


# --- suggestions ----------------------------------------------------------------------------------

def _prefixes(spark, d):
    """Prefixes typed on the way to every name: its first 1, 2, 3 and 5 characters."""
    names = name_queries(spark, d).select("raw")
    cut = names.select(F.explode(F.array(*[F.left("raw", F.lit(n)) for n in (1, 2, 3, 5)]))
                       .alias("raw")).distinct()
    return cut.select(F.col("raw").alias("q_id"), "raw",
                      F.when(F.length("raw") == 3, 5).alias("limit"))


def suggestions(spark, d):
    return suggest.suggest(_prefixes(spark, d), search_index(spark, d).offers)


def suggestions_fallback(spark, d):
    normalized = filters.normalize_queries(_prefixed_queries(spark, d))
    index = search_index(spark, d)
    found = exact.exact_candidates(filters.query_batch(normalized), index.values)
    return suggest.fallback_suggestions(normalized, found, index.offers)


def _prefixed_queries(spark, d):
    """Cut-off names of brands and nations, which match nothing exactly."""
    rows = name_queries(spark, d)
    return rows.withColumn("raw", F.expr("left(raw, length(raw) - 2)")).filter("length(raw) >= 2")


# --- embedding jobs -------------------------------------------------------------------------------

def pending_embeddings(spark, d):
    rows = embed.newest(embed.pending(fx.products(spark, d), fx.product_embeddings(spark, d)), 100)
    return rows.select("id", _stamp("updated_at"))


def pending_all(spark, d):
    return embed.pending(fx.products(spark, d), fx.product_embeddings(spark, d)).select("id")


def pending_retry(spark, d):
    return embed.pending_retry(
        fx.products(spark, d), fx.product_embeddings(spark, d),
        fx.product_embedding_status(spark, d), F.lit(fx.NOW).cast("timestamp"))


def pending_attempts(spark, d):
    """Products due for another try, by the latest of several attempts at each."""
    return embed.pending_retry(
        fx.products(spark, d), fx.product_embeddings(spark, d),
        fx.product_embedding_attempts(spark, d), F.lit(fx.NOW).cast("timestamp"))


def offline_fetch(url: str, headers: dict, timeout: float) -> bytes:
    """Answers by the number in the address: some fail with a status, some without."""
    number = int(url.rsplit("/", 1)[1].split(".")[0])
    for divisor, status in ((17, 404), (19, 503), (23, None)):
        if number % divisor == 0:
            raise embed.FetchFailed(f"answer {status}", status)
    return f"{headers['Referer']} {headers['Accept']}".encode()


def _outcomes(spark, d):
    ids = fx.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("product_id")).unionByName(
        fx.products(spark, d).select(F.col("id").alias("product_id"))).unionByName(
        fx.table(spark, d, "customer").select(
            F.concat(F.lit("c"), "c_custkey").alias("product_id")))
    return embed.index_products(ids, fx.products(spark, d), fx.product_embeddings(spark, d),
                                offline_fetch, embed.HashEncoder)


def embed_outcomes(spark, d):
    return _outcomes(spark, d).select(
        "product_id", "status", "reason", "http_status", "retryable",
        F.size("embedding").alias("width"))


def embed_counts(spark, d):
    return embed.outcome_counts(_outcomes(spark, d))


def index_newest(spark, d):
    """Outcomes of embedding the newest hundred pending products."""
    return jobs.index_pending(fx.products(spark, d), fx.product_embeddings(spark, d), offline_fetch,
                              embed.HashEncoder, limit=100).select(
        "product_id", "status", "reason", "retryable")


def insert_embeddings(spark, d):
    """Embeddings stored after an insert that gives way to what is stored already."""
    kept = fx.product_embeddings(spark, d)
    offered = fx.table(spark, d, "embeddings").select(
        F.concat(F.lit("n"), "vec_id").alias("id"),
        F.pmod(F.col("vec_id") * 3, F.lit(700)).cast("string").alias("product_id"), "embedding",
        F.lit("x").alias("source_image_url"), F.lit(embed.MODEL_VERSION).alias("model_version"),
        F.lit(fx.NOW).cast("timestamp").alias("created_at"))
    both = kept.unionByName(documents.inserted_if_absent(kept, offered))
    return both.select("product_id", "id", "model_version", F.size("embedding").alias("width"))


def embed_texts(spark, d):
    rows = fx.texts(spark, d, "documents").select("doc_id", "text")
    done = embed.embed_texts(rows, embed.HashEncoder)
    return done.select("doc_id", F.size("embedding").alias("width"),
                       F.round(vectors.norm(F.col("embedding")), 3).alias("length"), "error")


def image_files(spark, d):
    """The table files themselves as binary input: encoded if they fit, refused if not."""
    fits, large = images.read_images(spark, d, pattern="*.parquet")
    done = embed.embed_images(fits, embed.HashEncoder)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return done.select(name, "length", F.size("embedding").alias("width"), "error").unionByName(
        large.select(name, "length", F.lit(None).cast("int").alias("width"), "error"))


# --- look-ups, checks and layout --------------------------------------------------------------------

def catalogue_lookups(spark, d):
    products = fx.products(spark, d)
    asked = fx.table(spark, d, "events").select(F.col("event_id").cast("string").alias("product_id"))
    found = lookups.by_id(asked, products).filter("found").select(
        F.lit("id").alias("lookup"), F.col("product_id").alias("key"), "product_id")
    ready = lookups.with_details_and_image(products, fx.product_details(spark, d)).select(
        F.lit("ready").alias("lookup"), F.lit("").alias("key"), F.col("id").alias("product_id"))
    shops = products.select(F.col("company").alias("key")).filter("key is not null")
    by_shop = lookups.ids_by(shops, products, "company").select(
        F.lit("shop").alias("lookup"), "key", "product_id")
    groups = fx.categories(spark, d).select(F.col("uuid").alias("key"))
    by_category = lookups.ids_by(groups, products, "category_id").select(
        F.lit("category").alias("lookup"), "key", "product_id")
    return found.unionByName(ready).unionByName(by_shop).unionByName(by_category)


def _catalogue(spark, d):
    return {
        "categories": fx.categories(spark, d), "subcategories": fx.subcategories(spark, d),
        "leaf_categories": fx.leaf_categories(spark, d), "scrape_runs": fx.scrape_runs(spark, d),
        "products": fx.products(spark, d),
        "product_scrape_results": fx.product_scrape_results(spark, d),
        "product_details": fx.product_details(spark, d),
        "product_embeddings": fx.product_embeddings(spark, d),
        "product_detail_variants": fx.product_detail_variants(spark, d),
        "product_search_documents": stored_documents(spark, d),
    }


def orphans(spark, d):
    return quality.orphans(_catalogue(spark, d))


def duplicate_keys(spark, d):
    return quality.duplicate_keys(_catalogue(spark, d))


def null_violations(spark, d):
    return quality.null_violations(_catalogue(spark, d))


def cascade_delete(spark, d):
    """Rows left per table after deleting purchased products, and then the delivered runs."""
    gone = _changed_ids(spark, d).select(F.col("product_id").alias("key"))
    left = quality.delete_cascade(_catalogue(spark, d), "products", gone)
    runs = fx.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("key"))
    left = quality.delete_cascade(left, "scrape_runs", runs)
    counts = [rows.agg(F.count("*").alias("n_rows"),
                       (F.count("scrape_run_id") if "scrape_run_id" in rows.columns
                        else F.lit(0).cast("long")).alias("n_with_run"))
              .select(F.lit(name).alias("table_name"), "n_rows", "n_with_run")
              for name, rows in left.items()]
    return functools.reduce(DataFrame.unionByName, counts)


def taxonomy_backfill(spark, d):
    nations = fx.subcategories(spark, d).withColumn("sub_category_title", F.when(
        F.col("category_id") != "0", F.col("sub_category_title")))
    leaves = fx.leaf_categories(spark, d).withColumn("leaf_category_title", F.when(
        F.length("slug") > 6, F.col("leaf_category_title")))
    regions = fx.categories(spark, d).withColumn("category_title", F.lit(None).cast("string"))
    return (conform.backfill_categories(regions).select(
                F.col("uuid").alias("id"), F.col("category_title").alias("title"), "slug")
            .unionByName(conform.backfill_subcategories(nations).select(
                F.col("uuid").alias("id"), F.col("sub_category_title").alias("title"),
                F.col("sub_category_slug").alias("slug")))
            .unionByName(conform.backfill_leaf_categories(leaves).select(
                "id", F.col("leaf_category_title").alias("title"),
                F.col("leaf_category_slug").alias("slug"))))


def conform_schema(spark, d):
    """Line items as an older variants table: text stock, an extra column, no dimensions."""
    old = fx.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
        .alias("uuid"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_linenumber").alias("variant_index"),
        F.when(F.col("l_returnflag") == "R", "many").otherwise(
            F.col("l_quantity").cast("long").cast("string")).alias("stock_quantity"),
        F.col("l_linestatus").alias("raw"))
    new = conform.conform(old, "product_detail_variants", F.lit(fx.NOW).cast("timestamp"))
    return new.select("uuid", "product_id", "variant_index", "stock_quantity", "color",
                      F.col("price").cast("double").alias("price"), _stamp("created_at"),
                      F.lit(len(new.columns)).alias("n_columns"))


def conform_details(spark, d):
    old = fx.product_details(spark, d).withColumn("description", F.lit("x"))
    new = conform.conform(old, "product_details", F.lit(fx.NOW).cast("timestamp"))
    return new.groupBy("discount_rules", "meta", "success").agg(
        F.count("*").alias("n"), F.sum("original_price")
        .cast("double").alias("total"), F.count("coupon_price").alias("n_coupon"))


QUERIES = {f.__name__: f for f in (
    latest_detail, latest_scrape, build_documents, sync_documents, sync_status, stream_sync, hybrid_streamed,
    delete_documents, vector_codec, normalize_queries, filter_documents, filter_pages, exact_candidates,
    postings, article_postings, lexical_candidates, lexical_passages, lexical_phrases, trigram_candidates,
    semantic_candidates, hybrid_page2, hybrid_filtered, hybrid_no_embedding, hybrid_updated, hybrid_batch, hybrid_encoded,
    similar_products, similar_page2, similar_all_pairs, similar_count, similarity_bands,
    ann_search, result_json, image_json, suggestions, suggestions_fallback, pending_embeddings,
    pending_all, pending_retry, pending_attempts, embed_outcomes, embed_counts, index_newest, insert_embeddings, embed_texts,
    image_files, catalogue_lookups, orphans, duplicate_keys, null_violations, cascade_delete,
    taxonomy_backfill, conform_schema, conform_details)}
QUERIES |= {f"hybrid_{mode}": _sorted_search(mode)
            for mode in ("relevance", "price_asc", "price_desc", "title", "newest")}
