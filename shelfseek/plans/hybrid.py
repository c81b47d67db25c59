"""Hybrid search: four candidate sources fused into one ranked page per query."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from shelfseek.functions import ladders
from shelfseek.functions.text import normalize_query
from shelfseek.operators.embed import Encoder, embed_texts
from shelfseek.operators.exact import exact_candidates
from shelfseek.operators.filters import QueryBatch, normalize_queries, query_batch
from shelfseek.operators.joins import lookup_join
from shelfseek.operators.lexical import lexical_candidates, postings
from shelfseek.operators.suggest import suggestion_offers
from shelfseek.operators.trigram import trigram_candidates, trigram_index
from shelfseek.operators.values import field_values
from shelfseek.operators.vector import semantic_candidates
from shelfseek.sources.tables import stored

SCORES = ["exact_score", "lexical_score", "trigram_score", "semantic_score"]
RESULT_COLUMNS = ["q_id", "rank", "product_id", "title", "product_url", "image_url", "company",
                  "category_id", "category_title", "category_slug", "original_price",
                  "sortable_price", "updated_at", *SCORES, "final_score", "match_type",
                  "highlight", "matched_fields", "total", "has_more"]


@dataclass
class SearchIndex:
    """The tables a search reads. All but the first two may be stored or cut on the fly."""
    documents: DataFrame
    embeddings: DataFrame
    postings: DataFrame
    trigrams: DataFrame
    offers: DataFrame
    values: DataFrame

    @staticmethod
    def over(documents: DataFrame, embeddings: DataFrame, fold_accents: bool = False
             ) -> SearchIndex:
        return SearchIndex(documents, embeddings, postings(documents),
                           trigram_index(documents, fold_accents), suggestion_offers(documents),
                           field_values(documents, fold_accents))


def candidates(batch: QueryBatch, index: SearchIndex) -> DataFrame:
    """Scores of all sources merged to one row per (q_id, product_id)."""
    docs = index.documents
    sources = [
        lambda: exact_candidates(batch, index.values),
        lambda: lexical_candidates(batch, index.postings, docs),
        lambda: trigram_candidates(batch, index.trigrams, index.values),
        lambda: semantic_candidates(batch, docs, index.embeddings),
    ]
    # Sources look at small intermediate results while they are planned; side by side.
    with ThreadPoolExecutor(len(sources)) as pool:
        sources = list(pool.map(lambda source: source(), sources))
    merged = None
    for name, rows in zip(SCORES, sources):
        filled = rows.select("q_id", "product_id", *[
            F.col("score").alias(s) if s == name else F.lit(0.0).alias(s) for s in SCORES])
        merged = filled if merged is None else merged.unionByName(filled)
    return merged.groupBy("q_id", "product_id").agg(*[F.max(s).alias(s) for s in SCORES])


def score(batch: QueryBatch, merged: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with their documents, match type, final score and report columns."""
    rows = merged.join(docs, "product_id")
    about = batch.frame.select("q_id", "normalized", "threshold", "sort", "page", "size")
    rows = lookup_join(rows, about, ["q_id"], "inner", ["product_id"], batch.small)
    return rows.withColumns({
        "match_type": ladders.match_type(), "final_score": ladders.final_score(),
        "highlight": ladders.highlight(), "matched_fields": ladders.matched_fields()})


def sort_order():
    """Sort keys of every mode; an unknown mode falls through to relevance."""
    def when(mode, column):
        return F.when(F.col("sort") == mode, column)

    return [when("price_asc", F.col("sortable_price")).asc_nulls_last(),
            when("price_desc", F.col("sortable_price")).desc_nulls_last(),
            when("title", F.lower("title")).asc_nulls_last(),
            when("newest", F.col("updated_at")).desc_nulls_last(),
            F.col("final_score").desc(), F.col("updated_at").desc_nulls_last(),
            F.col("product_id").asc()]


def page_of(scored: DataFrame) -> DataFrame:
    """The asked page of each query, ranks over all candidates, and the true total.

    A query has at most three times ``depth`` plus ``vector_depth`` candidates,
    so one window partition per query stays small.
    """
    whole = Window.partitionBy("q_id")
    ranked = (scored.withColumn("rank", F.row_number().over(whole.orderBy(*sort_order())))
              .withColumn("total", F.count("*").over(whole)))
    skipped = F.col("page") * F.col("size")
    end = skipped + F.col("size")
    return (ranked.filter((F.col("rank") > skipped) & (F.col("rank") <= end))
            .withColumn("has_more", F.col("total") > end)
            .select(*RESULT_COLUMNS))


def hybrid_search(queries: DataFrame, index: SearchIndex, fold_accents: bool = False) -> DataFrame:
    """Result rows of every query's page. ``queries`` has the columns of ``QUERY_DDL``."""
    batch = query_batch(normalize_queries(queries, fold_accents=fold_accents), fold_accents)
    return page_of(score(batch, candidates(batch, index), index.documents))


def with_embeddings(queries: DataFrame, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """Queries with the vector of their normalised text as ``q_embedding``; NULL where the encoder fails.

    Each distinct text is encoded once, in the workers. A failure costs its own
    text the semantic part of the search and nothing else.
    """
    texts = queries.drop("q_embedding").withColumn("normalized_text", normalize_query(F.col("raw")))
    # Texts are tiny and their work is not, so tasks are not merged by bytes.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = texts.select("normalized_text").filter("normalized_text <> ''").distinct()
    done = embed_texts(distinct.repartition(tasks, "normalized_text"), make_encoder, "normalized_text")
    vectors = done.select("normalized_text", F.col("embedding").alias("q_embedding"))
    return texts.join(vectors, "normalized_text", "left").drop("normalized_text")


def encoded_search(queries: DataFrame, index: SearchIndex, make_encoder: Callable[[], Encoder],
                   fold_accents: bool = False) -> DataFrame:
    """``hybrid_search`` of queries that bring no vectors: normalised, encoded and searched in one plan.

    The vectors are written once, as the sources of candidates read the batch several times.
    """
    return hybrid_search(stored(with_embeddings(queries, make_encoder), "queries"), index, fold_accents)
