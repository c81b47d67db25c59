"""Maintenance jobs: rebuild and sync of documents, embedding of pending products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelfseek.operators import documents, embed
from shelfseek.plans import segments
from shelfseek.sources.tables import stored


def rebuild_documents(root: str, embeddings: DataFrame, buckets: int, products: DataFrame,
                      details: DataFrame, *taxonomy: DataFrame) -> int:
    """Build all documents and publish them as the next version of the index; returns how many there are.

    Readers keep the version they opened.
    """
    segments.create(root, documents.build_documents(products, details, *taxonomy), embeddings, buckets)
    return segments.segments_of(products.sparkSession, root)[0].documents


def sync_documents(root: str, ids: DataFrame, products: DataFrame, details: DataFrame,
                   *taxonomy: DataFrame, pattern: str = documents.UUID_PATTERN) -> DataFrame:
    """Recompute chosen documents in the index; (product_id, status) with malformed ids ``rejected``."""
    good, bad = documents.split_ids(ids, pattern)
    segments.change(ids.sparkSession, root,
                    documents=documents.documents_for(good, products, details, *taxonomy))
    rejected = bad.select("product_id", F.lit("rejected").alias("status"))
    return documents.sync_status(good, products).unionByName(rejected)


def index_pending(products: DataFrame, embeddings: DataFrame, fetch: embed.Fetcher,
                  make_encoder: Callable[[], embed.Encoder], limit: int | None = None,
                  ids: DataFrame | None = None) -> DataFrame:
    """Embed chosen products, the newest ``limit`` pending ones, or all pending ones.

    Returns the outcomes, written once, so that each picture is fetched once
    however often they are read. All pending products are one distributed
    pass; failures become outcomes and end nothing early.
    """
    if ids is None:
        waiting = embed.pending(products, embeddings)
        waiting = waiting if limit is None else embed.newest(waiting, limit)
        ids = waiting.select(F.col("id").alias("product_id"))
    return stored(embed.index_products(ids, products, embeddings, fetch, make_encoder), "outcomes")


def store_outcomes(outcomes: DataFrame, embeddings: DataFrame, embeddings_path: str,
                   status_path: str, now: Column, next_retry_at: Column) -> dict[str, int]:
    """Append new embeddings and retry rows; returns the number of outcomes by status.

    Products that got an embedding in the meantime keep it.
    """
    fresh = embed.new_embeddings(outcomes, now)
    documents.inserted_if_absent(embeddings, fresh).write.mode("append").parquet(embeddings_path)
    embed.retry_rows(outcomes, next_retry_at, now).write.mode("append").parquet(status_path)
    return {r["status"]: r["n"] for r in embed.outcome_counts(outcomes).collect()}
