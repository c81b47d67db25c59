"""Similar products: exact or clustered nearest neighbours with totals and pages."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from shelfseek.functions import ladders
from shelfseek.operators import vector
from shelfseek.operators.joins import local_table, lookup_join


def paged(queries: DataFrame, threshold: float = vector.SIMILARITY_THRESHOLD) -> DataFrame:
    """Image queries (q_id, q_embedding, page, per_page, limit, threshold) with defaults filled."""
    asked = F.coalesce("per_page", "limit")
    size = F.when(asked > 0, F.least(asked, F.lit(vector.MAX_PER_PAGE))).otherwise(
        vector.DEFAULT_PER_PAGE)
    page = F.when(F.col("page") > 0, F.col("page")).otherwise(1)
    return queries.select(
        "q_id", "q_embedding", page.cast("int").alias("page"), size.cast("int").alias("per_page"),
        F.coalesce("threshold", F.lit(threshold)).alias("threshold"),
        (page * size).cast("int").alias("depth"))


def _with_pictures(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    pictured = docs.filter(F.col("image_url").isNotNull()).select("product_id", "updated_at")
    extra = [c for c in ("list_no",) if c in embeddings.columns]
    return embeddings.select("product_id", "embedding", *extra).join(pictured, "product_id")


def similar_products(queries: DataFrame, docs: DataFrame, embeddings: DataFrame,
                     lists: DataFrame | None = None,
                     threshold: float = vector.SIMILARITY_THRESHOLD) -> DataFrame:
    """The asked page of products at least ``threshold`` similar, nearest first.

    One pass over the vectors gives both the page and the total of all hits.
    With ``lists`` (q_id, list_no) only those clusters are probed, see ``operators.clusters``.
    """
    asked = paged(queries, threshold)
    table = local_table(asked, vector.MAX_QUERY_BLOCK)
    if table is None:
        deepest = asked.agg(F.max("depth")).first()[0] or 0
    else:
        deepest = pc.max(table["depth"]).as_py() or 0
        asked = asked.sparkSession.createDataFrame(table, schema=asked.schema)
    found = vector.scan(_with_pictures(docs, embeddings), asked if table is None else table, lists)
    ranked = vector.ranked_hits(found, deepest)
    rows = lookup_join(ranked, asked.select("q_id", "page", "per_page"), ["q_id"], "inner",
                       ["product_id"], table is not None)
    skipped = (F.col("page") - 1) * F.col("per_page")
    page = rows.filter((F.col("rank") > skipped) & (F.col("rank") <= skipped + F.col("per_page")))
    shown = docs.select("product_id", "title", "product_url", "image_url", "company",
                        "category_id", "category_title", "category_slug", "original_price")
    return (page.join(shown, "product_id")
            .select("q_id", "rank", *shown.columns, F.col("similarity").alias("score"),
                    ladders.display_similarity(F.col("similarity")).alias("similarity"),
                    F.lit("image").alias("match_type"), F.col("title").alias("highlight"),
                    F.array(F.lit("image"), F.lit("semantic")).alias("matched_fields"),
                    "total", (F.col("total") > skipped + F.col("per_page")).alias("has_more")))


def similar_totals(queries: DataFrame, docs: DataFrame, embeddings: DataFrame,
                   threshold: float = vector.SIMILARITY_THRESHOLD) -> DataFrame:
    """Total and last page of every query, also of those without a hit."""
    asked = paged(queries, threshold)
    found = vector.scan(_with_pictures(docs, embeddings), asked.withColumn("depth", F.lit(1)))
    counted = found.groupBy("q_id").agg(F.sum("hits").alias("total"))
    total = F.coalesce("total", F.lit(0))
    return (asked.join(counted, "q_id", "left")
            .select("q_id", total.alias("total"),
                    F.ceil(total / F.col("per_page")).alias("last_page"), "page", "per_page"))
