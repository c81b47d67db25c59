"""Result pages as one JSON document per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfseek.functions import ladders

KEEP_NULLS = {"ignoreNullFields": "false"}


def _result(*extra):
    return F.struct(
        F.col("product_id").alias("id"), "title", F.col("product_url").alias("productUrl"),
        F.col("image_url").alias("imageUrl"), "company",
        F.col("original_price").alias("originalPrice"),
        ladders.category_summary().alias("category"), *extra)


def _pages(rows: DataFrame, result) -> DataFrame:
    """Results of each query in rank order, empty fields left out; a page is short."""
    listed = F.array_agg(F.struct("rank", F.to_json(result).alias("json")))
    return rows.groupBy("q_id").agg(
        F.transform(F.array_sort(listed), lambda r: r["json"]).alias("results"),
        F.max("total").alias("total"), F.max("has_more").alias("has_more"))


def text_response(normalized: DataFrame, results: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(q_id, body) for every query, also for blank ones and those without a hit."""
    tips = suggestions.groupBy("q_id").agg(F.array_sort(F.array_agg(F.struct(
        "rank", "suggestion"))).alias("tips"))
    rows = (normalized.join(_pages(results, _result()), "q_id", "left")
            .join(tips, "q_id", "left"))
    none = F.array().cast("array<string>")
    head = F.to_json(F.struct(
        F.col("raw").alias("query"),
        F.when(F.col("blank"), "").otherwise(F.col("normalized")).alias("normalizedQuery"),
        "page", "size", F.coalesce("total", F.lit(0)).alias("totalResults"),
        F.coalesce("has_more", F.lit(False)).alias("hasMore"),
        F.coalesce(F.transform("tips", lambda t: t["suggestion"]), none).alias("suggestions")),
        KEEP_NULLS)
    return rows.select("q_id", _with_list(head, "results").alias("body"))


def image_response(asked: DataFrame, totals: DataFrame, results: DataFrame) -> DataFrame:
    """(q_id, body) for every image query. ``totals`` as of ``similar_totals``."""
    rows = asked.select("q_id").join(totals, "q_id").join(
        _pages(results, _result("similarity")).drop("total"), "q_id", "left")
    payload = F.to_json(F.struct(
        "total", F.col("page").alias("currentPage"), F.col("per_page").alias("perPage"),
        F.col("last_page").alias("lastPage")))
    head = F.to_json(F.struct(
        F.lit(True).alias("success"), F.lit(200).alias("code"),
        F.lit("Successful").alias("message"), F.lit(None).cast("string").alias("error")),
        KEEP_NULLS)
    body = _append(head, F.concat(F.lit('"payload":'), _with_list(payload, "data", "results")))
    return rows.select("q_id", body.alias("body"))


def _append(json, member):
    """A JSON object with one more member at its end."""
    return F.concat(F.left(json, F.length(json) - 1), F.lit(","), member, F.lit("}"))


def _with_list(json, name, column="results"):
    listed = F.array_join(F.coalesce(F.col(column), F.array().cast("array<string>")), ",")
    return _append(json, F.concat(F.lit(f'"{name}":['), listed, F.lit("]")))
