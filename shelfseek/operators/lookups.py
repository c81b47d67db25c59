"""Keyed look-ups of the catalogue, for a frame of keys at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfseek.operators.joins import lookup_join


def by_id(ids: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, image_url, found) for each id asked for; unknown ids are kept."""
    known = products.select(F.col("id").alias("product_id"), "image_url", F.lit(True).alias("found"))
    return ids.select("product_id").distinct().join(known, "product_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def with_details_and_image(products: DataFrame, details: DataFrame) -> DataFrame:
    """Products with a picture whose details were scraped."""
    scraped = details.filter("success").select(F.col("product_id").alias("id")).distinct()
    return products.filter(F.col("image_url").isNotNull()).join(scraped, "id", "left_semi")


def ids_by(keys: DataFrame, products: DataFrame, column: str) -> DataFrame:
    """(key, product_id) of products whose ``column`` equals one of the keys."""
    rows = products.select(F.col(column).alias("key"), F.col("id").alias("product_id"))
    return lookup_join(rows, keys.select("key").distinct(), ["key"], "inner", ["product_id"])
