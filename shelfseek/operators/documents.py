"""Search documents: latest detail per product, full build, sync, upsert, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfseek.functions.text import fold
from shelfseek.operators.joins import are_small, lookup_join


def _latest(rows: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("product_id").orderBy(*order, F.col("id").asc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_details(details: DataFrame) -> DataFrame:
    """The newest detail row of each product; undated rows come last."""
    return _latest(details, [F.col("scraped_at").desc_nulls_last(),
                             F.col("created_at").desc_nulls_last()])


def latest_scrapes(results: DataFrame) -> DataFrame:
    return _latest(results, [F.col("scraped_at").desc_nulls_last()])


def _filled(first: str, second: str) -> Column:
    return F.coalesce(F.nullif(F.col(first), F.lit("")), F.col(second))


def build_documents(products: DataFrame, details: DataFrame, categories: DataFrame,
                    subcategories: DataFrame, leaf_categories: DataFrame) -> DataFrame:
    """One search document per product.

    ``products`` and ``details`` meet on the product id, which is also the
    window's key, so both use one shuffle. Taxonomy sides are broadcast when
    measured small and joined on salted keys otherwise, as one category may
    hold a large share of the products.
    """
    latest = latest_details(details).select(
        F.col("product_id").alias("id"), "product_title", "supplier_name", "original_price",
        "original_price_usd", "promotional_price", "promotional_price_usd", "price_text",
        F.coalesce("scraped_at", "created_at").alias("detail_at"))
    category = categories.select(F.col("uuid").alias("category_id"),
                                 F.col("uuid").alias("known_category_id"),
                                 "category_title", F.col("slug").alias("category_slug"))
    sub = subcategories.select(F.col("uuid").alias("subcategory_id"),
                               F.col("sub_category_title").alias("subcategory_title"),
                               F.col("sub_category_slug").alias("subcategory_slug"))
    leaf = leaf_categories.select(F.col("id").alias("leaf_category_id"), "leaf_category_title",
                                  F.col("leaf_category_slug").alias("own_leaf_slug"),
                                  F.col("slug").alias("plain_leaf_slug"))
    rows = products.join(latest, "id", "left")
    levels = {"category_id": category, "subcategory_id": sub, "leaf_category_id": leaf}
    for (key, level), small in zip(levels.items(), are_small(*levels.values())):
        rows = lookup_join(rows, level, [key], "left", ["id"], small)
    searchable = F.concat_ws(
        " ", "id", "title", "product_title", "company", "supplier_name", "category_title",
        "category_slug", "subcategory_title", "subcategory_slug", "leaf_category_title",
        "own_leaf_slug", "price_text")
    return rows.select(
        F.col("id").alias("product_id"),
        _filled("title", "product_title").alias("title"),
        "product_url", "image_url",
        _filled("company", "supplier_name").alias("company"),
        F.col("known_category_id").alias("category_id"),
        "category_title", "category_slug", "subcategory_title", "subcategory_slug",
        "leaf_category_title",
        F.coalesce("own_leaf_slug", "plain_leaf_slug").alias("leaf_category_slug"),
        F.coalesce("original_price", "promotional_price").alias("original_price"),
        F.coalesce("promotional_price_usd", "original_price_usd", "promotional_price",
                   "original_price").alias("sortable_price"),
        F.lower(fold(searchable)).alias("search_text"),
        F.greatest(F.coalesce("updated_at", "created_at"), F.col("detail_at")).alias("updated_at"),
        # An empty product title hides the detail title here, unlike in ``title``.
        F.coalesce("title", "product_title", F.lit("")).alias("lexical_title"),
        F.coalesce("company", "supplier_name", F.lit("")).alias("lexical_company"))


def documents_for(ids: DataFrame, products: DataFrame, details: DataFrame, *taxonomy: DataFrame
                  ) -> DataFrame:
    """Documents of chosen products; details of few ids shrink to these before the window.

    Ids measured small are broadcast. Many are met by the products alone: the details would all have to be
    shuffled to meet them, while the window leaves one row of a product in each task before it shuffles.
    """
    wanted = ids.select("product_id").distinct()
    few = products.join(wanted.withColumnRenamed("product_id", "id"), "id", "left_semi")
    if are_small(wanted)[0]:
        details = lookup_join(details, wanted, ["product_id"], "left_semi", ["id"], True)
    return build_documents(few, details, *taxonomy)


def sync_status(ids: DataFrame, products: DataFrame) -> DataFrame:
    """``indexed`` or ``missing`` for each id asked for."""
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_known"))
    return (ids.select("product_id").distinct().join(known, "product_id", "left")
            .select("product_id",
                    F.when(F.col("_known"), "indexed").otherwise("missing").alias("status")))


UUID_PATTERN = "^[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}$"


def split_ids(ids: DataFrame, pattern: str = UUID_PATTERN) -> tuple[DataFrame, DataFrame]:
    """Well-formed ids, and rejected ids with an error text."""
    fits = F.coalesce(F.col("product_id").rlike(pattern), F.lit(False))
    rejected = ids.filter(~fits).withColumn(
        "error", F.concat(F.lit("not a valid id: "), F.coalesce("product_id", F.lit("NULL"))))
    return ids.filter(fits), rejected


def upserted(stored: DataFrame, changed: DataFrame, key: str = "product_id") -> DataFrame:
    """Stored rows with changed ones put in their place."""
    # Of distinct keys alone Spark leaves out the outer joins that only fill other columns.
    kept = stored.join(changed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changed.select(*stored.columns))


def without(stored: DataFrame, ids: DataFrame, key: str = "product_id") -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def inserted_if_absent(stored: DataFrame, incoming: DataFrame, key: str = "product_id",
                       order: list[Column] | None = None) -> DataFrame:
    """Incoming rows whose key is not stored; the first of several wins."""
    w = Window.partitionBy(key).orderBy(*(order or [F.col("created_at").asc_nulls_last(),
                                                    F.col("id").asc()]))
    first = incoming.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first.join(stored.select(key), key, "left_anti").select(*incoming.columns)
