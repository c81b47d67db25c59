"""Bring older tables to the current layout, and fill taxonomy titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfseek import schema
from shelfseek.functions.text import title_from_slug


def conform(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Rename, drop, add and cast columns so that ``df`` has the layout of ``table``.

    Values that do not fit their type become NULL. Columns with a default are
    filled where missing or NULL.
    """
    now = F.current_timestamp() if now is None else now
    for old, new in schema.RENAMES.get(table, {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.drop(*schema.DROPPED.get(table, []))
    constants = {c: F.lit(v) for c, v in schema.DEFAULTS.get(table, {}).items()}
    defaults = {**constants, **{c: now for c in schema.NOW_DEFAULTS.get(table, [])}}
    columns = []
    for field in schema.struct_type(table):
        value = (F.col(field.name).try_cast(field.dataType) if field.name in df.columns
                 else F.lit(None).cast(field.dataType))
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name].cast(field.dataType))
        columns.append(value.alias(field.name))
    known = {f.name for f in schema.struct_type(table)}
    return df.select(*columns, *[c for c in df.columns if c not in known])


def backfill_categories(categories: DataFrame) -> DataFrame:
    return categories.withColumn("category_title", F.coalesce(
        "category_title", title_from_slug(F.col("slug"))))


def backfill_subcategories(subcategories: DataFrame) -> DataFrame:
    return subcategories.withColumn("sub_category_title", F.coalesce(
        "sub_category_title", title_from_slug(F.col("sub_category_slug"))))


def backfill_leaf_categories(leaf_categories: DataFrame) -> DataFrame:
    slugged = leaf_categories.withColumn("leaf_category_slug", F.coalesce(
        "leaf_category_slug", "slug"))
    return slugged.withColumn("leaf_category_title", F.coalesce(
        "leaf_category_title", title_from_slug(F.col("leaf_category_slug"))))
