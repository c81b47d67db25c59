"""Field values of documents by hash: the documents that hold a value or have a title that a text begins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfseek.operators.filters import QueryBatch, document_terms, passes_filters
from shelfseek.operators.joins import rank_parts

FIELDS = ["id", "title", "company", "category", "category_slug", "subcategory", "subcategory_slug",
          "leaf_category", "leaf_category_slug"]
#: The field name of rows that stand for the beginning of a title.
TITLE_PREFIX = "title_prefix"
#: Up to so many keys are named one by one in a scan; the file reader knows only the range of a longer list.
MAX_PUSHED_KEYS = 200
HIT_COLUMNS = ["product_id", "updated_at", "sortable_price", "company_lower", "category_keys"]


def prefix_length(text: str) -> str:
    """SQL of the largest power of two that is no more than the length of a text that is not empty."""
    return f"shiftleft(1, length(bin(length({text}))) - 1)"


def field_values(docs: DataFrame, fold_accents: bool = False) -> DataFrame:
    """(value_key, field, ``HIT_COLUMNS``, title_lower): each field that is not empty, keyed by the MD5 of its value.

    A title comes once more under each of its beginnings of 1, 2, 4, 8 ... characters; only those rows carry the
    title, which confirms what lies between two lengths. What filters and ties need is carried along, so that
    candidates are found without the documents.
    """
    whole = ", ".join(f"named_struct('field', '{name}', 'value', {name}_lower, 'title_lower', cast(null as string))"
                      for name in FIELDS)
    begun = (f"transform(sequence(0, length(bin(length(title_lower))) - 1), j -> named_struct('field', '{TITLE_PREFIX}', "
             "'value', substring(title_lower, 1, shiftleft(1, j)), 'title_lower', title_lower))")
    rows = document_terms(docs, fold_accents).selectExpr(
        *[c for c in HIT_COLUMNS], f"inline(filter(concat(array({whole}), {begun}), f -> f.value <> '')) "
        "as (field, value, title_lower)")
    return rows.select(F.md5("value").alias("value_key"), "field", *HIT_COLUMNS, "title_lower")


def named(column: str, keys: list[str]) -> Column:
    """Whether a column is one of ``keys``, in the form that prunes most of a sorted table."""
    if 0 < len(keys) <= MAX_PUSHED_KEYS:
        return reduce(or_, [F.col(column) == k for k in keys])
    return F.col(column).isin(keys)


def only_filtered(values: DataFrame, batch: QueryBatch) -> DataFrame:
    """The rows that pass the filter which all queries of a batch share, if they do."""
    if batch.one_filter is None:
        return values
    category, shop, low, high = batch.one_filter
    tests = [(category, lambda v: F.array_contains("category_keys", F.lit(v))),
             (shop, lambda v: F.col("company_lower") == v), (low, lambda v: F.col("sortable_price") >= v),
             (high, lambda v: F.col("sortable_price") <= v)]
    return reduce(DataFrame.filter, [test(v) for v, test in tests if v is not None], values)


def candidate_order(score: str = "score"):
    return [F.col(score).desc(), F.col("updated_at").desc_nulls_last(), F.col("product_id").asc()]


def best_documents(hits: DataFrame, batch: QueryBatch) -> DataFrame:
    """(q_id, product_id, score) from hits of single fields: the best one per document, first ``depth`` per query.

    A document among the first by its best field is among the first of that field, so each field's hits are cut
    to the first in every part before they meet: a value that a third of all documents hold moves few rows.
    """
    rows = hits.filter(passes_filters()).select("q_id", "field", "product_id", "updated_at", "depth", "score")
    part = F.pmod(F.xxhash64("product_id"), F.lit(rank_parts(hits)))
    cut = Window.partitionBy("q_id", "field", part).orderBy(*candidate_order())
    first = rows.withColumn("rank", F.row_number().over(cut)).filter(F.col("rank") <= batch.max_depth)
    best = first.groupBy("q_id", "product_id").agg(
        F.max("score").alias("score"), F.max("updated_at").alias("updated_at"), F.max("depth").alias("depth"))
    whole = Window.partitionBy("q_id").orderBy(*candidate_order())
    return (best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= F.col("depth"))
            .select("q_id", "product_id", "score"))
