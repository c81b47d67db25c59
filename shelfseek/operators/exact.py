"""Exact candidates: documents with a field equal to the query, or a title it begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfseek.functions import ladders
from shelfseek.operators.filters import FILTERS, QueryBatch
from shelfseek.operators.joins import lookup_join
from shelfseek.operators.values import (MAX_PUSHED_KEYS, TITLE_PREFIX, best_documents, named, only_filtered,
                                        prefix_length)

FIELD_SCORES = {
    "id": ladders.SCORE_ID, "title": ladders.SCORE_TITLE, TITLE_PREFIX: ladders.SCORE_TITLE_PREFIX,
    "company": ladders.SCORE_COMPANY, "category": ladders.SCORE_CATEGORY, "category_slug": ladders.SCORE_CATEGORY,
    "subcategory": ladders.SCORE_SUBCATEGORY, "subcategory_slug": ladders.SCORE_SUBCATEGORY,
    "leaf_category": ladders.SCORE_LEAF, "leaf_category_slug": ladders.SCORE_LEAF}


def exact_candidates(batch: QueryBatch, values: DataFrame) -> DataFrame:
    """(q_id, product_id, score): best exact hit per document, first ``depth`` per query, from ``field_values``.

    A query looks up itself, and for titles that it begins its own longest beginning of a power of two
    characters, which is confirmed by the title. Few queries name their keys to the scan of the sorted table.
    """
    lookups = (f"inline(array(named_struct('value', normalized, 'begins', false), named_struct("
               f"'value', substring(normalized, 1, {prefix_length('normalized')}), 'begins', true)))")
    asked = batch.frame.selectExpr("q_id", "depth", *FILTERS, "normalized", f"{lookups} as (value, begins)")
    asked = asked.withColumn("value_key", F.md5("value")).drop("value")
    values = only_filtered(values, batch)
    if batch.small and batch.table.num_rows * 2 <= MAX_PUSHED_KEYS:
        values = values.filter(named("value_key", sorted({r[0] for r in asked.select("value_key").collect()})))
    met = lookup_join(values, asked, ["value_key"], "inner", ["product_id"], batch.small)
    hits = met.filter(F.expr(f"if(field = '{TITLE_PREFIX}', begins and startswith(title_lower, normalized), not begins)"))
    score = F.expr("case field " + " ".join(f"when '{f}' then {s}D" for f, s in FIELD_SCORES.items()) + " end")
    return best_documents(hits.withColumn("score", score), batch)
