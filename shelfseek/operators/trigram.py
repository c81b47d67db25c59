"""Trigram candidates: similarity of the query to five fields, by an equi-join on trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfseek.functions import ladders
from shelfseek.functions.text import trigrams
from shelfseek.operators.filters import FILTERS, QueryBatch, document_terms
from shelfseek.operators.joins import local_table, localize, lookup_join, salted_join
from shelfseek.operators.values import best_documents, named, only_filtered
from shelfseek.sources.tables import stored

MAX_PUSHED_GRAMS = 2000
WEIGHTS = ladders.TRIGRAM_WEIGHTS
#: Slack of the bounds for sums that were rounded on their way.
SLACK = 1e-6


def _field_values():
    """One (field, value, value_key) per non-empty field of a document."""
    fields = ", ".join(f"named_struct('field', '{name}', 'value', {name}_lower, "
                       f"'value_key', md5({name}_lower))" for name in WEIGHTS)
    return F.expr(f"inline(filter(array({fields}), f -> f.value <> ''))")


def trigram_index(docs: DataFrame, fold_accents: bool = False) -> DataFrame:
    """(gram, field, value_key, n_grams): trigrams of each distinct field value.

    Values are made distinct first, so a category shared by a large part of
    the catalogue is cut up once.
    """
    values = (document_terms(docs, fold_accents).select(_field_values())
              .groupBy("field", "value_key").agg(F.first("value").alias("value"))
              .withColumn("grams", trigrams(F.col("value"))))
    return values.select("field", "value_key", F.size("grams").alias("n_grams"),
                         F.explode("grams").alias("gram"))


def _asked_grams(batch: QueryBatch, index: DataFrame) -> DataFrame:
    """(q_id, threshold, q_grams, gram, place): the grams of each query, those of the fewest values first."""
    asked = batch.frame.select("q_id", "threshold", F.size("grams").alias("q_grams"),
                               F.explode("grams").alias("gram"))
    held = index.groupBy("gram").agg(F.count("*").alias("n_values"))
    local = localize(held) if batch.small else None
    asked = asked.join(held, "gram", "left") if local is None else asked.join(F.broadcast(local), "gram", "left")
    rarest = Window.partitionBy("q_id").orderBy(F.coalesce("n_values", F.lit(0)), "gram")
    return asked.select("q_id", "threshold", "q_grams", "gram", F.row_number().over(rarest).alias("place"))


def _looked_up(weight: Column) -> Column:
    """How many of a query's grams must be looked up so that no value of a field with this weight is missed.

    A value as similar as asked shares at least that part of the query's grams, so not all that it shares can
    lie behind these.
    """
    least = F.ceil(F.col("threshold") / weight * F.col("q_grams") - SLACK)
    return F.col("q_grams") - F.greatest(least, F.lit(1)) + 1


def similar_pairs(batch: QueryBatch, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(q_id, field, value_key): pairs that share one of the query's rare grams and whose sizes allow the similarity."""
    met = lookup_join(index, asked.filter(F.col("place") <= _looked_up(F.lit(max(WEIGHTS.values())))), ["gram"], "inner",
                      ["value_key", "field"], batch.small)
    bound = F.least("n_grams", "q_grams") / F.greatest("n_grams", "q_grams") * _weight()
    return (met.filter((ladders.rounded(bound) >= F.col("threshold")) & (F.col("place") <= _looked_up(_weight())))
            .select("q_id", "field", "value_key").distinct())


def _weight() -> Column:
    return F.expr("case field " + " ".join(f"when '{name}' then {w}D" for name, w in WEIGHTS.items()) + " end")


def matching_values(batch: QueryBatch, index: DataFrame) -> DataFrame:
    """(q_id, field, value_key, score) of field values similar enough to the query.

    A query's rarest grams alone bring up pairs, sizes bound the similarity from above, and shared grams are
    counted for the pairs that are left. The lists of frequent grams are read, but never paired with a query.
    """
    if batch.small and len(batch.grams) <= MAX_PUSHED_GRAMS:
        index = index.filter(named("gram", batch.grams))
    asked = _asked_grams(batch, index)
    # A batch that is not small may still become so, and a small one's grams may be many.
    asked = (localize(asked) if batch.small else None) or stored(asked, "grams")
    pairs = stored(similar_pairs(batch, index, asked), "pairs")
    held = lookup_join(index, pairs, ["field", "value_key"], "inner", ["gram"])
    shared = (lookup_join(held, asked.drop("place"), ["q_id", "gram"], "inner", ["value_key", "field"], batch.small)
              .groupBy("q_id", "field", "value_key", "n_grams", "q_grams", "threshold")
              .agg(F.count("*").alias("shared")))
    similarity = F.col("shared") / (F.col("n_grams") + F.col("q_grams") - F.col("shared"))
    return (shared.withColumn("score", ladders.rounded(similarity * _weight()))
            .filter(F.col("score") >= F.col("threshold"))
            .select("q_id", "field", "value_key", "score"))


def trigram_candidates(batch: QueryBatch, index: DataFrame, values: DataFrame) -> DataFrame:
    """(q_id, product_id, score): best weighted field similarity, first ``depth`` per query.

    The greatest field decides, so a document passes exactly when one of its values does: values are matched
    first, once, and their documents looked up in ``field_values``.
    """
    matched = stored(matching_values(batch, index), "matched")
    table = local_table(matched)
    values = only_filtered(values, batch).drop("title_lower")
    if table is None:
        hits = salted_join(values, matched, ["field", "value_key"], "inner", ["product_id"])
    else:
        matched = matched.sparkSession.createDataFrame(table, schema=matched.schema)
        keys = sorted(set(table["value_key"].to_pylist()))
        hits = values.filter(named("value_key", keys)).join(F.broadcast(matched), ["field", "value_key"])
    about = batch.frame.select("q_id", "depth", *FILTERS)
    return best_documents(lookup_join(hits, about, ["q_id"], "inner", ["product_id"], batch.small), batch)
