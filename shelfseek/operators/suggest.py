"""Prefix suggestions from titles, companies and the three category levels."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, functions as F

from shelfseek.functions import text
from shelfseek.operators.joins import localize, lookup_join, top_k

# Most suggestions, and the shortest prefix that gives any.
MAX_SUGGESTIONS = 8
MIN_PREFIX_CHARS = 2

# Fixed values: (text, further key that may match, priority).
SOURCES = [("title", None, 1), ("company", None, 2), ("category_title", "category_slug", 3),
           ("subcategory_title", "subcategory_slug", 4),
           ("leaf_category_title", "leaf_category_slug", 5)]


#: Up to so many prefixes are named as ranges of the key in the scan of stored offers.
MAX_PUSHED_PREFIXES = 200


def suggestion_offers(docs: DataFrame, distinct: bool = True) -> DataFrame:
    """(suggestion, priority, key): what may be suggested, and the text that a prefix must begin.

    Each once, or once for every document that makes it.
    """
    offers = []
    for name, other, priority in SOURCES:
        for key in filter(None, (name, other)):
            offers.append(F.struct(F.col(name).alias("suggestion"),
                                   F.lit(priority).alias("priority"),
                                   F.lower(F.col(key)).alias("key")))
    known = F.filter(F.array(*offers), lambda o: (o["suggestion"] != "") & o["key"].isNotNull())
    if not distinct:
        known = F.array_distinct(known)
    rows = docs.select(F.inline(known))
    return rows.distinct() if distinct else rows


def suggest(prefixes: DataFrame, offers: DataFrame, min_chars: int = MIN_PREFIX_CHARS) -> DataFrame:
    """(q_id, rank, suggestion, priority) for prefixes (q_id, raw, limit) among ``suggestion_offers``.

    Stored offers are sorted by key, and a few prefixes read only their ranges.
    Every offer comes under the prefixes of the lengths asked for.
    """
    asked = prefixes.select(
        "q_id", text.normalize_query(F.col("raw")).alias("prefix"),
        F.when(F.col("limit") > 0, F.least("limit", F.lit(MAX_SUGGESTIONS)))
        .otherwise(MAX_SUGGESTIONS).alias("wanted")).filter(F.length("prefix") >= min_chars)
    local = localize(asked)
    asked = asked if local is None else local
    lengths = [r[0] for r in asked.select(F.length("prefix")).distinct().collect()]
    if local is not None:
        named = [r[0] for r in local.select("prefix").distinct().limit(MAX_PUSHED_PREFIXES + 1).collect()]
        if 0 < len(named) <= MAX_PUSHED_PREFIXES:
            offers = offers.filter(functools.reduce(operator.or_, [F.col("key").startswith(p) for p in named]))
    wanted = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    offered = offers.select(
        "suggestion", "priority",
        F.explode(F.transform(F.filter(wanted, lambda n: n <= F.length("key")),
                              lambda n: F.substring("key", F.lit(1), n))).alias("prefix"))
    hits = lookup_join(offered, asked, ["prefix"], "inner", ["suggestion"], local is not None)
    distinct = hits.select("q_id", "suggestion", "priority", "wanted").distinct()
    best = top_k(distinct, ["q_id"],
                 [F.col("priority"), F.length("suggestion"), F.col("suggestion")],
                 MAX_SUGGESTIONS, ["suggestion"])
    return best.filter(F.col("rank") <= F.col("wanted")).select(
        "q_id", "rank", "suggestion", "priority")


def fallback_suggestions(normalized: DataFrame, results: DataFrame, offers: DataFrame) -> DataFrame:
    """Suggestions for searches whose page came out empty."""
    empty = (normalized.filter(~F.col("blank"))
             .join(results.select("q_id").distinct(), "q_id", "left_anti")
             .select("q_id", F.col("normalized").alias("raw"), F.lit(None).cast("int").alias("limit")))
    return suggest(empty, offers, min_chars=1)
