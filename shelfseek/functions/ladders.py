"""Scores, labels and report columns of a search result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What each kind of exact hit is worth.
SCORE_ID = 1.0
SCORE_TITLE = 0.92
SCORE_TITLE_PREFIX = 0.75
SCORE_COMPANY = 0.60
SCORE_CATEGORY = 0.55
SCORE_SUBCATEGORY = 0.50
SCORE_LEAF = 0.48

# Trigram weight by field.
TRIGRAM_WEIGHTS = {"title": 1.0, "company": 0.75, "category": 0.70, "subcategory": 0.62,
                   "leaf_category": 0.60}

# Share of each source in the final score.
SHARE_EXACT, SHARE_LEXICAL, SHARE_TRIGRAM, SHARE_SEMANTIC = 0.38, 0.32, 0.12, 0.18
LEXICAL_GAIN = 3.0

# Display bands.
BAND_HIGH, BAND_MIDDLE = 0.8, 0.6

# Scores are rounded so that tied documents stay tied whatever order sums ran in.
SCORE_DECIMALS = 9


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)


def final_score() -> Column:
    return rounded(F.expr(f"""
        exact_score * {SHARE_EXACT}D
        + least(1D, lexical_score * {LEXICAL_GAIN}D) * {SHARE_LEXICAL}D
        + least(1D, trigram_score) * {SHARE_TRIGRAM}D
        + least(1D, greatest(0D, semantic_score)) * {SHARE_SEMANTIC}D"""))


# Fixed values of the next three: the labels and the order in which they are tried.
def match_type() -> Column:
    """Why a document was found, from the scores, ``normalized`` and ``threshold``."""
    return F.expr("""case
        when lower(product_id) = normalized then 'exact_id'
        when lower(title) = normalized then 'exact_title'
        when startswith(lower(title), normalized) then 'prefix_title'
        when exact_score > 0 then 'exact_attribute'
        when lexical_score > 0 and semantic_score > 0 then 'hybrid'
        when semantic_score > 0 then 'semantic'
        when trigram_score >= threshold then 'fuzzy'
        when lexical_score > 0 then 'full_text'
        else 'related' end""")


def highlight() -> Column:
    return F.expr("""case
        when lower(product_id) = normalized then concat(title, ' | ', product_id)
        when contains(lower(company), normalized) then concat(title, ' | ', company)
        when contains(lower(category_title), normalized) then concat(title, ' | ', category_title)
        else title end""")


def matched_fields() -> Column:
    """Names of the fields that hold the query; just the title where none does."""
    return F.expr("""transform(array(array_compact(array(
        if(lower(product_id) = normalized, 'id', null),
        if(contains(lower(title), normalized), 'title', null),
        if(contains(lower(company), normalized), 'company', null),
        if(contains(lower(category_title), normalized), 'category', null),
        if(semantic_score > 0, 'semantic', null)))),
        found -> if(size(found) = 0, array('title'), found))[0]""")


def category_summary() -> Column:
    """Nested category, NULL where nothing is known about it."""
    known = F.coalesce("category_id", "category_title", "category_slug").isNotNull()
    return F.when(known, F.struct(F.col("category_id").alias("id"),
                                  F.col("category_title").alias("title"),
                                  F.col("category_slug").alias("slug")))


def display_similarity(score: Column) -> Column:
    """Four decimals, halves rounded up."""
    return F.floor(score * 10000 + 0.5) / 10000


def similarity_band(score: Column) -> Column:
    return (F.when(score >= BAND_HIGH, "high").when(score >= BAND_MIDDLE, "mid")
            .otherwise("low"))


def similarity_percent(score: Column) -> Column:
    return F.round(score * 100, 1)
