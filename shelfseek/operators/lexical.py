"""Full-text candidates: postings, boolean match and cover-density rank."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shelfseek.functions import ladders
from shelfseek.functions.text import lexemes
from shelfseek.operators.filters import (FILTERS, QueryBatch, filtered_terms, passes_filters,
                                         with_every_query)
from shelfseek.operators.joins import local_table, localize, lookup_join, top_k
from shelfseek.operators.values import candidate_order

# The weight class of each field, and what a class is worth.
FIELD_CLASSES = [("lexical_title", "A"), ("lexical_company", "B"), ("category_title", "B"),
                 ("subcategory_title", "C"), ("leaf_category_title", "C")]
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

MAX_PUSHED_TERMS = 1000
# So many postings are read again without regret if their result is not small.
CHEAP_POSTINGS = 1_000_000


def postings(docs: DataFrame) -> DataFrame:
    """(product_id, term, pos, weight): every word of every field at its position.

    Positions run on from field to field.
    """
    def tagged_words(field, weight):
        return F.transform(lexemes(F.coalesce(F.col(field), F.lit(""))),
                           lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    tagged = [tagged_words(field, weight) for field, weight in FIELD_CLASSES]
    words = docs.select("product_id", F.posexplode(F.concat(*tagged)).alias("pos", "word"))
    return words.select("product_id", F.col("word.term").alias("term"),
                        (F.col("pos") + 1).alias("pos"), F.col("word.weight").alias("weight"))


def cover_density(hits: str, groups: str, n_terms: str, phrases: str) -> Column:
    """Cover-density rank of one document, scaled to r / (r + 1); NULL where nothing covers a group.

    ``hits`` are the query's term hits ``(pos, o, inv)`` in position order and
    ``groups`` the numbers of what each OR group needs: terms, and behind them
    ``phrases``, lists of term numbers that must stand side by side. One pass keeps the last hit
    of every term, and the first hit of the last place of every phrase. The start of the shortest cover that ends here is the
    earliest of a group's last hits, taken over the group that starts latest; a
    start that was seen before only gives a longer cover and is skipped.
    """
    none = "cast(null as struct<pos:int,n:int,cinv:double,inv:double>)"
    here = ("named_struct('pos', h.pos, 'n', s.n + 1, 'cinv', s.cinv + h.inv, 'inv', h.inv)")
    # A position holds one term, so the words of a phrase are the hits just before this one.
    ends = (f"s.n + 1 >= size(p) and forall(sequence(1, size(p)), k -> {hits}[s.n + 1 - k].o = p[size(p) - k] "
            f"and {hits}[s.n + 1 - k].pos = h.pos - k + 1)")
    began = (f"named_struct('pos', {hits}[s.n + 1 - size(p)].pos, 'n', s.n + 2 - size(p), 'cinv', s.cinv + h.inv "
             f"- aggregate(slice({hits}, s.n + 3 - size(p), size(p) - 1), 0D, (a, x) -> a + x.inv), "
             f"'inv', {hits}[s.n + 1 - size(p)].inv)")
    last = (f"concat(transform(slice(s.last, 1, {n_terms}), (x, i) -> if(i = h.o, {here}, x)), "
            f"transform({phrases}, (p, j) -> if({ends}, {began}, s.last[{n_terms} + j])))")
    start = f"""array_max(filter(transform({groups}, g -> if(forall(g, k -> last[k] is not null),
        array_min(transform(g, k -> last[k])), null)), x -> x is not null))"""
    cover = """(s.n + 1 - start.n + 1) / (s.cinv + h.inv - start.cinv + start.inv)
        / (1 + h.pos - start.pos - (s.n + 1 - start.n))"""
    # A one-element transform names a value that is used several times.
    step = f"""transform(array({last}), last -> transform(array({start}), start -> named_struct(
        'last', last, 'n', s.n + 1, 'cinv', s.cinv + h.inv, 'seen', coalesce(start.n, s.seen),
        'rank', s.rank + if(start.n <> s.seen, {cover}, 0D)))[0])[0]"""
    return F.expr(f"""aggregate({hits},
        named_struct('last', array_repeat({none}, {n_terms} + size({phrases})), 'n', 0, 'cinv', 0D, 'seen', 0,
                     'rank', 0D),
        (s, h) -> {step}, s -> if(s.seen > 0, s.rank / (s.rank + 1), null))""")


def _barring(batch: QueryBatch, index: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(q_id, product_id, g): documents in which an excluded phrase stands, by intersecting its terms' positions."""
    phrases = batch.frame if queries is None else batch.frame.join(queries, "q_id", "left_semi")
    terms = (phrases.select("q_id", F.posexplode("groups").alias("g", "group"))
             .select("q_id", "g", F.posexplode("group.barred").alias("p", "words"))
             .select("q_id", "g", "p", F.size("words").alias("n_words"), F.posexplode("words").alias("j", "term")))
    met = lookup_join(index.select("product_id", "term", "pos"), terms, ["term"], "inner", ["product_id", "pos"],
                      batch.small)
    whole = met.groupBy("q_id", "g", "p", "n_words", "product_id", (F.col("pos") - F.col("j")).alias("start")).agg(
        F.count("*").alias("n")).filter("n = n_words")
    return whole.select("q_id", "product_id", "g").distinct()


def _pruned(index: DataFrame, batch: QueryBatch) -> DataFrame:
    """Postings of the batch's terms, where these are few enough to name in the scan."""
    if batch.small and len(batch.terms) <= MAX_PUSHED_TERMS:
        return index.filter(F.col("term").isin(batch.terms))
    return index


def _leading_terms(batch: QueryBatch, index: DataFrame) -> DataFrame:
    """(q_id, term, n): one required term per group, the one with the fewest postings.

    A document of the group must hold it, so a frequent word next to a rare
    one costs no more than the rare one.
    """
    required = batch.frame.select("q_id", F.posexplode("groups").alias("g", "group")).select(
        "q_id", "g", F.explode("group.required").alias("term"))
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    counted = required.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    leading = counted.groupBy("q_id", "g").agg(
        F.min(F.struct("n", "term")).alias("least")).select("q_id", "least.term", "least.n")
    return leading.distinct()


ALLOWED_GROUPS = """filter(transform(numbered, (g, i) -> named_struct('g', g, 'i', i, 'r', ranked[i])),
    x -> size(x.g) > 0 and not coalesce(array_contains(barred, x.i), false)
         and forall(x.g, k -> array_contains(present, k)))"""
FREE_GROUPS = """exists(transform(numbered, (g, i) -> named_struct('g', g, 'i', i)),
    x -> size(x.g) = 0 and not coalesce(array_contains(barred, x.i), false))"""


def _matching_documents(batch: QueryBatch, index: DataFrame, about: DataFrame,
                        wanted: DataFrame, barring: DataFrame) -> DataFrame:
    """(q_id, product_id, alive, n_terms, phrase_terms): documents with the groups they may match.

    Whether required phrases stand together is seen when positions are read.

    Documents that hold a group's leading term are found first, and of these
    the ones that hold all terms of a group and none it excludes. Where the
    leading terms have few postings both steps are computed at once and
    broadcast if they turn out small.
    """
    leading = _leading_terms(batch, index)
    cheap = False
    if batch.small:
        table = local_table(leading)
        cheap = table is not None and (pc.sum(table["n"]).as_py() or 0) <= CHEAP_POSTINGS
        if table is not None:
            leading = leading.sparkSession.createDataFrame(table, schema=leading.schema)

    def settled(df):
        local = localize(df) if cheap else None
        return df if local is None else F.broadcast(local)

    words = index.select("product_id", "term")
    able = settled(lookup_join(words, leading.drop("n"), ["term"], "inner", ["product_id"],
                               batch.small).select("q_id", "product_id").distinct())
    checked = wanted.withColumn("g", F.lit(None).cast("int")).unionByName(
        barring.withColumn("o", F.lit(None).cast("int")))
    seen = lookup_join(words.join(able, "product_id"), checked, ["q_id", "term"], "inner",
                       ["product_id"], batch.small).select("q_id", "product_id", "o", "g").distinct()
    if batch.any_barred_phrase:
        seen = seen.unionByName(_barring(batch, index).join(able, ["q_id", "product_id"], "left_semi").withColumn(
            "o", F.lit(None).cast("int")))
    held = seen.groupBy("q_id", "product_id").agg(
        F.collect_set("o").alias("present"), F.collect_set("g").alias("barred"))
    return settled(lookup_join(held, about, ["q_id"], "inner", ["product_id"], batch.small)
                   .withColumn("alive", F.expr(f"transform({ALLOWED_GROUPS}, x -> x.r)"))
                   .filter("size(alive) > 0").select("q_id", "product_id", "alive", "n_terms", "phrase_terms"))


def ranked_matches(batch: QueryBatch, index: DataFrame) -> DataFrame:
    """(q_id, product_id, score) of the documents that hold what a query requires.

    Positions are read and ranked only for documents known to match; where
    every term alone makes a match, that is all of them. On postings bucketed
    by product no posting is shuffled.
    """
    index = _pruned(index, batch)
    wanted = batch.frame.select("q_id", F.posexplode("terms").alias("o", "term"))
    barring = batch.frame.select("q_id", F.posexplode("groups").alias("g", "group")).select(
        "q_id", "g", F.explode("group.excluded").alias("term"))
    about = batch.frame.selectExpr("q_id", "numbered", "ranked", "size(terms) as n_terms", "phrase_terms")
    inverse = "case weight " + " ".join(
        f"when '{c}' then {1 / w}D" for c, w in CLASS_WEIGHTS.items()) + " end"
    gathered = F.expr(
        f"sort_array(collect_list(named_struct('pos', pos, 'o', o, 'inv', {inverse})))").alias("hits")
    if batch.any_compound or batch.any_negation:
        alive = _matching_documents(batch, index, about, wanted, barring)
        hits = lookup_join(index.join(alive, "product_id"), wanted, ["q_id", "term"], "inner",
                           ["product_id", "pos"], batch.small)
        matched = hits.groupBy("q_id", "product_id").agg(
            gathered, F.first("alive").alias("alive"), F.first("n_terms").alias("n_terms"),
            F.first("phrase_terms").alias("phrase_terms"))
    else:
        hits = lookup_join(index, wanted, ["term"], "inner", ["product_id", "pos"], batch.small)
        matched = lookup_join(hits.groupBy("q_id", "product_id").agg(gathered), about, ["q_id"],
                              "inner", ["product_id"], batch.small
                              ).withColumnRenamed("ranked", "alive")
    return matched.select("q_id", "product_id", ladders.rounded(
        cover_density("hits", "alive", "n_terms", "phrase_terms")).alias("score")).filter("score is not null")


def free_matches(batch: QueryBatch, index: DataFrame, docs: DataFrame) -> DataFrame:
    """(q_id, product_id, score): a group of exclusions alone matches every other document, with rank 0.

    What bars a document is put next to it by product, where postings and
    documents lie together, so that no document moves.
    """
    index = _pruned(index, batch)
    barring = batch.frame.select("q_id", F.posexplode("groups").alias("g", "group")).select(
        "q_id", "g", F.explode("group.excluded").alias("term"))
    negative = batch.frame.filter("exists(groups, g -> size(g.required) = 0)")
    by_term = lookup_join(
        index.select("product_id", "term"),
        barring.join(negative.select("q_id"), "q_id", "left_semi"), ["term"], "inner",
        ["product_id"], batch.small).select("q_id", "product_id", "g")
    if batch.any_barred_phrase:
        by_term = by_term.unionByName(_barring(batch, index, negative.select("q_id")))
    barred = by_term.groupBy("q_id", "product_id").agg(
        F.collect_set("g").alias("barred")).groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("q_id", "barred"))).alias("by_query"))
    about = docs.select("product_id").join(barred, "product_id", "left")
    return (with_every_query(about, negative.select("q_id", "numbered"), batch.small)
            .withColumn("barred", F.element_at("by_query", F.col("q_id"))).filter(FREE_GROUPS)
            .select("q_id", "product_id", F.lit(0.0).alias("score")))


def lexical_matches(batch: QueryBatch, index: DataFrame, docs: DataFrame) -> DataFrame:
    """(q_id, product_id, score) of all documents that match, before filters and limits."""
    ranked = ranked_matches(batch, index)
    if not batch.any_pure_negation:
        return ranked
    return ranked.unionByName(free_matches(batch, index, docs)).groupBy("q_id", "product_id").agg(
        F.max("score").alias("score"))


def lexical_candidates(batch: QueryBatch, index: DataFrame, docs: DataFrame) -> DataFrame:
    """(q_id, product_id, score): the best ranked matches that pass the query's filters.

    Documents that a query merely does not exclude are trimmed by task before
    they meet the ranked ones: as many as the query wants are enough, whichever
    of them turn out to be ranked.
    """
    terms = filtered_terms(docs, batch).select(
        "product_id", "updated_at", "sortable_price", "company_lower", "category_keys")
    about = batch.frame.select("q_id", "depth", *FILTERS)

    def trimmed(matches):
        rows = lookup_join(matches.join(terms, "product_id"), about, ["q_id"], "inner", ["product_id"],
                           batch.small)
        return top_k(rows.filter(passes_filters()).select(
            "q_id", "product_id", "updated_at", "depth", "score"), ["q_id"], candidate_order(),
            batch.max_depth, ["product_id"])

    best = trimmed(ranked_matches(batch, index))
    if batch.any_pure_negation:
        both = best.unionByName(trimmed(free_matches(batch, index, docs))).groupBy(
            "q_id", "product_id", "updated_at", "depth").agg(F.max("score").alias("score"))
        best = top_k(both, ["q_id"], candidate_order(), batch.max_depth, ["product_id"])
    return best.filter(F.col("rank") <= F.col("depth")).select("q_id", "product_id", "score")
