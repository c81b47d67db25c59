"""Query frames and the filters they carry."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shelfseek.functions import text
from shelfseek.operators.joins import local_table, lookup_join, split_join, top_k
from shelfseek.sources.tables import stored

# Page sizes and how deep each source looks.
DEFAULT_SIZE, MAX_SIZE = 20, 60
CANDIDATE_FACTOR, MIN_CANDIDATES = 4, 80
SEMANTIC_FACTOR, MIN_SEMANTIC = 2, 40

QUERY_DDL = ("q_id string, raw string, platform string, category string, shop string, "
             "min_price double, max_price double, sort string, page int, size int, "
             "q_embedding array<float>")
FILTERS = ["f_category", "f_shop", "f_min", "f_max"]
#: Bins of prices that price filters are looked up in.
PRICE_BINS = 256
#: Bits of a price that a level of the tree of prices takes.
NODE_BITS = 3


def normalize_queries(queries: DataFrame, default_size: int = DEFAULT_SIZE,
                      max_size: int = MAX_SIZE, fold_accents: bool = False) -> DataFrame:
    """Normalised text, tokens, filters, paging and limits of each query."""
    normalized = text.normalize_query(F.col("raw"))
    if fold_accents:
        normalized = F.lower(text.fold(normalized))
    q = queries.withColumn("normalized", normalized)
    q = q.withColumn("tokens", text.query_tokens(F.col("normalized")))
    page = F.when(F.col("page") >= 0, F.col("page")).otherwise(0)
    size = F.when(F.col("size") > 0, F.least(F.col("size"), F.lit(max_size))).otherwise(
        default_size)
    sort = F.coalesce(text.clean_filter(F.col("sort")), F.lit("relevance"))
    depth = (page + 1) * size
    return q.select(
        "q_id", "raw", "normalized", "tokens",
        text.prefix_query_text(F.col("tokens")).alias("ts_query"),
        text.phrase_query_text(F.col("tokens")).alias("phrase_query"),
        F.col("normalized").alias("like_query"),
        text.clean_filter(F.col("category")).alias("f_category"),
        text.clean_filter(F.col("shop")).alias("f_shop"),
        F.col("min_price").alias("f_min"), F.col("max_price").alias("f_max"),
        sort.alias("sort"), page.cast("int").alias("page"), size.cast("int").alias("size"),
        text.trigram_threshold(F.col("normalized")).alias("threshold"),
        F.greatest(depth * CANDIDATE_FACTOR, F.lit(MIN_CANDIDATES)).cast("int").alias("depth"),
        F.greatest(depth * SEMANTIC_FACTOR, F.lit(MIN_SEMANTIC)).cast("int").alias("vector_depth"),
        (F.size("tokens") == 0).alias("blank"),
        "q_embedding")


@dataclass
class QueryBatch:
    """Normalised and parsed queries that have something to search for.

    ``table`` holds a batch that was measured and may be broadcast; larger
    batches have none and are joined by shuffles. ``terms`` and ``grams`` are
    the distinct search keys of a small batch, which prune the scans.
    """
    frame: DataFrame
    table: pa.Table | None
    max_depth: int
    max_vector_depth: int
    any_negation: bool = True
    any_pure_negation: bool = True
    any_compound: bool = True
    any_barred_phrase: bool = True
    filters: list[tuple] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    grams: list[str] = field(default_factory=list)
    fold_accents: bool = False

    @property
    def small(self) -> bool:
        return self.table is not None

    @property
    def one_filter(self) -> tuple | None:
        return self.filters[0] if len(self.filters) == 1 else None


def query_batch(normalized: DataFrame, fold_accents: bool = False) -> QueryBatch:
    """Parse the queries once and learn what the plans need to know about them."""
    live = text.with_query_groups(normalized.filter(~F.col("blank")))
    live = live.withColumn("terms", F.expr(
        "array_distinct(flatten(transform(groups, g -> g.required)))")).withColumn(
        "numbered", F.expr("transform(groups, g -> transform(g.required, "
                           "t -> cast(array_position(terms, t) - 1 as int)))")).withColumn(
        "phrases", F.expr("array_distinct(flatten(transform(groups, g -> g.phrases)))")).withColumn(
        "phrase_terms", F.expr("transform(phrases, p -> transform(p, "
                               "t -> cast(array_position(terms, t) - 1 as int)))")).withColumn(
        # What a cover must hold: terms that are in no phrase, and phrases, numbered behind the terms.
        "ranked", F.expr("""transform(groups, g -> concat(
            transform(filter(g.required, t -> not exists(g.phrases, p -> array_contains(p, t))),
                      t -> cast(array_position(terms, t) - 1 as int)),
            transform(g.phrases, p -> cast(size(terms) + array_position(phrases, p) - 1 as int))))""")).withColumn(
        "grams", text.trigrams(F.col("normalized")))
    table = local_table(live)
    if table is None:
        facts = live.agg(F.max("depth").alias("depth"), F.max("vector_depth").alias("vector_depth")).first()
        return QueryBatch(live, None, facts["depth"] or 0, facts["vector_depth"] or 0, fold_accents=fold_accents)
    frame = live.sparkSession.createDataFrame(table, schema=live.schema)
    rows = table.select(["groups", "terms", "grams", *FILTERS]).to_pylist()
    groups = [g for r in rows for g in r["groups"]]
    return QueryBatch(
        frame, table, pc.max(table["depth"]).as_py() or 0,
        pc.max(table["vector_depth"]).as_py() or 0,
        any(g["excluded"] or g["barred"] for g in groups), any(not g["required"] for g in groups),
        any(len(g["required"]) > 1 for g in groups), any(g["barred"] for g in groups),
        sorted({tuple(r[f] for f in FILTERS) for r in rows}, key=repr),
        sorted({t for g in groups for t in (*g["required"], *g["excluded"], *(t for p in g["barred"] for t in p))}),
        sorted({g for r in rows for g in r["grams"]}), fold_accents)


FIELDS = {"id_lower": "product_id", "title_lower": "title", "company_lower": "company",
          "category_id_lower": "category_id", "category_lower": "category_title",
          "category_slug_lower": "category_slug", "subcategory_lower": "subcategory_title",
          "subcategory_slug_lower": "subcategory_slug",
          "leaf_category_lower": "leaf_category_title",
          "leaf_category_slug_lower": "leaf_category_slug"}


def document_terms(docs: DataFrame, fold_accents: bool = False) -> DataFrame:
    """The lower-cased fields that predicates read, next to the ordering columns."""
    terms = docs.selectExpr("product_id", "updated_at", "sortable_price", *[
        f"lower(coalesce({column}, '')) as {name}" for name, column in FIELDS.items()])
    if fold_accents:
        terms = terms.withColumns({name: F.lower(text.fold(F.col(name))) for name in FIELDS})
    return terms.selectExpr(
        "*", "array(category_id_lower, category_slug_lower, category_lower, subcategory_slug_lower, "
             "subcategory_lower, leaf_category_slug_lower, leaf_category_lower) as category_keys")


def passes_filters() -> Column:
    """Whether a joined (query, document) row passes the query's filters."""
    return F.expr("""
        (f_category is null or array_contains(category_keys, f_category))
        and (f_shop is null or company_lower = f_shop)
        and (f_min is null or sortable_price >= f_min)
        and (f_max is null or sortable_price <= f_max)""")


def filtered_terms(docs: DataFrame, batch: QueryBatch) -> DataFrame:
    """Document terms, filtered at the scan when all queries share one filter."""
    terms = document_terms(docs, batch.fold_accents)
    if batch.one_filter is None:
        return terms
    category, shop, low, high = batch.one_filter
    if category is not None:
        terms = terms.filter(F.array_contains("category_keys", F.lit(category)))
    if shop is not None:
        terms = terms.filter(F.col("company_lower") == shop)
    if low is not None:
        terms = terms.filter(F.col("sortable_price") >= low)
    if high is not None:
        terms = terms.filter(F.col("sortable_price") <= high)
    return terms


def price_bounds(terms: DataFrame, bins: int = PRICE_BINS) -> list[float]:
    """Prices that cut the documents into about equally large bins; at most ``bins - 1`` numbers."""
    shares = [i / bins for i in range(1, bins)]
    found = terms.agg(F.percentile_approx(F.col("sortable_price").cast("double"), shares, 100 * bins)).first()[0]
    return sorted(set(found or []))


def _bin(price: Column, bounds: list[float]) -> Column:
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.expr("cast(array() as array<double>)")
    return F.size(F.filter(edges, lambda edge: edge <= price))


def distinct_filters(queries: DataFrame) -> DataFrame:
    """(filters, ``FILTERS``): the different filters of a batch, each with a text of its own."""
    return queries.select(*FILTERS).distinct().select(F.to_json(F.struct(*FILTERS)).alias("filters"), *FILTERS)


def documents_of_filters(terms: DataFrame, asked: DataFrame, small: bool) -> DataFrame:
    """(filters, product_id, updated_at) for every document that passes each of the ``distinct_filters``.

    A filter is looked up by its category, else by its shop, else by the bins that its price range touches, so
    that documents meet only filters which they may pass. The one filter that asks for nothing takes all.
    """
    bounds = price_bounds(terms)
    price = F.col("sortable_price").cast("double")

    def entry(by, key):
        return F.struct(F.lit(by).alias("by"), key.alias("key"))

    binned = F.when(price.isNotNull(), _bin(price, bounds).cast("string"))
    offers = F.concat(F.transform(F.array_distinct("category_keys"), lambda k: entry("category", k)),
                      F.array(entry("shop", F.col("company_lower"))), F.array(entry("price", binned)))
    offered = terms.select("product_id", "updated_at", "sortable_price", "company_lower", "category_keys",
                           F.inline(offers)).filter(F.col("key") != "")
    low = F.when(F.col("f_min").isNotNull(), _bin(F.col("f_min"), bounds)).otherwise(0)
    high = F.when(F.col("f_max").isNotNull(), _bin(F.col("f_max"), bounds)).otherwise(len(bounds))
    ranged = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: entry("price", i.cast("string"))))
    free = F.coalesce(*[F.col(c).cast("string") for c in FILTERS]).isNull()
    keyed = asked.filter(~free).select("filters", *FILTERS, F.inline(
        F.when(F.col("f_category").isNotNull(), F.array(entry("category", F.col("f_category"))))
        .when(F.col("f_shop").isNotNull(), F.array(entry("shop", F.col("f_shop")))).otherwise(ranged)))
    met = lookup_join(offered, keyed, ["by", "key"], "inner", ["product_id"], small).filter(passes_filters())
    columns = ["filters", "product_id", "updated_at"]
    if asked.filter(free).isEmpty():
        return met.select(*columns)
    everything = terms.withColumn("filters", F.lit("{}"))
    return met.select(*columns).unionByName(everything.select(*columns))


def filter_documents(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q_id, product_id) for every document that passes each query's filters."""
    batch = query_batch(queries)
    hits = documents_of_filters(filtered_terms(docs, batch), distinct_filters(batch.frame), batch.small)
    asking = batch.frame.select("q_id", F.to_json(F.struct(*FILTERS)).alias("filters"))
    return lookup_join(hits, asking, ["filters"], "inner", ["product_id"], batch.small).select("q_id", "product_id")


def _cents(price: Column, up: bool) -> Column:
    """The least price in cents that is no less than a number, or the greatest that is no more."""
    x = F.least(F.greatest(price, F.lit(-1e10)), F.lit(1e10))
    near = F.ceil(x * 100) if up else F.floor(x * 100)
    step, fits = (1, lambda c: c / F.lit(100.0) >= x) if up else (-1, lambda c: c / F.lit(100.0) <= x)
    return near + F.when(fits(near - step), -step).when(~fits(near), step).otherwise(0)


def _nodes(low: Column, end: Column, levels: int) -> Column:
    """(level, pos): the largest nodes that cover the prices from ``low`` up to ``end``, at most 14 a level."""
    def between(a, b):
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))

    def at(level):
        return lambda pos: F.struct(F.lit(level).alias("level"), pos.alias("pos"))

    parts = []
    for level in range(levels + 1):
        width = F.lit(1 << NODE_BITS * level)
        wider = F.lit(1 << NODE_BITS * (level + 1))
        a, b = F.ceil(low / width), F.floor(end / width)
        up_a, up_b = F.ceil(low / wider), F.floor(end / wider)
        own = between(a, b) if level == levels else F.when(up_a < up_b, F.concat(
            between(a, F.shiftleft(up_a, NODE_BITS)), between(F.shiftleft(up_b, NODE_BITS), b))).otherwise(between(a, b))
        parts.append(F.transform(own, at(level)))
    return F.concat(*parts)


def price_tree(terms: DataFrame, groups: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """(grp, level, pos, n, first): how many documents of a group have a price in a node, and the newest ``k``.

    A node of level 0 is one price in cents, counted from the least one; one of the next level spans
    ``2 ** NODE_BITS`` neighbours. Documents without a price are the node -1. ``groups`` (grp, category, shop) name
    the categories and shops that are asked for, with empty texts for none. Also returns the least price and the
    level of the root.
    """
    cents = F.round(F.col("sortable_price") * 100).cast("long")
    least, most = terms.agg(F.min(cents), F.max(cents)).first()
    least, levels = least or 0, 0
    while 1 << NODE_BITS * levels <= (most or 0) - least:
        levels += 1
    none = F.lit("")
    keys = F.array_distinct(F.concat(F.array(none), "category_keys"))
    shops = F.array_distinct(F.array(none, F.col("company_lower")))
    age = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit((1 << 63) - 1))
    offered = terms.select("product_id", age.alias("age"), F.coalesce(cents - least, F.lit(-1)).alias("pos"),
                           F.explode(keys).alias("category"), shops.alias("shops"))
    offered = offered.select("product_id", "age", "pos", "category", F.explode("shops").alias("shop"))
    rows = lookup_join(offered, groups, ["category", "shop"], "inner", ["product_id", "pos"]).select(
        "grp", "pos", "age", "product_id")
    order = [F.col("age").asc(), F.col("product_id").asc()]
    first = top_k(rows, ["grp", "pos"], order, k, ["product_id"]).groupBy("grp", "pos").agg(
        F.sort_array(F.collect_list(F.struct("age", "product_id"))).alias("first"))
    nodes = rows.groupBy("grp", "pos").agg(F.count("*").alias("n")).join(first, ["grp", "pos"])
    nodes = stored(nodes.select("grp", "pos", "n", "first"), "prices")
    all_levels = [nodes.withColumn("level", F.lit(0))]
    nodes = nodes.filter("pos >= 0")
    for level in range(1, levels + 1):
        nodes = stored(nodes.groupBy("grp", F.shiftright("pos", NODE_BITS).alias("pos")).agg(
            F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, k).alias("first")),
            "prices")
        all_levels.append(nodes.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, all_levels), least, levels


def filter_pages(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q_id, total, first): how many documents pass each query's filters, and the ids of the newest ``k``.

    Equal filters are answered once, and no filter meets its documents one by one: their counts and newest ``k``
    are kept for the nodes of a tree of prices, for each category and shop asked for, and a filter adds up the few
    nodes that make its price range.
    """
    batch = query_batch(queries)
    asked = stored(distinct_filters(batch.frame), "filters").withColumns({
        "category": F.coalesce("f_category", F.lit("")), "shop": F.coalesce("f_shop", F.lit(""))})
    groups = stored(asked.select("category", "shop").distinct().withColumn("grp", F.monotonically_increasing_id()),
                    "groups")
    tree, least, levels = price_tree(filtered_terms(docs, batch), groups, k)
    size = 1 << NODE_BITS * levels
    low = F.when(F.col("f_min").isNull(), 0).otherwise(F.greatest(_cents(F.col("f_min"), True) - least, F.lit(0)))
    end = F.when(F.col("f_max").isNull(), size).otherwise(F.least(_cents(F.col("f_max"), False) - least + 1, F.lit(size)))
    unpriced = F.when(F.col("f_min").isNull() & F.col("f_max").isNull(), F.array(F.struct(
        F.lit(0).alias("level"), F.lit(-1).cast("long").alias("pos"))))
    ranges = asked.select("filters", "category", "shop", low.alias("low"), end.alias("end"), unpriced.alias("unpriced"))
    wanted = lookup_join(ranges, groups, ["category", "shop"], "inner", ["filters"]).select(
        "filters", "grp", F.inline(F.when(F.col("unpriced").isNull(), _nodes(F.col("low"), F.col("end"), levels))
                                   .otherwise(F.concat(_nodes(F.col("low"), F.col("end"), levels), "unpriced"))))
    # Wide nodes are wanted by many filters.
    met = split_join(wanted, tree, ["grp", "level", "pos"], "inner", ["filters"])
    found = met.groupBy("filters").agg(F.sum("n").alias("total"), F.array_join(F.transform(
        F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, k), lambda r: r["product_id"]), ",").alias("first"))
    asking = batch.frame.select("q_id", F.to_json(F.struct(*FILTERS)).alias("filters"))
    return asking.join(found, "filters", "left").select(
        "q_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("first", F.lit("")).alias("first"))


def with_every_query(terms: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """Pair documents with queries that select by range or not at all.

    The pairs are the result itself, so they cannot be avoided. Queries are
    dealt into numbered buckets, every document visits each bucket, and the
    bucket number is the join key.
    """
    buckets = 1 if small else 64
    dealt = queries.withColumn("_bucket", F.pmod(F.xxhash64("q_id"), F.lit(buckets)).cast("int"))
    visiting = terms.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return lookup_join(visiting, dealt, ["_bucket"], "inner", ["product_id"], small).drop("_bucket")
