"""The catalogue tables as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfseek.operators.joins import are_small

CATALOGUE_DAY = "2024-01-01 00:00:00"
FIRST_UPDATE = "1999-01-01"
NOW = "2000-06-01 00:00:00"
#: Sellers that detail rows meet by broadcast; more of them, or longer names, meet by shuffle.
MAX_SELLERS, MAX_SELLER_CHARS = 500_000, 200

QUERY_ROWS = [
    # q_id, raw, category, shop, min_price, max_price, sort, page, size, label of the embedding
    ("q01", "red widget", None, None, None, None, None, None, None, 0),
    ("q02", "RED  Widget!!", None, None, None, None, " Price_ASC ", 1, 10, 1),
    ("q03", "wiget", None, None, None, None, "relevance", 0, 200, 2),
    ("q04", "brand#2", None, None, None, None, "price_desc", 0, 20, 3),
    ("q05", "small or hot", None, None, 1000.0, 60000.0, "title", 0, 20, 4),
    ("q06", "red -plate", "africa", None, None, None, "newest", 0, 20, 5),
    ("q07", "africa", None, None, None, None, "unknown", 2, 20, 6),
    ("q08", "42", None, None, None, None, None, -1, 0, 7),
    ("q09", "xx", None, None, None, None, None, None, None, None),
    ("q10", "a", None, None, None, None, None, 3, 5, 8),
    ("q11", "   ", None, None, None, None, None, None, None, 9),
    ("q12", None, None, None, None, None, None, None, None, None),
    ("q13", "  Café Phone Case!!  ", None, None, None, None, None, 1, 200, None),
    ("q14", "blue gizmo or new ring or -small", " Economy", None, None, None, None, 0, 30, 1),
    ("q15", "-widget -gear", None, "brand#7", None, 50000.0, None, 0, 20, None),
    ("q16", "nation-7", None, None, None, None, None, 0, 60, None),
    ("q17", "small'gear or -red'plate new or hot -widget'hot", None, None, None, None, None, 0, 40, 2),
    ("q18", "widget'blue or -new'bolt", None, None, None, None, None, 0, 20, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores where its files give fewer splits."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def categories(spark, d):
    return table(spark, d, "region").select(
        F.col("r_regionkey").cast("string").alias("uuid"),
        F.col("r_name").alias("category_title"),
        F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("slug"),
        F.lit(None).cast("string").alias("icon_url"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("created_at"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("updated_at"))


def subcategories(spark, d):
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("uuid"),
        F.col("n_name").alias("sub_category_title"),
        F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("sub_category_slug"),
        F.col("n_regionkey").cast("string").alias("category_id"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("created_at"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("updated_at"))


def leaf_categories(spark, d):
    title = F.col("p_type")
    return table(spark, d, "part").select("p_type").distinct().select(
        F.lower(title).alias("id"),
        F.pmod(F.length(title), F.lit(7)).cast("string").alias("category_id"),
        F.length(title).cast("string").alias("subcategory_id"),
        title.alias("leaf_category_title"),
        F.when(F.length(title) > 5, F.lower(title)).alias("leaf_category_slug"),
        F.lower(title).alias("slug"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("created_at"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("updated_at"))


def products(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.cast("string").alias("id"),
        F.when(key % 11 == 0, None).when(key % 7 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.concat(F.lit("https://shop.example/p/"), key).alias("product_url"),
        F.when(key % 10 == 0, None).when(key % 10 == 5, "").otherwise(
            F.concat(F.lit("https://img.example/"), key, F.lit(".jpg"))).alias("image_url"),
        F.when(key % 13 != 0, F.col("p_brand")).alias("company"),
        (key % 5).cast("string").alias("category_id"),
        (key % 25).cast("string").alias("subcategory_id"),
        F.lower("p_type").alias("leaf_category_id"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("created_at"),
        F.date_add(F.lit(FIRST_UPDATE).cast("date"), (key % 1000).cast("int")).cast("timestamp")
        .alias("updated_at"))


def _money(cents):
    return (cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)")


def product_details(spark, d):
    """Line items as detail rows; they move once, by the product id, which later steps group by, and unsorted."""
    lines = table(spark, d, "lineitem").withColumn("product_id", F.col("l_partkey").cast("string"))
    names = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"), "p_name")
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    if are_small(sellers, max_rows=MAX_SELLERS, max_chars=MAX_SELLER_CHARS)[0]:
        sellers = F.broadcast(sellers)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    kept = 100 - F.round(F.col("l_discount") * 100).cast("long")
    at = F.col("l_shipdate").cast("timestamp")
    return (lines.join(names.hint("shuffle_hash"), "product_id").join(sellers, "l_suppkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "product_id", "l_suppkey",
                    cents.cast("string")).alias("id"),
        "product_id",
        F.col("l_orderkey").cast("string").alias("scrape_run_id"),
        F.lit(True).alias("success"),
        F.when(F.col("l_linenumber") != 7, at).alias("scraped_at"),
        F.col("p_name").alias("product_title"),
        F.col("s_name").alias("supplier_name"),
        _money(cents).alias("original_price"),
        F.when(F.col("l_linestatus") == "F", _money(cents)).alias("original_price_usd"),
        F.when(F.col("l_returnflag") != "R",
               _money(F.floor((cents * kept + 50) / 100))).alias("promotional_price"),
        F.lit(None).cast("decimal(12,2)").alias("promotional_price_usd"),
        F.lit(None).cast("string").alias("price_text"),
        at.alias("created_at")))


def product_embeddings(spark, d):
    """One vector per part that has one; surplus vectors have no product."""
    known = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"))
    return table(spark, d, "embeddings").join(known, "vec_id", "left_semi").select(
        F.concat(F.lit("e"), "vec_id").alias("id"),
        F.col("vec_id").cast("string").alias("product_id"), "embedding",
        F.concat(F.lit("https://img.example/"), "vec_id", F.lit(".jpg")).alias("source_image_url"),
        F.lit("clip-vit-base-patch32").alias("model_version"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("created_at"))


def product_embedding_status(spark, d):
    """Parts of the smaller sizes were tried before."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").filter(size <= 20).select(
        F.concat(F.lit("s"), key).alias("id"), key.cast("string").alias("product_id"),
        F.element_at(F.array(F.lit("PENDING"), F.lit("RETRY"), F.lit("FAILED")),
                     size % 3 + 1).alias("status"),
        F.when(size % 4 == 0, F.lit("2000-01-01 00:00:00").cast("timestamp"))
        .when(size % 4 == 1, F.lit("2001-01-01 00:00:00").cast("timestamp")).alias("next_retry_at"),
        F.lit(None).cast("timestamp").alias("attempted_at"))


def product_embedding_attempts(spark, d):
    """Every event as an attempt at embedding its product; most products have several."""
    kind, number = F.col("event_type"), F.col("event_id")
    n_parts = table(spark, d, "part").count()
    return table(spark, d, "events").select(
        number.cast("string").alias("id"), (number % n_parts).cast("string").alias("product_id"), F.when(kind.isin("error", "signup"), "RETRY").when(
            kind == "view", "PENDING").otherwise("FAILED").alias("status"),
        F.when(kind == "error", F.lit("2001-01-01").cast("timestamp")).alias("next_retry_at"),
        F.col("ts").cast("timestamp").alias("attempted_at"))


def product_detail_variants(spark, d):
    """Line items as variants; those of the seventh line hang on a detail that is not there."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("v"), key).alias("uuid"), F.col("l_partkey").cast("string").alias("product_id"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("gone-"), F.col("l_partkey") % 50))
        .otherwise(key).alias("product_detail_id"),
        F.col("l_linenumber").cast("int").alias("variant_index"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate").cast("timestamp")).alias("created_at"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at"))


def product_scrape_results(spark, d):
    """Events as scrape results; the product is the event number within the part count."""
    n_parts = table(spark, d, "part").count()
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("scrape_run_id"),
        (F.col("event_id") % n_parts).cast("string").alias("product_id"),
        _money(F.round(F.col("value") * 100).cast("long")).alias("price"),
        F.col("event_type").alias("scrape_status"),
        F.col("ts").cast("timestamp").alias("scraped_at"))


def scrape_runs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("keyword"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_custkey") % 6).cast("string"))
        .alias("category_id"),
        F.lit(None).cast("string").alias("subcategory_id"),
        F.lit(None).cast("string").alias("leaf_category_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"))


def taxonomy(spark, d):
    return categories(spark, d), subcategories(spark, d), leaf_categories(spark, d)


def documents(spark, d):
    from shelfseek.operators.documents import build_documents
    return build_documents(products(spark, d), product_details(spark, d), *taxonomy(spark, d))


def articles(spark, d):
    """Long accented texts in the shape of search documents, whole texts as titles."""
    text = F.col("text")
    none = F.lit(None)
    return texts(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("product_id"), text.alias("title"),
        none.cast("string").alias("product_url"), none.cast("string").alias("image_url"),
        F.col("source").alias("company"),
        F.col("lang").alias("category_id"), F.col("lang").alias("category_title"),
        F.col("lang").alias("category_slug"),
        none.cast("string").alias("subcategory_title"), none.cast("string").alias("subcategory_slug"),
        none.cast("string").alias("leaf_category_title"),
        none.cast("string").alias("leaf_category_slug"),
        F.col("n_chars").cast("decimal(12,2)").alias("original_price"),
        F.col("n_chars").cast("decimal(12,2)").alias("sortable_price"),
        F.lit("").alias("search_text"),
        F.lit(CATALOGUE_DAY).cast("timestamp").alias("updated_at"),
        text.alias("lexical_title"), F.col("source").alias("lexical_company"))


def label_vectors(spark, d):
    """One query vector per label: the mean of the label's vectors."""
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
            .select("label", F.transform("v", lambda c: F.round(c["x"], 6).cast("float"))
                    .alias("q_embedding")))


def queries(spark, d, embedded: bool = True):
    ddl = ("q_id string, raw string, category string, shop string, min_price double, "
           "max_price double, sort string, page int, size int, label int")
    rows = spark.createDataFrame(QUERY_ROWS, ddl).withColumn("platform", F.lit(None).cast("string"))
    if not embedded:
        return rows.withColumn("q_embedding", F.lit(None).cast("array<float>")).drop("label")
    return rows.join(label_vectors(spark, d), "label", "left").drop("label")
