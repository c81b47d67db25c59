"""Tables of the catalogue: columns, references, unique keys and required columns."""

from __future__ import annotations

from pyspark.sql import types as T

# The table layouts.
DDL = {
    "categories": "uuid string, category_title string, slug string, icon_url string, "
                  "created_at timestamp, updated_at timestamp",
    "subcategories": "uuid string, sub_category_title string, sub_category_slug string, "
                     "category_id string, created_at timestamp, updated_at timestamp",
    "leaf_categories": "id string, category_id string, subcategory_id string, "
                       "leaf_category_title string, leaf_category_slug string, slug string, "
                       "created_at timestamp, updated_at timestamp",
    "scrape_runs": "id string, keyword string, category_id string, subcategory_id string, "
                   "leaf_category_id string, status string, started_at timestamp, "
                   "completed_at timestamp, error string",
    "products": "id string, title string, product_url string, image_url string, company string, "
                "category_id string, subcategory_id string, leaf_category_id string, "
                "created_at timestamp, updated_at timestamp",
    "product_scrape_results": "id string, scrape_run_id string, product_id string, page int, "
                              "position int, price decimal(12,2), price_usd decimal(12,2), "
                              "sold string, repeat_rate string, badges string, raw_text string, "
                              "scrape_status string, scraped_at timestamp",
    "product_details": "id string, product_id string, scrape_run_id string, success boolean, "
                       "scraped_at timestamp, url string, product_title string, "
                       "page_title string, supplier_name string, original_price decimal(12,2), "
                       "original_price_usd decimal(12,2), promotional_price decimal(12,2), "
                       "promotional_price_usd decimal(12,2), coupon_price decimal(12,2), "
                       "coupon_price_usd decimal(12,2), "
                       "first_piece_estimated_price decimal(12,2), "
                       "first_piece_estimated_price_usd decimal(12,2), price_text string, "
                       "quantity_price_tiers string, discount_rules string, pricing string, "
                       "availability string, variants string, attributes string, media string, "
                       "meta string, created_at timestamp",
    "product_detail_variants": "uuid string, product_id string, product_detail_id string, "
                               "variant_index int, color_id string, color string, "
                               "size_id string, size string, price decimal(12,2), "
                               "price_usd decimal(12,2), image_url string, "
                               "stock_quantity bigint, stock_text string, "
                               "length_cm decimal(12,2), width_cm decimal(12,2), "
                               "height_cm decimal(12,2), volume_cm3 decimal(14,3), "
                               "weight_g decimal(12,2), created_at timestamp, "
                               "updated_at timestamp",
    "product_embeddings": "id string, product_id string, embedding array<float>, "
                          "source_image_url string, model_version string, created_at timestamp",
    "product_embedding_status": "id string, product_id string, status string, "
                                "next_retry_at timestamp, attempted_at timestamp",
    # The last two columns are the texts that the postings are cut from.
    "product_search_documents": "product_id string, title string, product_url string, "
                                "image_url string, company string, category_id string, "
                                "category_title string, category_slug string, "
                                "subcategory_title string, subcategory_slug string, "
                                "leaf_category_title string, leaf_category_slug string, "
                                "original_price decimal(12,2), sortable_price decimal(12,2), "
                                "search_text string, updated_at timestamp, "
                                "lexical_title string, lexical_company string",
    "postings": "product_id string, term string, pos int, weight string",
}

# Fixed values: (table, column, referenced table, referenced column, on delete).
REFERENCES = [
    ("subcategories", "category_id", "categories", "uuid", "restrict"),
    ("leaf_categories", "category_id", "categories", "uuid", "restrict"),
    ("leaf_categories", "subcategory_id", "subcategories", "uuid", "restrict"),
    ("scrape_runs", "category_id", "categories", "uuid", "restrict"),
    ("scrape_runs", "subcategory_id", "subcategories", "uuid", "restrict"),
    ("scrape_runs", "leaf_category_id", "leaf_categories", "id", "restrict"),
    ("products", "category_id", "categories", "uuid", "restrict"),
    ("products", "subcategory_id", "subcategories", "uuid", "restrict"),
    ("products", "leaf_category_id", "leaf_categories", "id", "restrict"),
    ("product_scrape_results", "scrape_run_id", "scrape_runs", "id", "cascade"),
    ("product_scrape_results", "product_id", "products", "id", "cascade"),
    ("product_details", "product_id", "products", "id", "cascade"),
    ("product_details", "scrape_run_id", "scrape_runs", "id", "set null"),
    ("product_detail_variants", "product_id", "products", "id", "cascade"),
    ("product_detail_variants", "product_detail_id", "product_details", "id", "cascade"),
    ("product_embeddings", "product_id", "products", "id", "cascade"),
    ("product_search_documents", "product_id", "products", "id", "cascade"),
]

# Unique keys.
UNIQUE_KEYS = [
    ("categories", ["uuid"]), ("categories", ["slug"]),
    ("subcategories", ["uuid"]), ("subcategories", ["sub_category_slug"]),
    ("leaf_categories", ["id"]), ("leaf_categories", ["slug"]),
    ("leaf_categories", ["leaf_category_slug"]),
    ("scrape_runs", ["id"]),
    ("products", ["id"]), ("products", ["product_url"]),
    ("product_scrape_results", ["id"]),
    ("product_scrape_results", ["scrape_run_id", "product_id"]),
    ("product_details", ["id"]),
    ("product_detail_variants", ["uuid"]),
    ("product_detail_variants", ["product_detail_id", "variant_index"]),
    ("product_embeddings", ["id"]), ("product_embeddings", ["product_id"]),
    ("product_search_documents", ["product_id"]),
]

# Columns that may not be NULL.
REQUIRED = {
    "categories": ["uuid", "category_title", "slug", "created_at", "updated_at"],
    "subcategories": ["uuid", "sub_category_title", "sub_category_slug", "category_id",
                      "created_at", "updated_at"],
    "leaf_categories": ["id", "category_id", "subcategory_id", "leaf_category_title",
                        "leaf_category_slug", "slug", "created_at", "updated_at"],
    "scrape_runs": ["id", "keyword", "status", "started_at"],
    "products": ["id", "created_at", "updated_at"],
    "product_scrape_results": ["id", "scrape_run_id", "product_id", "badges", "scrape_status",
                               "scraped_at"],
    "product_details": ["id", "product_id", "success", "quantity_price_tiers", "discount_rules",
                        "pricing", "availability", "variants", "attributes", "media", "meta",
                        "created_at"],
    "product_detail_variants": ["uuid", "product_id", "product_detail_id", "variant_index",
                                "created_at", "updated_at"],
    "product_embeddings": ["id", "product_id", "embedding"],
    "product_search_documents": ["product_id", "search_text", "updated_at"],
}

# Columns that older tables call by another name, columns no
# longer kept, and what a missing or empty column becomes.
RENAMES = {
    "categories": {"id": "uuid"},
    "subcategories": {"id": "uuid", "slug": "sub_category_slug"},
}
DROPPED = {
    "product_details": ["description", "raw"],
    "product_detail_variants": ["raw"],
}
DEFAULTS = {
    "scrape_runs": {"status": "running"},
    "product_scrape_results": {"badges": "[]", "scrape_status": "product_scraped"},
    "product_details": {"success": False, "quantity_price_tiers": "[]", "discount_rules": "[]",
                        "pricing": "{}", "availability": "{}", "variants": "{}",
                        "attributes": "{}", "media": "{}", "meta": "{}"},
    "product_embeddings": {"model_version": "clip-vit-base-patch32"},
    "product_search_documents": {"search_text": ""},
}
NOW_DEFAULTS = {
    "categories": ["created_at", "updated_at"],
    "subcategories": ["created_at", "updated_at"],
    "leaf_categories": ["created_at", "updated_at"],
    "scrape_runs": ["started_at"],
    "products": ["created_at", "updated_at"],
    "product_scrape_results": ["scraped_at"],
    "product_details": ["created_at"],
    "product_detail_variants": ["created_at", "updated_at"],
    "product_embeddings": ["created_at"],
    "product_search_documents": ["updated_at"],
}


def struct_type(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def columns(table: str) -> list[str]:
    return [part.split()[0] for part in DDL[table].split(", ")]
