"""Plain SQL for the registered queries, written apart from the Spark plans.

Each query is put together from named parts; a part lists the parts it reads.
"""

from __future__ import annotations

from shelfseek import fixtures as fx, schema

WORD = r"[\p{L}\p{N}]+"
COMPOUND = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _clean(column: str) -> str:
    trimmed = rf"lower(regexp_replace({column}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'))"
    return f"CASE WHEN NOT regexp_full_match({trimmed}, '\\s*') THEN {trimmed} END"


def _normalized(raw: str) -> str:
    junk = r"[^\p{L}\p{Nl}\p{Nd}\s\-'']"
    return (f"trim(lower(regexp_replace(strip_accents(regexp_replace(coalesce({raw}, ''), "
            f"'{junk}', ' ', 'g')), '\\s+', ' ', 'g')))")


def _fold(column: str) -> str:
    return f"replace(strip_accents({column}), 'ß', 'ss')"


def _words(column: str) -> str:
    words = f"regexp_extract_all(lower({_fold(column)}), '{COMPOUND}')"
    return (f"flatten(list_transform({words}, lambda w: CASE WHEN contains(w, '-') "
            f"THEN list_concat([w], string_split(w, '-')) ELSE [w] END))")


def _grams(column: str) -> str:
    words = f"list_distinct(regexp_extract_all(lower({column}), '{WORD}'))"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform("
            f"range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


FIELD_CLASSES = [("lexical_title", "A"), ("lexical_company", "B"), ("category_title", "B"),
                 ("subcategory_title", "C"), ("leaf_category_title", "C")]


def _postings(docs: str) -> str:
    tagged = ", ".join(
        f"list_transform({_words(f'coalesce({name}, chr(32))')}, lambda t: "
        f"{{'term': t, 'weight': '{weight}'}})"
        for name, weight in FIELD_CLASSES)
    joined = tagged.split(", list_transform(")
    nested = joined[0]
    for part in joined[1:]:
        nested = f"list_concat({nested}, list_transform({part})"
    return (f"SELECT product_id, w.term AS term, CAST(pos AS INTEGER) AS pos, w.weight AS weight "
            f"FROM (SELECT product_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos "
            f"FROM (SELECT product_id, {nested} AS words FROM {docs}))")


MONEY = "CAST(round(l_extendedprice * 100) AS BIGINT)"
KEPT = "(100 - CAST(round(l_discount * 100) AS BIGINT))"

PARTS: dict[str, tuple[list[str], str]] = {
    "categories": ([], """
        SELECT CAST(r_regionkey AS VARCHAR) AS uuid, r_name AS category_title,
               lower(replace(r_name, ' ', '-')) AS slug FROM region"""),
    "subcategories": ([], """
        SELECT CAST(n_nationkey AS VARCHAR) AS uuid, n_name AS sub_category_title,
               lower(replace(n_name, '_', '-')) AS sub_category_slug,
               CAST(n_regionkey AS VARCHAR) AS category_id FROM nation"""),
    "leaf_categories": ([], """
        SELECT DISTINCT lower(p_type) AS id, CAST(length(p_type) % 7 AS VARCHAR) AS category_id,
               CAST(length(p_type) AS VARCHAR) AS subcategory_id, p_type AS leaf_category_title,
               CASE WHEN length(p_type) > 5 THEN lower(p_type) END AS leaf_category_slug,
               lower(p_type) AS slug FROM part"""),
    "products": ([], """
        SELECT CAST(p_partkey AS VARCHAR) AS id,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN ''
                    ELSE p_name END AS title,
               'https://shop.example/p/' || p_partkey AS product_url,
               CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 5 THEN ''
                    ELSE 'https://img.example/' || p_partkey || '.jpg' END AS image_url,
               CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS company,
               CAST(p_partkey % 5 AS VARCHAR) AS category_id,
               CAST(p_partkey % 25 AS VARCHAR) AS subcategory_id,
               lower(p_type) AS leaf_category_id,
               TIMESTAMP '2024-01-01' AS created_at,
               CAST(DATE '1999-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS TIMESTAMP)
                   AS updated_at
        FROM part"""),
    "product_details": ([], f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {MONEY}) AS id,
               CAST(l_partkey AS VARCHAR) AS product_id,
               CAST(l_orderkey AS VARCHAR) AS scrape_run_id,
               CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS scraped_at,
               p_name AS product_title, s_name AS supplier_name,
               {MONEY} AS original_cents,
               CASE WHEN l_linestatus = 'F' THEN {MONEY} END AS original_usd_cents,
               CASE WHEN l_returnflag <> 'R' THEN ({MONEY} * {KEPT} + 50) // 100 END
                   AS promotional_cents,
               l_shipdate AS created_at
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"""),
    "latest_details": (["product_details"], """
        SELECT * FROM product_details QUALIFY row_number() OVER (PARTITION BY product_id
            ORDER BY scraped_at DESC NULLS LAST, created_at DESC NULLS LAST, id) = 1"""),
    "product_embeddings": ([], """
        SELECT 'e' || vec_id AS id, CAST(vec_id AS VARCHAR) AS product_id, embedding,
               'clip-vit-base-patch32' AS model_version
        FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)"""),
    "product_embedding_status": ([], """
        SELECT 's' || p_partkey AS id, CAST(p_partkey AS VARCHAR) AS product_id,
               CASE p_size % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRY' ELSE 'FAILED' END AS status,
               CASE p_size % 4 WHEN 0 THEN TIMESTAMP '2000-01-01' WHEN 1 THEN TIMESTAMP '2001-01-01'
                   END AS next_retry_at
        FROM part WHERE p_size <= 20"""),
    "product_embedding_attempts": ([], """
        SELECT CAST(event_id AS VARCHAR) AS id,
               CAST(event_id % (SELECT count(*) FROM part) AS VARCHAR) AS product_id,
               CASE WHEN event_type IN ('error', 'signup') THEN 'RETRY' WHEN event_type = 'view'
                   THEN 'PENDING' ELSE 'FAILED' END AS status,
               CASE WHEN event_type = 'error' THEN TIMESTAMP '2001-01-01' END AS next_retry_at, ts
        FROM events"""),
    "product_detail_variants": ([], f"""
        SELECT 'v' || key AS uuid, product_id,
               CASE WHEN variant_index = 7 THEN 'gone-' || CAST(part % 50 AS VARCHAR) ELSE key END
                   AS product_detail_id, variant_index, created_at
        FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {MONEY}) AS key,
                     CAST(l_partkey AS VARCHAR) AS product_id, l_partkey AS part,
                     l_linenumber AS variant_index,
                     CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS created_at
              FROM lineitem)"""),
    "product_search_documents": (["docs"], "SELECT * FROM docs"),
    "product_scrape_results": ([], """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS scrape_run_id,
               CAST(event_id % (SELECT count(*) FROM part) AS VARCHAR) AS product_id,
               CAST(round(value * 100) AS BIGINT) / 100.0 AS price,
               event_type AS scrape_status, ts AS scraped_at FROM events"""),
    "scrape_runs": ([], """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS keyword,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 6 AS VARCHAR) END AS category_id,
               NULL::VARCHAR AS subcategory_id, NULL::VARCHAR AS leaf_category_id,
               o_orderstatus AS status FROM orders"""),
    "docs": (["products", "latest_details", "categories", "subcategories", "leaf_categories"], f"""
        SELECT p.id AS product_id, coalesce(nullif(p.title, ''), d.product_title) AS title,
               p.product_url, p.image_url,
               coalesce(nullif(p.company, ''), d.supplier_name) AS company,
               c.uuid AS category_id, c.category_title, c.slug AS category_slug,
               s.sub_category_title AS subcategory_title, s.sub_category_slug AS subcategory_slug,
               l.leaf_category_title, coalesce(l.leaf_category_slug, l.slug) AS leaf_category_slug,
               coalesce(original_cents, promotional_cents) / 100.0 AS original_price,
               coalesce(original_usd_cents, promotional_cents, original_cents) / 100.0
                   AS sortable_price,
               lower({_fold('''concat_ws(' ', p.id, p.title, d.product_title, p.company,
                   d.supplier_name, c.category_title, c.slug, s.sub_category_title,
                   s.sub_category_slug, l.leaf_category_title, l.leaf_category_slug)''')})
                   AS search_text,
               greatest(coalesce(p.updated_at, p.created_at),
                        coalesce(d.scraped_at, d.created_at)) AS updated_at,
               coalesce(p.title, d.product_title, '') AS lexical_title,
               coalesce(p.company, d.supplier_name, '') AS lexical_company
        FROM products p LEFT JOIN latest_details d ON d.product_id = p.id
        LEFT JOIN categories c ON c.uuid = p.category_id
        LEFT JOIN subcategories s ON s.uuid = p.subcategory_id
        LEFT JOIN leaf_categories l ON l.id = p.leaf_category_id"""),
    "changed": (["product_scrape_results"], """
        SELECT DISTINCT product_id FROM product_scrape_results WHERE scrape_status = 'purchase'"""),
    "label_vectors": ([], """
        SELECT label, list(x ORDER BY place) AS q_embedding FROM (
            SELECT label, place, CAST(round(avg(CAST(x AS DOUBLE)), 6) AS FLOAT) AS x FROM (
                SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place
                FROM embeddings) GROUP BY label, place) GROUP BY label"""),
    "asked": ([], "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(_text(v) for v in row) + ")" for row in fx.QUERY_ROWS)
        + ") t(q_id, raw, category, shop, min_price, max_price, sort, page, size, label)"),
    "asked_names": ([], """
        SELECT raw AS q_id, raw, NULL::VARCHAR AS category, NULL::VARCHAR AS shop,
               NULL::DOUBLE AS min_price, NULL::DOUBLE AS max_price, NULL::VARCHAR AS sort,
               0 AS page, 20 AS size, NULL::INTEGER AS label
        FROM (SELECT p_name AS raw FROM part UNION SELECT p_brand FROM part UNION
              SELECT p_type FROM part UNION SELECT n_name FROM nation UNION
              SELECT r_name FROM region)"""),
    "asked_prices": (["docs"], """
        SELECT product_id AS q_id, 'anything' AS raw,
               CASE WHEN CAST(product_id AS BIGINT) % 3 = 0 THEN category_title END AS category,
               CASE WHEN CAST(product_id AS BIGINT) % 5 = 0 THEN company END AS shop,
               CASE WHEN CAST(product_id AS BIGINT) % 7 <> 0 THEN sortable_price - 50e0 END AS min_price,
               CASE WHEN CAST(product_id AS BIGINT) % 7 < 6 THEN sortable_price + 50e0 END AS max_price,
               NULL::VARCHAR AS sort, 0 AS page, 20 AS size, NULL::INTEGER AS label FROM docs"""),
    "fields": (["docs"], """
        SELECT product_id, updated_at, sortable_price, lower(product_id) AS id_lower,
               lower(coalesce(title, '')) AS title_lower,
               lower(coalesce(company, '')) AS company_lower,
               lower(category_id) AS f_category_id, lower(coalesce(category_title, '')) AS category_lower,
               lower(coalesce(category_slug, '')) AS category_slug_lower,
               lower(coalesce(subcategory_title, '')) AS subcategory_lower,
               lower(coalesce(subcategory_slug, '')) AS subcategory_slug_lower,
               lower(coalesce(leaf_category_title, '')) AS leaf_category_lower,
               lower(coalesce(leaf_category_slug, '')) AS leaf_category_slug_lower FROM docs"""),
    "filtered": (["fields", "queries"], """
        SELECT q.*, f.* FROM queries q JOIN fields f ON
            (f_category IS NULL OR f_category IN (f_category_id, category_slug_lower, category_lower,
                subcategory_slug_lower, subcategory_lower, leaf_category_slug_lower,
                leaf_category_lower))
            AND (f_shop IS NULL OR company_lower = f_shop)
            AND (f_min IS NULL OR sortable_price >= f_min)
            AND (f_max IS NULL OR sortable_price <= f_max)
        WHERE NOT blank"""),
    "exact": (["filtered"], """
        SELECT q_id, product_id, score FROM (
            SELECT q_id, product_id, updated_at, depth,
                CASE WHEN id_lower = normalized THEN 1e0
                     WHEN title_lower = normalized THEN 0.92e0
                     WHEN starts_with(title_lower, normalized) THEN 0.75e0
                     WHEN company_lower = normalized THEN 0.6e0
                     WHEN category_lower = normalized OR category_slug_lower = normalized THEN 0.55e0
                     WHEN subcategory_lower = normalized OR subcategory_slug_lower = normalized
                         THEN 0.5e0
                     WHEN leaf_category_lower = normalized OR leaf_category_slug_lower = normalized
                         THEN 0.48e0 END AS score
            FROM filtered) WHERE score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY q_id
            ORDER BY score DESC, updated_at DESC NULLS LAST, product_id) <= depth"""),
    "postings": (["docs"], _postings("docs")),
    "tokens": (["queries"], r"""
        SELECT q_id, i, tok, tok = 'or' AND i > 1 AND i < n AS is_or FROM (
            SELECT q_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i, len(toks) AS n
            FROM (SELECT q_id, string_split(normalized, ' ') AS toks FROM queries WHERE NOT blank))"""),
    "operands": (["tokens"], f"""
        SELECT q_id, g, i, negated, len(seq) AS m, unnest(seq) AS term, generate_subscripts(seq, 1) AS j FROM (
            SELECT q_id, g, i, starts_with(tok, '-') AS negated,
                   CASE WHEN len(regexp_extract_all({_fold('tok')}, '{COMPOUND}')) > 1 THEN {_words('tok')}
                        ELSE regexp_extract_all({_fold('tok')}, '{COMPOUND}') END AS seq FROM (
                SELECT q_id, i, tok, is_or, sum(CASE WHEN is_or THEN 1 ELSE 0 END)
                    OVER (PARTITION BY q_id ORDER BY i) AS g FROM tokens) WHERE NOT is_or)"""),
    "required": (["operands"], "SELECT DISTINCT q_id, g, term FROM operands WHERE NOT negated"),
    "excluded": (["operands"], "SELECT DISTINCT q_id, g, term FROM operands WHERE negated AND m = 1"),
    "runs": (["operands", "postings"], """
        SELECT o.q_id, o.g, o.i, o.negated, p.product_id, p.pos - o.j + 1 AS start, p.pos - o.j + o.m AS stop
        FROM operands o JOIN postings p USING (term) WHERE o.m > 1
        GROUP BY ALL HAVING count(DISTINCT o.j) = any_value(o.m)"""),
    "needs": (["required", "operands"], """
        SELECT o.q_id, o.g, count(DISTINCT r.term) AS n_req
        FROM (SELECT DISTINCT q_id, g FROM operands) o
        LEFT JOIN required r ON r.q_id = o.q_id AND r.g = o.g GROUP BY o.q_id, o.g"""),
    "units": (["required", "operands"], """
        SELECT q_id, g, term, NULL::BIGINT AS i FROM required
        WHERE (q_id, g, term) NOT IN (SELECT (q_id, g, term) FROM operands WHERE m > 1 AND NOT negated)
        UNION ALL SELECT DISTINCT q_id, g, NULL, i FROM operands WHERE m > 1 AND NOT negated"""),
    "barred": (["excluded", "postings", "runs"], """
        SELECT DISTINCT e.q_id, e.g, p.product_id FROM excluded e JOIN postings p USING (term)
        UNION SELECT q_id, g, product_id FROM runs WHERE negated"""),
    "alive": (["required", "postings", "needs", "barred", "units", "runs"], """
        SELECT q_id, g, product_id FROM (
            SELECT r.q_id, r.g, p.product_id FROM required r JOIN postings p USING (term)
            JOIN needs n ON n.q_id = r.q_id AND n.g = r.g
            GROUP BY r.q_id, r.g, p.product_id, n.n_req HAVING count(DISTINCT term) = n.n_req) h
        WHERE (SELECT count(*) FROM units u WHERE u.q_id = h.q_id AND u.g = h.g AND u.i IS NOT NULL)
            = (SELECT count(DISTINCT r.i) FROM runs r WHERE r.q_id = h.q_id AND r.g = h.g
               AND r.product_id = h.product_id AND NOT r.negated)
        EXCEPT SELECT q_id, g, product_id FROM barred"""),
    "term_hits": (["required", "postings", "alive"], """
        SELECT q_id, product_id, term, pos, inv,
               row_number() OVER w AS n, sum(inv) OVER w AS cinv FROM (
            SELECT t.q_id, p.product_id, p.term, p.pos, CASE p.weight WHEN 'A' THEN 1e0
                WHEN 'B' THEN 1 / 0.4e0 WHEN 'C' THEN 1 / 0.2e0 ELSE 1 / 0.1e0 END AS inv
            FROM (SELECT DISTINCT q_id, term FROM required) t JOIN postings p USING (term)
            WHERE (t.q_id, p.product_id) IN (SELECT (q_id, product_id) FROM alive))
        WINDOW w AS (PARTITION BY q_id, product_id ORDER BY pos)"""),
    "covers": (["term_hits", "alive", "units", "runs"], """
        SELECT q_id, product_id, s, min(e) AS e FROM (
            SELECT q_id, product_id, e, max(s) AS s FROM (
                SELECT q_id, product_id, e, g, min(l) AS s FROM (
                    SELECT e.q_id, e.product_id, e.pos AS e, u.g, u.term, u.i, max(h.pos) AS l
                    FROM term_hits e
                    JOIN alive a ON a.q_id = e.q_id AND a.product_id = e.product_id
                    JOIN units u ON u.q_id = a.q_id AND u.g = a.g
                    JOIN term_hits h ON h.q_id = e.q_id AND h.product_id = e.product_id
                        AND h.term = u.term AND h.pos <= e.pos
                    GROUP BY ALL
                    UNION ALL
                    SELECT e.q_id, e.product_id, e.pos, a.g, NULL, r.i, max(r.start)
                    FROM term_hits e
                    JOIN alive a ON a.q_id = e.q_id AND a.product_id = e.product_id
                    JOIN runs r ON r.q_id = a.q_id AND r.g = a.g AND r.product_id = a.product_id
                        AND NOT r.negated AND r.stop <= e.pos
                    GROUP BY ALL) x
                JOIN (SELECT q_id, g, count(*) AS n_units FROM units GROUP BY ALL) USING (q_id, g)
                GROUP BY q_id, product_id, e, g, n_units HAVING count(*) = n_units)
            GROUP BY q_id, product_id, e)
        GROUP BY q_id, product_id, s"""),
    "ranked": (["covers", "term_hits"], """
        SELECT q_id, product_id, round(rank / (rank + 1), 9) AS score FROM (
            SELECT c.q_id, c.product_id, sum(
                (e.n - s.n + 1) / (e.cinv - s.cinv + s.inv) / (1 + (e.pos - s.pos) - (e.n - s.n)))
                AS rank
            FROM covers c
            JOIN term_hits s ON s.q_id = c.q_id AND s.product_id = c.product_id AND s.pos = c.s
            JOIN term_hits e ON e.q_id = c.q_id AND e.product_id = c.product_id AND e.pos = c.e
            GROUP BY c.q_id, c.product_id)"""),
    "matched": (["ranked", "needs", "barred", "docs"], """
        SELECT q_id, product_id, max(score) AS score FROM (
            SELECT * FROM ranked UNION ALL
            SELECT n.q_id, d.product_id, 0e0 FROM needs n CROSS JOIN docs d
            WHERE n.n_req = 0 AND NOT EXISTS (SELECT 1 FROM barred b WHERE b.q_id = n.q_id
                AND b.g = n.g AND b.product_id = d.product_id))
        GROUP BY q_id, product_id"""),
    "lexical": (["matched", "filtered"], """
        SELECT m.q_id, m.product_id, m.score FROM matched m
        JOIN filtered f ON f.q_id = m.q_id AND f.product_id = m.product_id
        QUALIFY row_number() OVER (PARTITION BY m.q_id
            ORDER BY m.score DESC, f.updated_at DESC NULLS LAST, m.product_id) <= f.depth"""),
    "value_grams": (["fields"], f"""
        SELECT value, {_grams('value')} AS grams FROM (
            SELECT title_lower AS value FROM fields UNION SELECT company_lower FROM fields
            UNION SELECT category_lower FROM fields UNION SELECT subcategory_lower FROM fields
            UNION SELECT leaf_category_lower FROM fields)"""),
    "similarities": (["value_grams", "queries"], f"""
        SELECT q_id, value, coalesce(shared / nullif(len(a) + len(b) - shared, 0), 0) AS s FROM (
            SELECT q_id, value, a, grams AS b, CAST(len(list_intersect(a, grams)) AS DOUBLE) AS shared
            FROM (SELECT q_id, {_grams('normalized')} AS a FROM queries WHERE NOT blank), value_grams)"""),
    "trigram": (["filtered", "similarities"], """
        SELECT q_id, product_id, score FROM (
            SELECT f.q_id, f.product_id, f.updated_at, f.depth, f.threshold,
                   round(max(s.s * f.weight), 9) AS score
            FROM (SELECT q_id, product_id, updated_at, depth, threshold,
                         unnest([title_lower, company_lower, category_lower, subcategory_lower,
                                 leaf_category_lower]) AS value,
                         unnest([1e0, 0.75e0, 0.7e0, 0.62e0, 0.6e0]) AS weight FROM filtered) f
            JOIN similarities s ON s.q_id = f.q_id AND s.value = f.value
            GROUP BY ALL)
        WHERE score >= threshold
        QUALIFY row_number() OVER (PARTITION BY q_id
            ORDER BY score DESC, updated_at DESC NULLS LAST, product_id) <= depth"""),
    "semantic": (["filtered", "product_embeddings"], """
        SELECT q_id, product_id, greatest(0e0, similarity) AS score FROM (
            SELECT f.q_id, f.product_id, f.updated_at, f.vector_depth, round(list_cosine_similarity(
                CAST(v.embedding AS DOUBLE[]), CAST(f.q_embedding AS DOUBLE[])), 9) AS similarity
            FROM filtered f JOIN product_embeddings v ON v.product_id = f.product_id
            WHERE f.q_embedding IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY q_id
            ORDER BY similarity DESC, updated_at DESC NULLS LAST, product_id) <= vector_depth"""),
    "scored": (["exact", "lexical", "trigram", "semantic", "queries", "docs"], """
        SELECT q.q_id, q.normalized, q.threshold, q.sort, q.page, q.size, d.*, m.exact_score,
               m.lexical_score, m.trigram_score, m.semantic_score,
               lower(coalesce(d.title, '')) AS title_lower,
               round(exact_score * 0.38e0 + least(1e0, lexical_score * 3e0) * 0.32e0
                   + least(1e0, trigram_score) * 0.12e0
                   + least(1e0, greatest(0e0, semantic_score)) * 0.18e0, 9) AS final_score
        FROM (SELECT q_id, product_id, max(e) AS exact_score, max(l) AS lexical_score,
                     max(t) AS trigram_score, max(s) AS semantic_score FROM (
                SELECT q_id, product_id, score AS e, 0e0 AS l, 0e0 AS t, 0e0 AS s FROM exact
                UNION ALL SELECT q_id, product_id, 0e0, score, 0e0, 0e0 FROM lexical
                UNION ALL SELECT q_id, product_id, 0e0, 0e0, score, 0e0 FROM trigram
                UNION ALL SELECT q_id, product_id, 0e0, 0e0, 0e0, score FROM semantic)
              GROUP BY q_id, product_id) m
        JOIN queries q ON q.q_id = m.q_id JOIN docs d ON d.product_id = m.product_id"""),
    "page": (["scored"], """
        SELECT q_id, rank, product_id, title, company, category_title, original_price,
               strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, exact_score, lexical_score,
               trigram_score, semantic_score, final_score,
               CASE WHEN product_id = normalized THEN 'exact_id'
                    WHEN title_lower = normalized THEN 'exact_title'
                    WHEN starts_with(title_lower, normalized) THEN 'prefix_title'
                    WHEN exact_score > 0 THEN 'exact_attribute'
                    WHEN lexical_score > 0 AND semantic_score > 0 THEN 'hybrid'
                    WHEN semantic_score > 0 THEN 'semantic'
                    WHEN trigram_score >= threshold THEN 'fuzzy'
                    WHEN lexical_score > 0 THEN 'full_text' ELSE 'related' END AS match_type,
               CASE WHEN product_id = normalized THEN title || ' | ' || product_id
                    WHEN contains(lower(company), normalized) THEN title || ' | ' || company
                    WHEN contains(lower(category_title), normalized)
                        THEN title || ' | ' || category_title
                    ELSE title END AS highlight,
               coalesce(nullif(concat_ws(',', CASE WHEN product_id = normalized THEN 'id' END,
                    CASE WHEN contains(title_lower, normalized) THEN 'title' END,
                    CASE WHEN contains(lower(company), normalized) THEN 'company' END,
                    CASE WHEN contains(lower(category_title), normalized) THEN 'category' END,
                    CASE WHEN semantic_score > 0 THEN 'semantic' END), ''), 'title')
                    AS matched_fields,
               total, total > page * size + size AS has_more
        FROM (SELECT *, count(*) OVER (PARTITION BY q_id) AS total,
                row_number() OVER (PARTITION BY q_id ORDER BY
                    CASE WHEN sort = 'price_asc' THEN sortable_price END ASC NULLS LAST,
                    CASE WHEN sort = 'price_desc' THEN sortable_price END DESC NULLS LAST,
                    CASE WHEN sort = 'title' THEN lower(title) END ASC NULLS LAST,
                    CASE WHEN sort = 'newest' THEN updated_at END DESC NULLS LAST,
                    final_score DESC, updated_at DESC NULLS LAST, product_id) AS rank
              FROM scored)
        WHERE rank > page * size AND rank <= page * size + size"""),
    "alike": (["docs", "product_embeddings", "label_vectors"], """
        SELECT CAST(label AS VARCHAR) AS q_id, product_id, similarity, updated_at FROM (
            SELECT l.label, d.product_id, d.updated_at, round(list_cosine_similarity(
                CAST(v.embedding AS DOUBLE[]), CAST(l.q_embedding AS DOUBLE[])), 9) AS similarity
            FROM label_vectors l CROSS JOIN product_embeddings v
            JOIN docs d ON d.product_id = v.product_id WHERE d.image_url IS NOT NULL)
        WHERE similarity >= 0.2"""),
    "similar_ranked": (["alike"], """
        SELECT *, count(*) OVER (PARTITION BY q_id) AS total, row_number() OVER (PARTITION BY q_id
            ORDER BY similarity DESC, updated_at DESC NULLS LAST, product_id) AS rank FROM alike"""),
    "near_all": (["docs", "product_embeddings"], """
        SELECT q.product_id AS q_id, d.product_id, d.updated_at, round(list_cosine_similarity(
                   CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS similarity
        FROM product_embeddings q CROSS JOIN product_embeddings v
        JOIN docs d ON d.product_id = v.product_id
        WHERE CAST(q.product_id AS BIGINT) % 50 = 0 AND d.image_url IS NOT NULL"""),
    "offers": (["docs"], """
        SELECT DISTINCT suggestion, priority, key FROM (
            SELECT title AS suggestion, 1 AS priority, lower(title) AS key FROM docs UNION ALL
            SELECT company, 2, lower(company) FROM docs UNION ALL
            SELECT category_title, 3, lower(category_title) FROM docs UNION ALL
            SELECT category_title, 3, lower(category_slug) FROM docs UNION ALL
            SELECT subcategory_title, 4, lower(subcategory_title) FROM docs UNION ALL
            SELECT subcategory_title, 4, lower(subcategory_slug) FROM docs UNION ALL
            SELECT leaf_category_title, 5, lower(leaf_category_title) FROM docs UNION ALL
            SELECT leaf_category_title, 5, lower(leaf_category_slug) FROM docs)
        WHERE suggestion <> '' AND key IS NOT NULL"""),
    "outcomes": (["products", "product_embeddings"], """
        SELECT product_id, CASE WHEN reason IS NULL THEN 'indexed'
                   WHEN reason IN ('no image', 'already embedded') THEN 'skipped'
                   ELSE 'failed' END AS status, reason,
               CASE reason WHEN 'answer 404' THEN 404 WHEN 'answer 503' THEN 503 END AS http_status,
               CASE WHEN reason LIKE 'answer%' THEN reason <> 'answer 404' END AS retryable,
               CASE WHEN reason IS NULL THEN 512 END AS width FROM (
            SELECT i.product_id, CASE WHEN p.id IS NULL THEN 'product not found'
                WHEN coalesce(trim(p.image_url), '') = '' THEN 'no image'
                WHEN i.product_id IN (SELECT product_id FROM product_embeddings)
                    THEN 'already embedded'
                WHEN CAST(i.product_id AS BIGINT) % 17 = 0 THEN 'answer 404'
                WHEN CAST(i.product_id AS BIGINT) % 19 = 0 THEN 'answer 503'
                WHEN CAST(i.product_id AS BIGINT) % 23 = 0 THEN 'answer None' END AS reason
            FROM (SELECT CAST(user_id AS VARCHAR) AS product_id FROM events UNION
                  SELECT id FROM products UNION SELECT 'c' || c_custkey FROM customer) i
            LEFT JOIN products p ON p.id = i.product_id)"""),
}


def _queries_part(source: str, embedded: bool, **fixed) -> tuple[list[str], str]:
    """Normalised queries over ``source``, with some parameters fixed for all."""
    def value(name):
        return _text(fixed[name]) if name in fixed else f"a.{name}"

    page = f"CASE WHEN {value('page')} >= 0 THEN {value('page')} ELSE 0 END"
    size = f"CASE WHEN {value('size')} > 0 THEN least({value('size')}, 60) ELSE 20 END"
    sort = f"coalesce({_clean('CAST(' + value('sort') + ' AS VARCHAR)')}, 'relevance')"
    vector = fixed.pop("vector", "l.q_embedding" if embedded else "NULL::FLOAT[]")
    join = "LEFT JOIN label_vectors l ON l.label = a.label" if embedded else ""
    return ([source, "label_vectors"] if embedded else [source], f"""
        SELECT *, CASE WHEN length(normalized) <= 3 THEN 0.55e0 WHEN length(normalized) <= 6
                   THEN 0.4e0 ELSE 0.3e0 END AS threshold,
               greatest((page + 1) * size * 4, 80) AS depth,
               greatest((page + 1) * size * 2, 40) AS vector_depth, len(list_filter(
                   string_split(normalized, ' '), lambda t: length(t) >= 2
                   AND trim(replace(t, '''', '')) <> '')) = 0 AS blank
        FROM (SELECT a.q_id, {_normalized('a.raw')} AS normalized,
                     {_clean('CAST(' + value('category') + ' AS VARCHAR)')} AS f_category,
                     {_clean('CAST(' + value('shop') + ' AS VARCHAR)')} AS f_shop,
                     CAST({value('min_price')} AS DOUBLE) AS f_min,
                     CAST({value('max_price')} AS DOUBLE) AS f_max, {sort} AS sort,
                     {page} AS page, {size} AS size, {vector} AS q_embedding
              FROM {source} a {join})""")


def assemble(select: str, parts: dict[str, tuple[list[str], str]], *roots: str) -> str:
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for needed in parts[name][0]:
            visit(needed)
        order.append(name)

    for root in roots:
        visit(root)
    # Parts read several times are computed once.
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({parts[n][1]})" for n in order) + " " + select


def _search(source="asked", embedded=True, select="SELECT * FROM page", roots=("page",), **fixed):
    parts = {**PARTS, "queries": _queries_part(source, embedded, **fixed)}
    return assemble(select, parts, *roots)


def _orphans() -> str:
    checks = []
    for table, column, parent, key, _ in schema.REFERENCES:
        checks.append(
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
            f"{column} AS missing_key, count(*) AS n_rows FROM {table} "
            f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent}) "
            f"GROUP BY {column}")
    return assemble(" UNION ALL ".join(checks), PARTS, *schema.REQUIRED)


# Required columns that the test catalogue has no values for.
ABSENT = {
    "product_scrape_results": ["badges"],
    "product_details": ["quantity_price_tiers", "discount_rules", "pricing", "availability",
                        "variants", "attributes", "media", "meta"],
}


def _null_violations() -> str:
    checks = [f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS n_rows FROM {table}"
              for table, columns in ABSENT.items() for column in columns]
    checks += [f"SELECT '{table}', '{column}', count(*) FROM {table} WHERE {column} IS NULL"
               for table, column in (("leaf_categories", "leaf_category_slug"),
                                     ("product_detail_variants", "created_at"))]
    return assemble(f"SELECT * FROM ({' UNION ALL '.join(checks)}) WHERE n_rows > 0", PARTS,
                    *ABSENT, "leaf_categories", "product_detail_variants")


def _duplicates() -> str:
    checks, tables = [], []
    for table, columns in schema.UNIQUE_KEYS:
        tables.append(table)
        names = ", ".join(columns)
        known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
        checks.append(f"SELECT '{table}' AS table_name, '{','.join(columns)}' AS key_columns, "
                      f"concat_ws(',', {names}) AS key_value, count(*) AS n_rows FROM {table} "
                      f"WHERE {known} GROUP BY {names} HAVING count(*) > 1")
    return assemble(" UNION ALL ".join(checks), PARTS, *tables)


DOCUMENT_COLUMNS = schema.columns("product_search_documents")
STAMP = "'%Y-%m-%d %H:%M:%S'"
SYNCED = f"""
    SELECT product_id, CASE WHEN c THEN title ELSE 'outdated' END AS title, company,
           CASE WHEN c THEN sortable_price END AS sortable_price,
           strftime(updated_at, {STAMP}) AS updated_at
    FROM (SELECT *, product_id IN (SELECT product_id FROM changed) AS c FROM docs)"""
TITLE_CASE = ("array_to_string(list_transform(string_split(replace({0}, '-', ' '), ' '), "
              "lambda w: upper(w[1]) || lower(w[2:])), ' ')")
SIMILAR_PAGE = """
    SELECT r.q_id, r.rank, d.product_id, d.title, d.company, d.category_title,
           floor(r.similarity * 10000 + 0.5) / 10000 AS similarity, d.original_price,
           'image' AS match_type, d.title AS highlight, 'image,semantic' AS matched_fields,
           r.total, r.total > {end} AS has_more
    FROM similar_ranked r JOIN docs d USING (product_id) WHERE r.rank > {start} AND r.rank <= {end}"""


def oracle_sql() -> dict[str, str]:
    shown = ", ".join("strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"
                      if c == "updated_at" else c for c in DOCUMENT_COLUMNS)
    sql = {
        "latest_detail": assemble(f"""
            SELECT product_id, id, strftime(scraped_at, {STAMP}) AS scraped_at,
                   strftime(created_at, {STAMP}) AS created_at, product_title, supplier_name,
                   original_cents / 100.0 AS original_price FROM latest_details""",
                                  PARTS, "latest_details"),
        "latest_scrape": assemble("""
            SELECT product_id, id, scrape_status, price FROM product_scrape_results
            QUALIFY row_number() OVER (PARTITION BY product_id
                ORDER BY scraped_at DESC NULLS LAST, id) = 1""", PARTS, "product_scrape_results"),
        "build_documents": assemble(f"SELECT {shown} FROM docs", PARTS, "docs"),
        "sync_documents": assemble(SYNCED, PARTS, "docs", "changed"),
        "stream_sync": assemble(f"""
            SELECT product_id, title, company, sortable_price, strftime(updated_at, {STAMP}) AS updated_at
            FROM docs""", PARTS, "docs"),
        "sync_status": assemble("""
            SELECT product_id, CASE WHEN NOT regexp_full_match(product_id, '[0-9]+') THEN 'rejected'
                WHEN product_id IN (SELECT id FROM products) THEN 'indexed'
                ELSE 'missing' END AS status
            FROM (SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'x' ELSE '' END || user_id
                      AS product_id FROM events)""", PARTS, "products"),
        "delete_documents": assemble("""
            SELECT product_id, title FROM docs
            WHERE product_id NOT IN (SELECT product_id FROM changed)""", PARTS, "docs", "changed"),
        "vector_codec": """
            SELECT vec_id, len(embedding) AS width, true AS same,
                   round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, 1e0 AS unit
            FROM embeddings""",
        "normalize_queries": f"""
            SELECT q_id, normalized, array_to_string(list_transform(tokens, lambda t: t || ':*'),
                       ' & ') AS ts_query, array_to_string(tokens, ' <-> ') AS phrase_query,
                   len(tokens) AS n_tokens, role AS f_category, 'relevance' AS sort, page, size,
                   CASE WHEN length(normalized) <= 3 THEN 0.55e0 WHEN length(normalized) <= 6
                       THEN 0.4e0 ELSE 0.3e0 END AS threshold,
                   greatest((page + 1) * size * 4, 80) AS depth,
                   greatest((page + 1) * size * 2, 40) AS vector_depth, len(tokens) = 0 AS blank
            FROM (SELECT *, list_filter(list_transform(list_filter(string_split(normalized, ' '),
                      lambda t: length(t) >= 2), lambda t: replace(t, '''', '')),
                      lambda t: trim(t) <> '') AS tokens
                  FROM (SELECT conv_id || '-' || turn AS q_id, {_normalized('text')} AS normalized,
                               role, turn AS page,
                               CASE WHEN length(text) > 0 THEN least(length(text), 60) ELSE 20 END
                                   AS size FROM conversations))""",
        "filter_documents": _search(embedded=False, roots=("filtered",),
                                    select="SELECT q_id, product_id FROM filtered"),
        "filter_pages": _search("asked_prices", embedded=False, roots=("filtered",), select="""
            SELECT q.q_id, coalesce(total, 0) AS total, coalesce(first, '') AS first FROM queries q LEFT JOIN (
                SELECT q_id, max(total) AS total, string_agg(product_id, ',' ORDER BY rank) AS first FROM (
                    SELECT q_id, product_id, count(*) OVER (PARTITION BY q_id) AS total, row_number() OVER (
                        PARTITION BY q_id ORDER BY updated_at DESC NULLS LAST, product_id) AS rank FROM filtered)
                WHERE rank <= 20 GROUP BY q_id) f ON f.q_id = q.q_id WHERE NOT q.blank"""),
        "exact_candidates": _search(embedded=False, roots=("exact",),
                                    select="SELECT q_id, product_id, score FROM exact"),
        "postings": assemble("SELECT product_id, term, pos, weight FROM postings", PARTS, "postings"),
        "lexical_candidates": _search(embedded=False, roots=("lexical",),
                                      select="SELECT q_id, product_id, score FROM lexical"),
        "trigram_candidates": _search(embedded=False, roots=("trigram",),
                                      select="SELECT q_id, product_id, score FROM trigram"),
        "semantic_candidates": _search(roots=("semantic",),
                                       select="SELECT q_id, product_id, score FROM semantic"),
        "hybrid_page2": _search(sort="relevance", page=1, size=15),
        "hybrid_filtered": _search(category=" Asia ", min_price=20000.0, max_price=80000.0, page=0),
        "hybrid_no_embedding": _search(embedded=False),
        "hybrid_batch": _search("asked_names", embedded=False),
        "hybrid_encoded": _search("asked_names", embedded=False, select="""SELECT q_id, rank, product_id, lexical_score,
            semantic_score, match_type, total, has_more FROM page""", vector="""CASE WHEN length(normalized) % 5 <> 0
            THEN list_transform(range(64), lambda i: CAST(CAST(i = length(normalized) % 64 AS INT) AS FLOAT)) END"""),
        "similar_products": assemble(SIMILAR_PAGE.format(start=0, end=50), PARTS,
                                     "similar_ranked", "docs"),
        "similar_page2": assemble(SIMILAR_PAGE.format(start=7, end=14), PARTS,
                                  "similar_ranked", "docs"),
        "similar_count": assemble("""
            SELECT CAST(l.label AS VARCHAR) AS q_id, count(s.q_id) AS total,
                   CAST(ceil(count(s.q_id) / 50.0) AS BIGINT) AS last_page, 1 AS page,
                   50 AS per_page
            FROM label_vectors l LEFT JOIN alike s ON s.q_id = CAST(l.label AS VARCHAR)
            GROUP BY l.label""", PARTS, "alike", "label_vectors"),
        "similar_all_pairs": assemble("""
            SELECT q_id, rank, product_id, floor(similarity * 10000 + 0.5) / 10000 AS similarity,
                   total
            FROM (SELECT *, count(*) OVER (PARTITION BY q_id) AS total,
                         row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC,
                             updated_at DESC NULLS LAST, product_id) AS rank
                  FROM (SELECT a.product_id AS q_id, d.product_id, d.updated_at,
                               round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]),
                                   CAST(a.embedding AS DOUBLE[])), 9) AS similarity
                        FROM product_embeddings a CROSS JOIN product_embeddings b
                        JOIN docs d ON d.product_id = b.product_id WHERE d.image_url IS NOT NULL)
                  WHERE similarity >= 0.3)
            WHERE rank <= 2""", PARTS, "product_embeddings", "docs"),
        "similarity_bands": assemble("""
            SELECT q_id, product_id, CASE WHEN similarity >= 0.8 THEN 'high'
                       WHEN similarity >= 0.6 THEN 'mid' ELSE 'low' END AS band,
                   printf('%.1f', round(similarity * 100, 1)) AS percent
            FROM similar_ranked WHERE rank <= 200""", PARTS, "similar_ranked"),
        "suggestions": assemble(f"""
            SELECT q_id, rank, suggestion, priority FROM (
                SELECT q_id, suggestion, priority, n, row_number() OVER (PARTITION BY q_id
                    ORDER BY priority, length(suggestion), suggestion) AS rank FROM (
                    SELECT DISTINCT q_id, n, suggestion, priority FROM (
                        SELECT q_id, {_normalized('q_id')} AS prefix,
                               CASE WHEN length(q_id) = 3 THEN 5 ELSE 8 END AS n FROM (
                            SELECT DISTINCT left(raw, k) AS q_id FROM asked_names,
                                (VALUES (1), (2), (3), (5)) t(k)))
                    JOIN offers ON starts_with(key, prefix) WHERE length(prefix) >= 2))
            WHERE rank <= n""", PARTS, "offers", "asked_names"),
        "pending_embeddings": assemble(f"""
            SELECT id, strftime(updated_at, {STAMP}) AS updated_at FROM products
            WHERE image_url <> '' AND id NOT IN (SELECT product_id FROM product_embeddings)
            ORDER BY products.updated_at DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 100
            """, PARTS, "products", "product_embeddings"),
        "pending_all": assemble("""
            SELECT id FROM products WHERE image_url <> ''
                AND id NOT IN (SELECT product_id FROM product_embeddings)""",
                                PARTS, "products", "product_embeddings"),
        "pending_retry": assemble("""
            SELECT p.id FROM products p
            LEFT JOIN product_embeddings e ON e.product_id = p.id
            LEFT JOIN product_embedding_status s ON s.product_id = p.id
            WHERE p.image_url IS NOT NULL AND e.id IS NULL
              AND (s.id IS NULL OR s.status IN ('PENDING', 'RETRY'))
              AND (s.next_retry_at IS NULL OR s.next_retry_at <= TIMESTAMP '2000-06-01')""",
                                  PARTS, "products", "product_embeddings",
                                  "product_embedding_status"),
        "pending_attempts": assemble("""
            SELECT p.id FROM products p
            LEFT JOIN product_embeddings e ON e.product_id = p.id
            LEFT JOIN (SELECT * FROM product_embedding_attempts QUALIFY row_number() OVER (
                PARTITION BY product_id ORDER BY ts DESC NULLS LAST, id DESC) = 1) s
                ON s.product_id = p.id
            WHERE p.image_url IS NOT NULL AND e.id IS NULL
              AND (s.id IS NULL OR s.status IN ('PENDING', 'RETRY'))
              AND (s.next_retry_at IS NULL OR s.next_retry_at <= TIMESTAMP '2000-06-01')""",
                                     PARTS, "products", "product_embeddings",
                                     "product_embedding_attempts"),
        "ann_search": assemble("""
            SELECT q_id, count(*) AS wanted, count(*) AS hit, 1e0 AS recall,
                   string_agg(product_id, ',' ORDER BY place) AS neighbours, true AS fewer
            FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC,
                          updated_at DESC NULLS LAST, product_id) AS place FROM near_all)
            WHERE place <= 10 GROUP BY q_id""", PARTS, "near_all"),
        "embed_outcomes": assemble("SELECT * FROM outcomes", PARTS, "outcomes"),
        "embed_counts": assemble("SELECT status, count(*) AS n FROM outcomes GROUP BY status",
                                 PARTS, "outcomes"),
        "index_newest": assemble("""
            SELECT o.product_id, o.status, o.reason, o.retryable FROM outcomes o JOIN (
                SELECT id FROM products
                WHERE image_url <> '' AND id NOT IN (SELECT product_id FROM product_embeddings)
                ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 100) n
            ON n.id = o.product_id""", PARTS, "outcomes", "products", "product_embeddings"),
        "insert_embeddings": assemble("""
            SELECT product_id, id, model_version, len(embedding) AS width FROM product_embeddings
            UNION ALL
            SELECT product_id, min(id), 'clip-vit-base-patch32', 64 FROM (
                SELECT CAST(vec_id * 3 % 700 AS VARCHAR) AS product_id, 'n' || vec_id AS id
                FROM embeddings)
            WHERE product_id NOT IN (SELECT product_id FROM product_embeddings)
            GROUP BY product_id""", PARTS, "product_embeddings"),
        "embed_texts": r"""
            SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN 512 END AS width,
                   CASE WHEN regexp_matches(text, '\S') THEN 1e0 END AS length,
                   CASE WHEN NOT regexp_matches(text, '\S') THEN 'no text to embed' END
                       AS error FROM documents""",
        "catalogue_lookups": assemble("""
            SELECT 'id' AS lookup, id AS key, id AS product_id FROM products
            WHERE id IN (SELECT CAST(event_id AS VARCHAR) FROM events)
            UNION ALL SELECT 'ready', '', id FROM products WHERE image_url IS NOT NULL
                AND id IN (SELECT product_id FROM product_details)
            UNION ALL SELECT 'shop', company, id FROM products WHERE company IS NOT NULL
            UNION ALL SELECT 'category', category_id, id FROM products
                WHERE category_id IN (SELECT uuid FROM categories)""",
                                      PARTS, "products", "product_details", "categories"),
        "orphans": _orphans(),
        "duplicate_keys": _duplicates(),
        "null_violations": _null_violations(),
        "cascade_delete": assemble("""
            SELECT 'categories' AS table_name, count(*) AS n_rows, 0 AS n_with_run FROM categories
            UNION ALL SELECT 'subcategories', count(*), 0 FROM subcategories
            UNION ALL SELECT 'leaf_categories', count(*), 0 FROM leaf_categories
            UNION ALL SELECT 'scrape_runs', count(*), 0 FROM scrape_runs WHERE status <> 'F'
            UNION ALL SELECT 'products', count(*), 0 FROM products
                WHERE id NOT IN (SELECT product_id FROM changed)
            UNION ALL SELECT 'product_scrape_results', count(*), count(*)
                FROM product_scrape_results WHERE product_id NOT IN (SELECT product_id FROM changed)
                AND scrape_run_id NOT IN (SELECT id FROM scrape_runs WHERE status = 'F')
            UNION ALL SELECT 'product_details', count(*), count(*) FILTER (scrape_run_id NOT IN
                (SELECT id FROM scrape_runs WHERE status = 'F'))
                FROM product_details WHERE product_id NOT IN (SELECT product_id FROM changed)
            UNION ALL SELECT 'product_embeddings', count(*), 0 FROM product_embeddings
                WHERE product_id NOT IN (SELECT product_id FROM changed)
            UNION ALL SELECT 'product_search_documents', count(*), 0 FROM docs
                WHERE product_id NOT IN (SELECT product_id FROM changed)
            UNION ALL SELECT 'product_detail_variants', count(*), 0 FROM product_detail_variants
                WHERE product_id NOT IN (SELECT product_id FROM changed)
                AND product_detail_id NOT IN (SELECT id FROM product_details
                    WHERE product_id IN (SELECT product_id FROM changed))""",
                                   PARTS, "product_search_documents", "product_detail_variants", "categories", "subcategories", "leaf_categories",
                                   "scrape_runs", "products", "product_scrape_results",
                                   "product_details", "product_embeddings", "changed"),
        "taxonomy_backfill": assemble(f"""
            SELECT uuid AS id, {TITLE_CASE.format('slug')} AS title, slug FROM categories
            UNION ALL SELECT uuid, CASE WHEN category_id <> '0' THEN sub_category_title
                ELSE {TITLE_CASE.format('sub_category_slug')} END, sub_category_slug
                FROM subcategories
            UNION ALL SELECT id, CASE WHEN length(slug) > 6 THEN leaf_category_title
                ELSE {TITLE_CASE.format('slug')} END, slug FROM leaf_categories""",
                                      PARTS, "categories", "subcategories", "leaf_categories"),
        "conform_schema": f"""
            SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {MONEY}) AS uuid,
                   CAST(l_partkey AS VARCHAR) AS product_id, l_linenumber AS variant_index,
                   CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) END
                       AS stock_quantity, NULL::VARCHAR AS color, NULL::DOUBLE AS price,
                   '2000-06-01 00:00:00' AS created_at, 20 AS n_columns FROM lineitem""",
        "conform_details": assemble("""
            SELECT '[]' AS discount_rules, '{}' AS meta, true AS success, count(*) AS n,
                   sum(original_cents) / 100.0 AS total, 0 AS n_coupon FROM product_details""",
                                    PARTS, "product_details"),
    }
    renamed = ([*PARTS["products"][0], "product_scrape_results"], f"""
        SELECT * REPLACE (CASE WHEN title <> '' AND id IN (SELECT product_id FROM product_scrape_results
            WHERE scrape_status = 'signup') THEN 'new ' || title ELSE title END AS title)
        FROM ({PARTS["products"][1]})""")
    left = ([*PARTS["docs"][0], "changed"], f"""
        SELECT * FROM ({PARTS["docs"][1]}) WHERE product_id NOT IN (SELECT product_id FROM changed)""")
    sql["hybrid_updated"] = assemble("SELECT * FROM page", {
        **PARTS, "products": renamed, "docs": left,
        "queries": _queries_part("asked", True, sort="relevance", page=0)}, "page")
    sql["hybrid_streamed"] = _search(sort="relevance", page=0)
    for mode in ("relevance", "price_asc", "price_desc", "title", "newest"):
        sql[f"hybrid_{mode}"] = _search(sort=mode, page=0)
    articles = {
        "docs": ([], """
            SELECT CAST(doc_id AS VARCHAR) AS product_id, text AS title, source AS company,
                   lang AS category_id, lang AS category_title, lang AS category_slug,
                   NULL::VARCHAR AS subcategory_title, NULL::VARCHAR AS subcategory_slug,
                   NULL::VARCHAR AS leaf_category_title, NULL::VARCHAR AS leaf_category_slug,
                   n_chars AS sortable_price, TIMESTAMP '2024-01-01' AS updated_at,
                   text AS lexical_title, source AS lexical_company FROM documents"""),
        "asked_passages": ([], """
            SELECT CAST(item_id AS VARCHAR) AS q_id, text AS raw, NULL::VARCHAR AS category,
                   NULL::VARCHAR AS shop, NULL::DOUBLE AS min_price, NULL::DOUBLE AS max_price,
                   NULL::VARCHAR AS sort, 0 AS page, 60 AS size FROM benchmark"""),
        "queries": _queries_part("asked_passages", False),
    }
    sql["article_postings"] = assemble("""
        SELECT term, weight, count(*) AS n, count(DISTINCT product_id) AS n_docs,
               sum(pos) AS sum_pos FROM postings GROUP BY term, weight""",
                                       {**PARTS, **articles}, "postings")
    sql["lexical_passages"] = assemble("SELECT q_id, product_id, score FROM lexical",
                                       {**PARTS, **articles}, "lexical")
    beside = {
        "asked_beside": (["asked_passages"], r"""
            SELECT * REPLACE (regexp_replace(raw, '(\S+)\s+(\S+)', '\1''\2', 'g') AS raw) FROM asked_passages"""),
        "queries": _queries_part("asked_beside", False)}
    sql["lexical_phrases"] = assemble("SELECT q_id, product_id, score FROM lexical",
                                      {**PARTS, **articles, **beside}, "lexical")
    sql["suggestions_fallback"] = _fallback_sql()
    listed = """string_agg({0}.product_id, '|' ORDER BY {0}.rank) AS ids,
        string_agg(coalesce({0}.title, '-'), '|' ORDER BY {0}.rank) AS titles,
        string_agg(coalesce(d.category_slug, '-'), '|' ORDER BY {0}.rank) AS slugs,
        round(sum(CAST(coalesce(d.original_price, 0) AS DOUBLE)), 2) AS prices"""
    sql["result_json"] = _search(select=f"""
        SELECT q.q_id, a.raw AS query, CASE WHEN q.blank THEN '' ELSE q.normalized END AS normalized,
               q.page, q.size, coalesce(r.total, 0) AS total, coalesce(r.has_more, false) AS has_more,
               coalesce(t.suggestions, '') AS suggestions, coalesce(r.ids, '') AS ids,
               coalesce(r.titles, '') AS titles, coalesce(r.slugs, '') AS slugs,
               coalesce(r.prices, 0e0) AS prices
        FROM queries q JOIN asked a ON a.q_id = q.q_id
        LEFT JOIN (SELECT p.q_id, max(p.total) AS total, bool_or(p.has_more) AS has_more,
                       {listed.format('p')}
                   FROM page p JOIN docs d ON d.product_id = p.product_id GROUP BY p.q_id) r
            ON r.q_id = q.q_id
        LEFT JOIN (SELECT q_id, string_agg(suggestion, '|' ORDER BY rank) AS suggestions FROM (
                SELECT q_id, suggestion, row_number() OVER (PARTITION BY q_id
                    ORDER BY priority, length(suggestion), suggestion) AS rank FROM (
                    SELECT DISTINCT q.q_id, suggestion, priority FROM queries q
                    JOIN offers ON starts_with(key, q.normalized)
                    WHERE NOT q.blank AND q.q_id NOT IN (SELECT q_id FROM page)))
            WHERE rank <= 8 GROUP BY q_id) t ON t.q_id = q.q_id""", roots=("page", "offers", "asked"))
    sql["image_json"] = assemble(f"""
        SELECT CAST(l.label AS VARCHAR) AS q_id, true AS success, 200 AS code,
               coalesce(max(s.total), 0) AS total, 1 AS page, 5 AS per_page,
               CAST(ceil(coalesce(max(s.total), 0) / 5.0) AS BIGINT) AS last_page,
               {listed.format('s')}
        FROM label_vectors l LEFT JOIN (SELECT r.*, d.title FROM similar_ranked r
            JOIN docs d USING (product_id) WHERE rank <= 5) s ON s.q_id = CAST(l.label AS VARCHAR)
        LEFT JOIN docs d ON d.product_id = s.product_id GROUP BY l.label""", PARTS, "similar_ranked",
                                 "label_vectors")
    return sql


def _fallback_sql() -> str:
    cut = ([source := "asked_names"], f"""
        SELECT q_id, left(raw, length(raw) - 2) AS raw, category, shop, min_price, max_price, sort,
               page, size, label FROM {source} WHERE length(left(raw, length(raw) - 2)) >= 2""")
    parts = {**PARTS, "asked_cut": cut, "queries": _queries_part("asked_cut", False)}
    return assemble("""
        SELECT q_id, rank, suggestion, priority FROM (
            SELECT q_id, suggestion, priority, row_number() OVER (PARTITION BY q_id
                ORDER BY priority, length(suggestion), suggestion) AS rank FROM (
                SELECT DISTINCT q.q_id, suggestion, priority FROM queries q
                JOIN offers ON starts_with(key, q.normalized)
                WHERE NOT q.blank AND q.q_id NOT IN (SELECT q_id FROM exact)))
        WHERE rank <= 8""", parts, "offers", "exact", "queries")
