"""Candidate operators against direct computations on small frames."""

import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window, functions as F

from shelfseek import schema
from shelfseek.operators import exact, filters, joins, lexical, trigram, values, vector
from shelfseek.plans import hybrid

# Encoders below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOC = schema.columns("product_search_documents")
QUERY = ["q_id", "raw", "platform", "category", "shop", "min_price", "max_price", "sort", "page",
         "size", "q_embedding"]


def documents(spark, rows):
    """Documents from dicts; texts for the postings default to title and company."""
    full = []
    for i, row in enumerate(rows):
        base = dict.fromkeys(DOC)
        base.update(product_id=str(i), search_text="", **row)
        base["lexical_title"] = base["title"] or ""
        base["lexical_company"] = base["company"] or ""
        full.append(tuple(base[c] for c in DOC))
    return spark.createDataFrame(full, schema.DDL["product_search_documents"])


def batch(spark, texts, **values):
    rows = []
    for i, raw in enumerate(texts):
        row = dict.fromkeys(QUERY)
        row.update(q_id=f"q{i}", raw=raw, **values)
        rows.append(tuple(row[c] for c in QUERY))
    return filters.query_batch(filters.normalize_queries(
        spark.createDataFrame(rows, filters.QUERY_DDL)))


def cover_rank(hits, groups):
    """Cover density by trying every interval of hits. ``hits``: (pos, term, weight)."""
    def holds(part):
        have = {t for _, t, _ in part}
        return any(g <= have for g in groups)

    n = len(hits)
    good = [(i, j) for i in range(n) for j in range(i, n) if holds(hits[i:j + 1])]
    minimal = [(i, j) for i, j in good
               if not any((a, b) != (i, j) and i <= a and b <= j for a, b in good)]
    rank = 0.0
    for i, j in minimal:
        part = hits[i:j + 1]
        density = len(part) / sum(1 / w for _, _, w in part)
        rank += density / (1 + (part[-1][0] - part[0][0]) - (len(part) - 1))
    return rank / (rank + 1)


@pytest.mark.parametrize("raw,groups", [
    ("aa", [{"aa"}]), ("aa bb", [{"aa", "bb"}]), ("aa bb cc", [{"aa", "bb", "cc"}]),
    ("aa or bb", [{"aa"}, {"bb"}]), ("aa bb or cc dd", [{"aa", "bb"}, {"cc", "dd"}]),
])
def test_rank_equals_interval_search(spark, raw, groups):
    rng = random.Random(raw)
    words = ["aa", "bb", "cc", "dd", "xx", "yy"]
    rows = [{"title": " ".join(rng.choices(words, k=rng.randint(1, 14))),
             "company": rng.choice(words), "category_title": rng.choice(words)} for _ in range(60)]
    docs = documents(spark, rows)
    b = batch(spark, [raw])
    assert not b.any_negation
    got = {r["product_id"]: r["score"] for r in
           lexical.lexical_matches(b, lexical.postings(docs), docs).collect()}
    used = set().union(*groups)
    want = {}
    for i, row in enumerate(rows):
        text = [(w, 1.0) for w in row["title"].split()] + [(row["company"], 0.4),
                                                          (row["category_title"], 0.4)]
        hits = [(p, w, weight) for p, (w, weight) in enumerate(text, 1) if w in used]
        # Hits of a group that the document cannot meet still lie between others.
        have = {w for _, w, _ in hits}
        alive = [g for g in groups if g <= have]
        if alive:
            want[str(i)] = cover_rank(hits, alive)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-8)


def interval_rank(hits, groups):
    """Cover density by every interval; ``groups`` are lists of runs of terms, each to stand side by side."""
    def has(part, run):
        at = {(p, t) for p, t, _ in part}
        return any(all((p + j, t) in at for j, t in enumerate(run)) for p, _, _ in part)

    n = len(hits)
    good = [(i, j) for i in range(n) for j in range(i, n)
            if any(all(has(hits[i:j + 1], run) for run in g) for g in groups)]
    minimal = [(i, j) for i, j in good if not any((a, b) != (i, j) and i <= a and b <= j for a, b in good)]
    rank = sum(len(hits[i:j + 1]) / sum(1 / w for _, _, w in hits[i:j + 1]) / (1 + (hits[j][0] - hits[i][0]) - (j - i))
               for i, j in minimal)
    return rank / (rank + 1) if minimal else None


@pytest.mark.parametrize("raw,groups", [
    ("aa'bb", [["aa bb"]]), ("aa'bb cc", [["aa bb", "cc"]]), ("aa'aa", [["aa aa"]]), ("aa'bb'aa", [["aa bb aa"]]),
    ("aa'bb or cc'dd", [["aa bb"], ["cc dd"]]), ("aa'bb bb'cc or dd", [["aa bb", "bb cc"], ["dd"]]),
    ("aa'bb aa", [["aa bb", "aa"]])])
def test_words_side_by_side_rank_by_intervals(spark, raw, groups):
    rng = random.Random(raw)
    words = ["aa", "bb", "cc", "dd", "xx"]
    rows = [{"title": " ".join(rng.choices(words, k=rng.randint(1, 14))), "company": rng.choice(words)} for _ in range(60)]
    docs = documents(spark, rows)
    got = {r["product_id"]: r["score"] for r in
           lexical.lexical_matches(batch(spark, [raw]), lexical.postings(docs), docs).collect()}
    used = {t for g in groups for run in g for t in run.split()}
    want = {}
    for i, row in enumerate(rows):
        text = [(w, 1.0) for w in row["title"].split()] + [(row["company"], 0.4)]
        hits = [(p, w, weight) for p, (w, weight) in enumerate(text, 1) if w in used]
        have = {w for _, w, _ in hits}
        alive = [[run.split() for run in g] for g in groups if all(t in have for run in g for t in run.split())]
        score = interval_rank(hits, alive)
        if score is not None:
            want[str(i)] = score
    assert got.keys() == want.keys() and want
    assert all(got[key] == pytest.approx(want[key], abs=1e-8) for key in want)


def test_excluded_words_side_by_side(spark, monkeypatch):
    docs = documents(spark, [{"title": t} for t in ("aa bb", "bb aa", "aa xx bb", "x-y z", "x y z", "cc")])
    index = lexical.postings(docs)

    def ids(raw):
        return {r["product_id"] for r in lexical.lexical_matches(batch(spark, [raw]), index, docs).collect()}

    for _ in range(2):
        assert ids("aa -aa'bb") == {"1", "2"} and ids("-aa'bb") == {"1", "2", "3", "4", "5"}
        assert ids("x-y'z") == {"3"} and ids("x'y") == {"3", "4"} and ids("aa'bb or cc -bb'aa") == {"0", "5"}
        monkeypatch.setattr(joins, "MAX_LOCAL_ROWS", 0)
        monkeypatch.setattr(joins.local_table, "__defaults__", (0, joins.MAX_ROW_CHARS))


def test_exclusions(spark):
    docs = documents(spark, [{"title": t} for t in
                             ("red plate", "red ring", "old ring", "red", "plate")])
    index = lexical.postings(docs)

    def ids(raw):
        rows = lexical.lexical_matches(batch(spark, [raw]), index, docs).collect()
        return {r["product_id"]: r["score"] for r in rows}

    assert set(ids("red -plate")) == {"1", "3"}
    assert ids("-plate") == {"1": 0.0, "2": 0.0, "3": 0.0}
    assert set(ids("-plate or ring")) == {"1", "2", "3"}
    assert ids("ring or -red")["2"] > 0 and ids("ring or -red")["4"] == 0.0


def random_catalogue(spark, n=80, seed=3):
    rng = random.Random(seed)
    first, second = ["red", "hot", "cold", "small"], ["widget", "plate", "ring", "gizmo", None]
    rows = []
    for _ in range(n):
        noun = rng.choice(second)
        rows.append({
            "title": None if noun is None else f"{rng.choice(first)} {noun}",
            "company": rng.choice([None, "Acme", "Bolt Co"]),
            # One category holds most of the rows.
            "category_id": "7", "category_title": rng.choice(["Kitchen"] * 8 + ["Garden"]),
            "category_slug": "kitchen", "subcategory_title": rng.choice(["Plates", "Tools"]),
            "subcategory_slug": "s", "leaf_category_title": "Leaf", "leaf_category_slug": "leaf",
            "sortable_price": None if rng.random() < 0.2 else
            __import__("decimal").Decimal(rng.randint(1, 100)),
            "updated_at": None if rng.random() < 0.2 else
            __import__("datetime").datetime(2024, 1, rng.randint(1, 28))})
    return documents(spark, rows)


def vectors(spark, n=80, width=8, seed=5):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, width)).astype(np.float32)
    # A third of the rows are copies of one vector; one has no direction.
    data[: n // 3] = data[0]
    data[n - 1] = 0
    return spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(data)],
                                 "product_id string, embedding array<float>"), data


TEXTS = ["red widget", "hot or cold", "wiget", "kitchen", "acme", "red -plate", "-red", "7", "zz",
         "small ring", "plates"]


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def test_trigrams_equal_all_pairs(spark):
    docs = random_catalogue(spark)
    b = batch(spark, TEXTS)
    got = as_rows(trigram.trigram_candidates(b, trigram.trigram_index(docs), values.field_values(docs)))
    from shelfseek.functions.text import trigram_similarity
    pairs = filters.document_terms(docs).crossJoin(b.frame.select("q_id", "normalized", "threshold"))
    score = F.greatest(*[trigram_similarity(F.col(f"{n}_lower"), F.col("normalized")) * w
                         for n, w in trigram.WEIGHTS.items()])
    want = as_rows(pairs.withColumn("score", F.round(score, 9)).filter("score >= threshold")
                   .select("q_id", "product_id", "score"))
    assert got == want and len({r[0] for r in got}) > 4


def large(monkeypatch):
    """Make every batch count as too large to broadcast."""
    for module in (filters, lexical, trigram, vector):
        monkeypatch.setattr(module, "local_table", lambda *a, **k: None)
    monkeypatch.setattr(joins, "are_small", lambda *frames, **k: [False] * len(frames))


@pytest.mark.parametrize("filter_values", [
    {}, {"category": "Kitchen ", "min_price": 10.0}, {"shop": "acme", "max_price": 50.0}])
def test_large_batches_give_the_same(spark, monkeypatch, filter_values):
    docs = random_catalogue(spark)
    embeddings, _ = vectors(spark)
    index = hybrid.SearchIndex.over(docs, embeddings)
    rng = np.random.default_rng(1)
    vector_of = [float(x) for x in rng.normal(size=8)]

    def run():
        b = batch(spark, TEXTS, q_embedding=vector_of, size=5, **filter_values)
        return as_rows(hybrid.page_of(hybrid.score(b, hybrid.candidates(b, index), docs)))

    small = run()
    large(monkeypatch)
    monkeypatch.setattr(vector, "CELL_VECTORS", 30)
    monkeypatch.setattr(vector, "MAX_QUERY_BLOCK", 4)
    assert run() == small and small


def test_filters_differ_between_queries(spark):
    docs = random_catalogue(spark)
    embeddings, data = vectors(spark)
    q = [float(x) for x in np.random.default_rng(2).normal(size=8)]
    rows = []
    for i, (category, shop, low) in enumerate([(None, None, None), ("garden", None, None),
                                               (None, "acme", None), ("kitchen", None, 50.0)]):
        row = dict.fromkeys(QUERY)
        row.update(q_id=f"q{i}", raw="xx", category=category, shop=shop, min_price=low,
                   q_embedding=q, size=1)
        rows.append(tuple(row[c] for c in QUERY))
    normalized = filters.normalize_queries(spark.createDataFrame(rows, filters.QUERY_DDL))
    b = filters.query_batch(normalized)
    allowed = {tuple(r) for r in filters.filter_documents(normalized, docs).collect()}
    got = vector.semantic_candidates(b, docs, embeddings).collect()
    assert {(r["q_id"], r["product_id"]) for r in got} <= allowed
    when = {r["product_id"]: r["updated_at"] for r in docs.collect()}
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-9)
    sims = np.round(unit.astype(float) @ (np.array(q) / np.linalg.norm(q)), 6)
    for i in range(4):
        able = [p for p in map(str, range(79)) if (f"q{i}", p) in allowed]
        able.sort(key=lambda p: (-sims[int(p)], when[p] is None,
                                 -(when[p].timestamp() if when[p] else 0), p))
        assert {r["product_id"] for r in got if r["q_id"] == f"q{i}"} == set(able[:40])


def test_scan_merges_blocks_with_copies(spark, monkeypatch):
    docs = random_catalogue(spark)
    embeddings, data = vectors(spark)
    monkeypatch.setattr(vector, "MAX_BLOCK_CELLS", 7)
    monkeypatch.setattr(vector, "MAX_HELD_ROWS", 10)
    queries = spark.createDataFrame(
        [("a", [float(x) for x in data[0]], 5, 0.1), ("b", [float(x) for x in data[50]], 90, None),
         ("none", None, 3, None), ("zero", [0.0] * 8, 3, None)],
        "q_id string, q_embedding array<float>, depth int, threshold double")
    rows = embeddings.join(docs.select("product_id", "updated_at"), "product_id")
    ranked = vector.ranked_hits(vector.scan(rows.repartition(5), queries), 90).collect()
    best = sorted((r for r in ranked if r["q_id"] == "a"), key=lambda r: r["rank"])
    when = {r["product_id"]: r["updated_at"] for r in docs.collect()}
    copies = sorted(map(str, range(26)), key=lambda p: (
        when[p] is None, -(when[p].timestamp() if when[p] else 0), p))
    assert [r["product_id"] for r in best][:5] == copies[:5]
    unit = data[:79] / np.linalg.norm(data[:79], axis=1, keepdims=True)
    assert best[0]["total"] == int((np.round(unit @ unit[0], 9) >= 0.1).sum())
    assert len([r for r in ranked if r["q_id"] == "b"]) == 79
    assert {r["q_id"] for r in ranked} == {"a", "b"}


def test_scan_refuses_other_widths(spark):
    embeddings, _ = vectors(spark)
    queries = spark.createDataFrame([("a", [1.0], 5, None)],
                                    "q_id string, q_embedding array<float>, depth int, threshold double")
    with pytest.raises(Exception, match="width"):
        vector.scan(embeddings, queries).collect()


def test_top_k_in_two_steps(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"), "id")
    order = [F.col("v").desc()]
    one = as_rows(joins.top_k(df, ["g"], order, 40, ["id"]))
    whole = Window.partitionBy("g").orderBy(*order)
    assert one == as_rows(df.withColumn("rank", F.row_number().over(whole)).filter("rank <= 40"))
    deep = joins.top_k(df, ["g"], order, 1500, ["id"])
    assert deep.count() == 4500


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, how):
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(
        F.col("id") % 9).alias("k"))
    other = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (50, "w")], "k long, v string")
    assert as_rows(joins.salted_join(big, other, ["k"], how, ["id"])) == as_rows(
        big.join(other, ["k"], how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("heavy", [10, 100, 10_000])
def test_split_join_equals_plain(spark, monkeypatch, how, heavy):
    monkeypatch.setattr(joins, "HEAVY_ROWS", heavy)
    big = spark.range(900).selectExpr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null "
                                      "else cast(id % 40 as string) end as k", "id as n")
    other = spark.createDataFrame([("hot", 1), ("5", 2), ("zz", 3), (None, 4)], "k string, v int")
    want = big.join(other, "k", how)
    assert as_rows(joins.split_join(big, other, ["k"], how, ["n"]).select(*want.columns).na.fill("-").na.fill(-1)) == as_rows(
        want.na.fill("-").na.fill(-1))


def test_local_table_refuses_many_or_wide_rows(spark):
    df = spark.range(50).select("id", F.lit("x" * 100).alias("t"))
    assert joins.local_table(df, 50).num_rows == 50
    assert joins.local_table(df, 49) is None
    assert joins.local_table(df, 50, max_chars=80) is None


def test_exact_ladder_first_hit_wins(spark):
    docs = documents(spark, [
        {"title": "acme", "company": "Acme"}, {"title": "acme tools", "company": "acme"},
        {"title": "x", "company": "ACME", "leaf_category_title": "acme"},
        {"title": None, "company": None, "subcategory_slug": "acme"}, {"title": "tool"}])
    got = {r["product_id"]: r["score"] for r in
           exact.exact_candidates(batch(spark, ["Acme"]), values.field_values(docs)).collect()}
    assert got == {"0": 0.92, "1": 0.75, "2": 0.6, "3": 0.5}


def test_pages_make_up_the_whole(spark):
    docs = random_catalogue(spark)
    embeddings, _ = vectors(spark)
    index = hybrid.SearchIndex.over(docs, embeddings)
    b = batch(spark, ["red widget"])
    merged = hybrid.score(b, hybrid.candidates(b, index), docs)
    everything = merged.withColumn("size", F.lit(1000))
    whole = [r["product_id"] for r in hybrid.page_of(everything).orderBy("rank").collect()]
    pages = []
    for page in range(0, len(whole) // 7 + 2):
        rows = hybrid.page_of(merged.withColumn("size", F.lit(7)).withColumn("page", F.lit(page)))
        got = rows.orderBy("rank").collect()
        assert all(r["total"] == len(whole) for r in got)
        assert all(r["has_more"] == (len(whole) > 7 * (page + 1)) for r in got)
        pages += [r["product_id"] for r in got]
    assert pages == whole


def test_folded_accents_match_titles(spark):
    docs = documents(spark, [{"title": "Café Crème"}])

    def found(fold):
        q = dict.fromkeys(QUERY)
        q.update(q_id="q", raw="café crème")
        queries = spark.createDataFrame([tuple(q[c] for c in QUERY)], filters.QUERY_DDL)
        embeddings, _ = vectors(spark)
        rows = hybrid.hybrid_search(queries, hybrid.SearchIndex.over(docs, embeddings, fold), fold)
        return rows.first()["exact_score"]

    assert found(False) == 0.0 and found(True) == 0.92


def test_stored_index_needs_no_shuffle_to_meet_documents(spark, index):
    joined = index.embeddings.join(index.documents.select("product_id", "updated_at"), "product_id")
    hits = index.postings.groupBy("product_id", "term").count()
    for plan in (joined, hits):
        text = plan._jdf.queryExecution().sparkPlan().toString()
        executed = plan._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in executed, text


class PickyEncoder:
    """Encodes what it likes; ``bad`` texts fail together with their whole block."""

    def __call__(self, items):
        if "bad words" in items:
            raise ValueError("bad words")
        return [[1.0] + [0.0] * 7 if "red" in i else [0.0, 1.0] + [0.0] * 6 for i in items]


def test_queries_are_encoded_and_failures_are_null(spark):
    docs, (embeddings, data) = random_catalogue(spark), vectors(spark)
    rows = [("q0", "Red  plate!"), ("q1", "red plate"), ("q2", "bad words"), ("q3", "hot ring"), ("q4", "  "), ("q5", None)]
    queries = spark.createDataFrame([tuple((dict.fromkeys(QUERY) | {"q_id": q, "raw": raw})[c] for c in QUERY)
                                     for q, raw in rows], filters.QUERY_DDL)
    made = {r["q_id"]: r["q_embedding"] for r in hybrid.with_embeddings(queries, PickyEncoder).collect()}
    red, hot = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    assert made == {"q0": red, "q1": red, "q2": None, "q3": hot, "q4": None, "q5": None}
    found = hybrid.encoded_search(queries, hybrid.SearchIndex.over(docs, embeddings), PickyEncoder).collect()
    semantic = {q: any(r["semantic_score"] > 0 for r in found if r["q_id"] == q) for q in ("q0", "q2", "q3")}
    assert semantic == {"q0": True, "q2": False, "q3": True}


def test_exact_candidates_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["a", "ab", "abc", "abcd", "abcd e", "abcd efgh", "abcd efgh i", "tool", "5", ""]
    docs = documents(spark, [dict(zip(("title", "company", "category_title", "leaf_category_slug"),
                                      [words[k] for k in rng.integers(0, len(words), 4)])) for _ in range(60)])
    b = batch(spark, [w for w in words if w] + ["abcd ef", "abcd efgh i j"])
    terms = {r["product_id"]: r for r in filters.document_terms(docs).collect()}
    want = []
    for q in b.frame.collect():
        for p, t in terms.items():
            scores = [s for f, s in exact.FIELD_SCORES.items() if (
                t["title_lower"].startswith(q["normalized"]) if f == values.TITLE_PREFIX
                else t[f"{f}_lower"] == q["normalized"])]
            want += [(q["q_id"], p, max(scores))] if scores else []
    assert as_rows(exact.exact_candidates(b, values.field_values(docs))) == sorted(want) and want
    monkeypatch.setattr(exact, "MAX_PUSHED_KEYS", 0)
    assert as_rows(exact.exact_candidates(b, values.field_values(docs))) == sorted(want)


def test_exact_candidates_read_named_keys_and_no_documents(spark, index):
    plan = exact.exact_candidates(batch(spark, ["red plate"]), index.values)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]
    assert scans and all("EqualTo(value_key," in line and "lexical_title" not in line for line in scans)


def test_frequent_grams_are_not_paired(spark):
    docs = documents(spark, [{"title": f"common words {w}"} for w in ("zebra", "quilt", "ivory")]
                     + [{"title": f"common words {i}"} for i in range(200)])
    b, grams = batch(spark, ["common words zebra"]), trigram.trigram_index(docs)
    asked = trigram._asked_grams(b, grams)
    pairs = trigram.similar_pairs(b, grams, asked)
    met = grams.join(asked.filter(F.col("place") <= trigram._looked_up(F.lit(1.0))), "gram")
    assert met.count() < grams.join(asked, "gram").count() * 0.8
    similar = trigram.matching_values(b, grams).select("q_id", "field", "value_key")
    assert similar.exceptAll(pairs).isEmpty() and not similar.isEmpty()


FILTER_ROWS = [(None, None, None, None), (None, None, 20.0, 60.0), (None, None, 20.0, 60.0), (None, None, None, 30.0),
               (None, None, 90.0, None), (None, None, 60.0, 20.0), ("garden", None, 10.0, None), (None, "acme", None, 50.0),
               ("kitchen", "acme", None, None), ("nothing", None, None, None), (None, None, float("nan"), None)]


@pytest.mark.parametrize("small, bins", [(True, 256), (True, 3), (False, 1)])
def test_filters_equal_all_pairs(spark, monkeypatch, small, bins):
    docs = random_catalogue(spark)
    monkeypatch.setattr(filters.price_bounds, "__defaults__", (bins,))
    if not small:
        large(monkeypatch)
    rows = [(f"q{i}", "xx", *f) for i, f in enumerate(FILTER_ROWS)]
    names = ["q_id", "raw", "category", "shop", "min_price", "max_price"]
    queries = filters.normalize_queries(spark.createDataFrame([tuple((dict.fromkeys(QUERY) | dict(zip(names, r)))[c]
                                                                     for c in QUERY) for r in rows], filters.QUERY_DDL))
    pairs = filters.document_terms(docs).crossJoin(queries).filter(filters.passes_filters())
    want = pairs.select("q_id", "product_id", "updated_at").collect()
    assert as_rows(filters.filter_documents(queries, docs)) == sorted((r["q_id"], r["product_id"]) for r in want)
    got = {r["q_id"]: (r["total"], r["first"]) for r in filters.filter_pages(queries, docs, 4).collect()}
    for q, *_ in rows:
        mine = sorted((r for r in want if r["q_id"] == q), key=lambda r: (
            r["updated_at"] is None, -(r["updated_at"].timestamp() if r["updated_at"] else 0), r["product_id"]))
        assert got[q] == (len(mine), ",".join(r["product_id"] for r in mine[:4]))
    assert len(want) > 80 and any(n == 0 for n, _ in got.values())


def test_filter_pages_list_no_pairs(spark, monkeypatch):
    """Bounds between two cents and beyond all prices, documents of one price, and no meeting of pairs."""
    from decimal import Decimal
    docs = documents(spark, [{"sortable_price": p and Decimal(p), "company": c, "updated_at": None} for p, c in (
        [("0.29", "Acme")] * 50 + [("0.30", "Acme"), ("-3.10", ""), ("77.77", "Acme"), (None, "Acme"), ("9999999999.99", None)])])
    bounds = [(0.29, 0.29), (0.291, 0.3), (0.2899999, None), (None, -3.1), (float("-inf"), float("inf")), (None, float("nan")),
              (None, None), (1e300, None), (-0.5, 77.77), (0.3, 0.29)]
    rows = [(f"q{i}{s}", low, high, s) for i, (low, high) in enumerate(bounds) for s in ("acme", None)]
    queries = filters.normalize_queries(spark.createDataFrame([tuple((dict.fromkeys(QUERY) | {
        "q_id": q, "raw": "xx", "min_price": low, "max_price": high, "shop": s})[c] for c in QUERY)
        for q, low, high, s in rows], filters.QUERY_DDL))
    want = {r[0]: r[1] for r in filters.document_terms(docs).crossJoin(queries).filter(filters.passes_filters())
            .groupBy("q_id").count().collect()}
    met = []
    monkeypatch.setattr(filters, "documents_of_filters", lambda *a: met.append(a))
    got = {r["q_id"]: r["total"] for r in filters.filter_pages(queries, docs, 3).collect()}
    assert not met and got == {q: want.get(q, 0) for q, *_ in rows}
