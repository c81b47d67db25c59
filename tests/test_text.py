from pyspark.sql import functions as F

from shelfseek import fixtures as fx
from shelfseek.functions import text
from shelfseek.operators.filters import QUERY_DDL, normalize_queries


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(
        expression(F.col("v")).alias("r")).first()["r"]


def query(spark, raw, **values):
    row = dict.fromkeys(["q_id", "raw", "platform", "category", "shop", "min_price", "max_price",
                         "sort", "page", "size", "q_embedding"])
    row.update(q_id="q", raw=raw, **values)
    return spark.createDataFrame([row], QUERY_DDL)


def test_golden_query(spark):
    q = normalize_queries(query(spark, "  Café Phone Case!!  ", page=1, size=200)).first()
    assert q["normalized"] == "cafe phone case"
    assert q["ts_query"] == "cafe:* & phone:* & case:*"
    assert q["phrase_query"] == "cafe <-> phone <-> case"
    assert q["tokens"] == ["cafe", "phone", "case"]
    assert (q["page"], q["size"]) == (1, 60)


def test_query_defaults(spark):
    q = normalize_queries(query(spark, "a 'b", page=-2, size=0, sort=" ", category=" \t", shop=" X ")
                          ).first()
    assert (q["page"], q["size"], q["sort"]) == (0, 20, "relevance")
    assert (q["f_category"], q["f_shop"]) == (None, "x")
    assert q["tokens"] == ["b"] and not q["blank"]
    assert (q["depth"], q["vector_depth"]) == (80, 40)
    deep = normalize_queries(query(spark, "ab", page=9, size=50)).first()
    assert (deep["depth"], deep["vector_depth"]) == (2000, 1000)


def test_normalize_edges(spark):
    assert one(spark, None, text.normalize_query) == ""
    assert one(spark, "Ünï-x d'or\t_%2", text.normalize_query) == "uni-x d'or 2"
    # A mark typed apart from its letter is junk by the time marks are dropped.
    assert one(spark, "café x", text.normalize_query) == "cafe x"
    assert one(spark, "søm ß 한글", text.normalize_query) == "søm ß 한글"


def test_fold(spark):
    assert one(spark, "Ærø Straße Łódź é", text.fold) == "AEro Strasse Lodz e"


def test_lexemes(spark):
    assert one(spark, "T-Shirt, men's 3.5 x-y-z", text.lexemes) == [
        "t-shirt", "t", "shirt", "men", "s", "3", "5", "x-y-z", "x", "y", "z"]


def groups(spark, normalized):
    df = text.with_query_groups(spark.createDataFrame([(normalized,)], "normalized string"))
    return [(g["required"], g["excluded"]) for g in df.first()["groups"]]


def test_query_groups(spark):
    assert groups(spark, "red widget") == [(["red", "widget"], [])]
    assert groups(spark, "small or hot -old") == [(["small"], []), (["hot"], ["old"])]
    assert groups(spark, "or small or") == [(["or", "small", "or"][0:2], [])]
    assert groups(spark, "a or or b") == [(["a"], []), (["or", "b"], [])]
    assert groups(spark, "red - plate") == [(["red"], ["plate"])]
    assert groups(spark, "--red x-y red") == [(["red", "x-y"], [])]
    assert groups(spark, "- '") == []


def test_trigram_similarity(spark):
    def sim(a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(
            text.trigram_similarity(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert abs(sim("word", "two words") - 4 / 11) < 1e-12
    assert sim("", "  ") == 0 and sim("Abc", "aBC") == 1
    assert one(spark, "cat", text.trigrams) == ["  c", " ca", "cat", "at "]


def test_thresholds_and_titles(spark):
    for value, want in (("abc", 0.55), ("abcd", 0.4), ("abcdef", 0.4), ("abcdefg", 0.3)):
        assert one(spark, value, text.trigram_threshold) == want
    assert one(spark, "home-and garden", text.title_from_slug) == "Home And Garden"


def test_fixture_queries_cover_blank_ones(spark, sf):
    blank = {r["q_id"] for r in normalize_queries(fx.queries(spark, sf, False)).filter("blank").collect()}
    assert blank == {"q10", "q11", "q12"}


def test_fold_works_a_text_over_once(spark):
    assert str(text.fold(F.col("t"))).count("translate(") == 1
    rows = [("plain ASCII-text",), ("Ǽther Straße ŁÓDŹ e\u0301 ÞØ",), ("",), (None,), ("a\u0301\u0301 b",)]
    got = spark.createDataFrame(rows, "t string").select(text.fold(F.col("t"))).collect()
    assert [r[0] for r in got] == ["plain ASCII-text", "AEther Strasse LODZ e THO", "", None, "a b"]
