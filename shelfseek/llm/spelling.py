"""Spelling variants of words, found through asymmetric q-chunks.

Two words are near if one code point inserted, deleted or replaced turns one
into the other. Of two near words, the shorter one (of equal ones, the lesser)
is cut into two disjoint chunks. One edit spares one of them, and the other
word holds the spared chunk as a positional gram: at its own place if the edit
comes behind it, moved by the difference in length, at most one, otherwise.
Grams further off than that cannot meet a chunk, so only those within the shift
are written.

A half word alone is common to thousands of words. What it leaves of the word
holds the edit, and is cut into two chunks by the same rule: a key is a spared
half and the spared chunk of the rest. Keys are compared by hash; the join
confirms each meeting by edit distance, and only confirmed pairs leave it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from shelfseek.sources.tables import stored

#: Letters of words: ASCII letters and U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points a word has at least, and times it occurs at least.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form occurs at least so many times as often.
DOMINANCE = 10
#: One in so many runs of a document loses a code point in the damaged vocabulary.
DAMAGED = 31


def runs(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``run``: each run of letters of at least ``LEAST_LENGTH``, A-Z lower-cased; ``key`` as string, or ''."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    found = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    return docs.select(name.alias("key"), F.explode(found).alias("run")).select(
        "key", F.translate("run", UPPER, LOWER).alias("run"))


def damaged(rows: DataFrame) -> DataFrame:
    """``run``, with one code point less where ``DAMAGED`` divides the CRC-32 of ``key:run``."""
    crc = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    place = (F.col("crc") % F.length("run")).cast("int")
    return rows.withColumn("crc", crc).select(
        F.when(F.col("crc") % DAMAGED == 0, F.concat(
            F.substring(F.col("run"), F.lit(1), place),
            F.substring(F.col("run"), place + 2, F.length("run")))).otherwise(F.col("run")).alias("run"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """``word`` and ``n``, its number of occurrences, of the runs long and frequent enough."""
    return (rows.filter(F.length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word"))
            .agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT))


def _piece(start: Column, size: Column) -> Column:
    return F.substring(F.col("word"), start + 1, size)


def _keys(length: Column, shift: Column) -> Column:
    """Hashes of the four keys of words of ``length``, read from ``word``, which is longer by ``shift``.

    A chunk before the edit stands where it does in the shorter word, one
    behind it is ``shift`` further on. Cuts follow the shorter word.
    """
    half = F.floor(length / 2).cast("int")
    early, late = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")
    zero = F.lit(0)
    spared = [
        # the edit is in the second half: the first, and one chunk of the second
        (_piece(zero, half), _piece(half, late - half)),
        (_piece(zero, half), _piece(late + shift, length - late)),
        # the edit is in the first half: the second, and one chunk of the first
        (_piece(half + shift, length - half), _piece(zero, early)),
        (_piece(half + shift, length - half), _piece(early + shift, half - early)),
    ]
    return F.array(*[F.xxhash64(F.lit(i), length, a, b) for i, (a, b) in enumerate(spared)])


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: ``a``, ``a_n``, ``b``, ``b_n``; ``words`` are distinct."""
    size = F.length("word")
    chunks = words.select(F.explode(_keys(size, F.lit(0))).alias("key"), F.col("word").alias("a"),
                          F.col("n").alias("a_n"))
    grams = words.select(
        F.explode(F.concat(_keys(size, F.lit(0)), _keys(size - 1, F.lit(1)))).alias("key"),
        F.col("word").alias("b"), F.col("n").alias("b_n"))
    meet = ((chunks.key == grams.key)
            & ((F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))))
            & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1))
    return chunks.join(grams, meet).select("a", "a_n", "b", "b_n").distinct()


def forms(pairs: DataFrame) -> DataFrame:
    """Of each word with near words: ``n_near``, and its dominant ``form`` with ``form_n``, or null."""
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("n").alias("own"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    wins = -F.col("best.less") >= DOMINANCE * F.col("own")
    return best.select("word", "n_near", F.when(wins, F.col("best.near")).alias("form"),
                       F.when(wins, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame, longest: int) -> DataFrame:
    """``word`` and ``root``, the end of its chain of ``form``s; chains have at most ``longest`` links.

    Each round doubles the links a word has followed.
    """
    reached = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        reached = stored(reached, "roots")
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return reached


def grouped(words: DataFrame) -> DataFrame:
    """Every word with its ``form``, ``root``, counts and number of near words.

    ``words`` has distinct ``word``s and counts ``n``. A word without near words
    has ``n_near`` 0; one without form is its own root. Each link of a chain
    multiplies the count by ``DOMINANCE``, so chains are short and never closed.
    """
    words = stored(words, "words")
    found = stored(forms(near_pairs(words)), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    ends = roots(found.filter("form is not null"), math.floor(math.log(most, DOMINANCE)) + 1)
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """Spelling variants among the words of whole texts, as they stand.

    Null and empty texts have no words, rows without id count like others,
    repeated rows count as often as they occur; an empty table gives no rows.
    Other columns are not read.
    """
    return grouped(vocabulary(runs(docs, text)))


def report(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the vocabulary with planted damage (a null id is '')."""
    return grouped(vocabulary(damaged(runs(docs, "text", "doc_id"))))
