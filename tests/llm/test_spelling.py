"""Spelling variants against deletion neighbourhoods, and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

from shelfseek.llm import spelling

FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, damage):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and crc % 31 == 0:
                run = run[:crc % len(run)] + run[crc % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def expected(n):
    holders, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            part = w[:k] + w[k + 1:]
            holders[k, part].add(w)
            if part in n:
                near[w].add(part)
                near[part].add(w)
    for words in holders.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(((-n[x], x) for x in near[w]), default=(0, None))
        form[w] = best[1] if -best[0] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def edited(rng, word):
    k, c = rng.randrange(len(word) + 1), rng.choice("abcé")
    return rng.choice([word[:k] + c + word[k:], word[:k] + c + word[k + 1:], word[:k] + word[k + 1:]])


def test_near_words_forms_and_roots(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 12))) for _ in range(120)]
    words += ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(7, 16))) for _ in range(200)]
    chain = ["mnopqrstuvwx", "mnopqrstuvwy", "mnopqrstuzwy", "mnozqrstuzwy"]
    texts = [" ".join(edited(rng, w) if rng.random() < .2 else w for w in rng.choices(words, k=60)) for _ in range(80)]
    texts += [" ".join([w] * (2 * 11 ** k)) for k, w in enumerate(chain)] + ["Straßen-Übergang, ÜBERGANG übergang " * 3]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for report, damage in ((spelling.report, True), (spelling.variants, False)):
        right = expected(counted(rows, damage))
        assert got(report(docs)) == right
        assert sum(r[1] is not None for r in right) >= 3 and any(r[1] != r[2] for r in right if r[1])


def test_every_single_edit_is_found(spark):
    """All words at one edit from words of each length, the edit anywhere."""
    rows = []
    for length in range(7, 16):
        word = "abcdefghijklmno"[:length]
        rows.append(word)
        for k in range(length + 1):
            rows += [word[:k] + "z" + word[k:], word[:k] + "z" + word[k + 1:], word[:k] + word[k + 1:]]
            rows.append(word[:k] + word[k:k + 1] * 2 + word[k + 1:])
    n = {w: 2 for w in rows if len(w) >= 7}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.grouped(words)) == expected(n)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    more = [(None, "x" * 50_000), (7, "x" * 50_000 + " " + "x" * 49_999), (None, "x" * 49_999)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs = docs.selectExpr("*", "'extra' AS word", "1 AS n", "2 AS key", "3 AS run")
    assert got(spelling.report(docs)) == expected(counted(rows + more, True))
    assert spelling.report(no_docs).collect() == []
