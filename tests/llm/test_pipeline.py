"""The pipeline's stages against plain versions, and on odd rows and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from shelfseek.llm import cotraining, decontaminate, mixing, near_dedup, pii, quality_rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["_size", "_n", "_key", "_copies", "_nth", "_place", "_hash", "_text_hash", "_id", "_single", "_hits", "_items",
           "_n_words", "_text", "_row", "_found", "_later", "_label", "row", "key", "size", "copies", "nth", "copy", "place",
           "text_hash", "kept", "score", "n_words", "spans", "node", "root", "n"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, words):
    """A folder with documents, labels and benchmark, whose outcomes are known."""
    rng = random.Random(11)
    common = words[:120]
    line = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs, folder = [], tmp_path_factory.mktemp("tables")
    for i in range(120):
        docs.append((i, line(rng.randint(60, 200)), "abc"[i % 3]))
    item = line(30)
    docs += [(200 + i, docs[i][1], "a") for i in range(10)]                        # copies
    docs += [(220 + i, docs[20 + i][1] + " tail", "b") for i in range(10)]         # near copies
    docs += [(240 + i, f"{line(40)} {item} {line(40)}", "c") for i in range(5)]    # benchmark passages
    docs += [(260 + i, line(10), "a") for i in range(5)]                           # too short
    docs += [(280, line(60) + " password = hunter2hunter2 " + line(20), "b"), (281, None, None), (282, "", "a"),
             (None, line(80), None), (None, line(80), None)]
    frame = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, item


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_whole_pipeline(spark, tables):
    folder, docs, item = tables
    left = []
    for i, text, source in docs:                                # quality: without labels the counts alone decide
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w):
            left.append((i, text, source))
    sets = [shingles(t) for _, t, _ in left]
    root = list(range(len(left)))

    def find(k):
        return k if root[k] == k else find(root[k])
    for a in range(len(left)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(left)):
        groups[find(k)].append(left[k])
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    left = [r for r in left if item not in r[1]]
    masked = [(i, t.replace("password = hunter2hunter2", "[SECRET]"), s) for i, t, s in left]
    made = corpus_pipeline.run(spark, folder).collect()
    by_source = Counter()
    for r in made:
        assert (r.doc_id, r.text, r.source) in masked
        by_source[r.source] += len(WORD.findall(r.text))
    sizes = Counter()
    for _, t, s in masked:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    free, rest, target = set(order), 1.5 * sum(sizes.values()), {}
    while free:
        total = sum(share[s] for s in free)
        above = {s for s in free if rest * share[s] / total > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if above else rest * share[s] / total for s in (above or free)}
        rest -= sum(2 * sizes[s] for s in above)
        free = free - above if above else set()
    longest = max(len(WORD.findall(t)) for _, t, _ in masked)
    for s in order:
        assert abs(by_source[s] - target[s]) <= longest
    assert Counter((r.doc_id, r.text, r.mix_copy) for r in made).most_common(1)[0][1] == 1


def test_stages_keep_columns_of_any_name(spark, docs_of, words):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words[:200]) for _ in range(80)) for _ in range(20)]
    docs = docs_of(texts + texts[:3])
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'x{name}' AS `{name}`") if name not in docs.columns else docs
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("q", "no such passage in any of these documents at all ever")], "item_id string, text string")
    stages = [lambda d: quality_rules.keep_good(d, labels), lambda d: near_dedup.unique_documents(d, 5),
              lambda d: decontaminate.decontaminate(d, bench), secrets.redact, mixing.mix, pii.with_surrogates]
    for stage in stages:
        rows = stage(docs).collect()
        assert rows
        for r in rows:
            assert all(r[name] == f"x{name}" for name in CLASHES if name not in ("kept",)), stage
            assert r.kept == "extra"
    for columns in ([c for c in docs.columns if c != "kept"],):
        assert len(decontaminate.decontaminate(docs.select(*columns), bench).columns) == len(columns)


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() >= 0


def test_samples_hold_one_row_of_an_id(spark, docs_of):
    docs = docs_of(["one text", "two texts"]).crossJoin(spark.range(50)).drop("id")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_rules.labelled_sample(docs, labels, "quality").count() == 2
    assert quality_rules.labelled_sample(docs, labels, "toxic", columns=tuple(cotraining.COLUMNS)).count() == 2
