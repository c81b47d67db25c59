"""The BPE transducer against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfseek.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "é", "ß", "日", "🙂", "1", "23", "!", "...", "====",
         "<|endoftext|>", "<|end", "|>", "the", " of", "Ω", "　", "́", "tion", "\r\n", "\x00", "\xa0", "՘"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def in_parts(encoder, text, rng, most):
    out, at = [], 0
    while at < len(text):
        size = rng.randint(1, most)
        out += encoder.feed(text[at:at + size])
        at += size
    return out + list(encoder.feed("", True))


def test_mixed_texts_whole_and_in_parts(vocabulary, library):
    rng, encoder = random.Random(1), bpe.Encoder(vocabulary)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) * rng.choice([1, 1, 1, 2, 7]) for _ in range(rng.randint(0, 30)))
        right = library.encode(text, add_special_tokens=False).ids
        assert list(encoder.encode(text)) == right
        assert in_parts(encoder, text, rng, 5) == right


@pytest.mark.parametrize("letters", ["a", "ab", " ", "-", " \n", "é日", "0", "etaoinshr", "!?.", "\n"])
def test_open_runs(vocabulary, library, monkeypatch, letters):
    """Runs longer than what is held come out in stable parts."""
    monkeypatch.setattr(bpe, "OPEN_CHARS", 8)
    rng, encoder = random.Random(2), bpe.Encoder(vocabulary)
    for _ in range(8):
        run = "".join(rng.choice(letters) for _ in range(rng.randint(500, 16_000)))
        text = rng.choice(["", " ", "a", "  1"]) + run + rng.choice(["", "x", " x", "\nx", "'s", "<|endoftext|>y"])
        assert in_parts(encoder, text, rng, 3000) == library.encode(text, add_special_tokens=False).ids


def test_memory_of_a_run_is_bounded(vocabulary):
    run = bpe.Run(vocabulary)
    for _ in range(50):
        for _ in run.push(b"etaoin" * 1000):
            pass
        assert len(run.held) <= 2 * run.block


def test_lookahead_is_the_longest_chain():
    """Whether d follows abc decides c, then b by the later merge b + cd, then a by the still later a + b."""
    letters = bpe.byte_letters()
    merges = [["c", "d"], ["e", "f"], ["b", "cd"], ["d", "ef"], ["a", "b"]]
    vocab = {c: i for i, c in enumerate(letters)} | {"".join(m): 256 + i for i, m in enumerate(merges)}
    file = {"added_tokens": [], "normalizer": None, "model": {"type": "BPE", "vocab": vocab, "merges": merges},
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    assert bpe.Vocabulary(json.dumps(file)).lookahead == 3


def test_decoding_any_ids(vocabulary, library):
    rng, decoder = random.Random(4), bpe.Decoder(vocabulary)
    for _ in range(1000):
        ids = [rng.randrange(50257) if rng.random() < .5 else rng.randrange(256) for _ in range(rng.randint(0, 20))]
        assert decoder.feed(ids[:5]) + decoder.feed(ids[5:], True) == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode(np.array([-1, 10 ** 6, 64])) == "a"


def test_report_and_odd_rows(odd_docs, no_docs, docs_of, library):
    more = docs_of(["x<|endoftext|>y", "a" * 200_000, " " * 100_000, "=-" * 50_000 + "é"])
    docs = odd_docs.unionByName(more)
    made = [tuple(r) for r in bpe.report(docs, PATH).collect()]
    right = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        right.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(made, key=repr) == sorted(right, key=repr)
    assert bpe.report(no_docs, PATH).collect() == []


def test_columns_stay_and_the_result_replaces(docs_of):
    docs = docs_of(["one two", None]).withColumn("ids", F.lit("old")).withColumn("decoded", F.lit("old"))
    rows = bpe.decoded(bpe.encoded(docs, PATH), PATH).orderBy("doc_id").collect()
    assert set(rows[0].asDict()) == set(docs.columns)
    assert [(r.ids, r.decoded, r.kept) for r in rows] == [([505, 734], "one two", "extra"), ([], "", "extra")]
