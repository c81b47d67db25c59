"""The n-gram features and the metadata view against plain Python, and what they cost."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa

from shelfseek.llm import cotraining, linear, text as tx

TEXTS = ["", None, "a", "é", "two words", "ab", "日本語 12 \U0001f600!", " \t\n", "Tail #1\r\n<b> 50% | x\x7f\x00", "x" * 300,
         "The 3 cats & dogs\nran\x0bfar, far away. " * 9, ""]
MASK = (1 << 64) - 1


def _bucket(values, family):
    mixed = 0
    for v in values:
        mixed = (mixed * 0x9E3779B97F4A7C15 + v) & MASK
    if len(values) > 1:
        mixed = mixed * 0xD6E8FEB86659FD93 & MASK
        mixed = (mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 & MASK
    return (mixed >> 48) + (family << 16)


def _plain(text):
    batch = linear.TextBatch(pa.array([text], pa.string()))
    found = {}
    for family, (values, width) in enumerate([(batch.words.tolist(), 1), (batch.words.tolist(), 2),
                                              ([*map(ord, text or "")], 2), ([*map(ord, text or "")], 4)]):
        n = max(0, len(values) - width + 1)
        for bucket, count in Counter(_bucket(values[i:i + width], family) for i in range(n)).items():
            found[bucket] = np.float32(count * (linear.SCALE / n))
    return found


def test_features_equal_plain_ones():
    batch = linear.TextBatch(pa.array(TEXTS, pa.string()))
    rows = batch.sparse()
    assert [dict(zip(at.tolist(), value)) for at, value in rows] == [_plain(t) for t in TEXTS]
    weights = np.random.default_rng(3).normal(size=linear.SIZE).astype(np.float32)
    model = linear.Logistic(weights, 0.25)
    assert np.allclose(batch.logits(weights, 0.25), linear.score_sparse(model, rows), rtol=1e-5, atol=1e-5)
    for i, text in enumerate(TEXTS):
        alone = linear.TextBatch(pa.array([text], pa.string())).logits(weights, 0.25)
        assert np.allclose(alone, batch.logits(weights, 0.25)[i], rtol=0, atol=1e-11)
    sums = np.zeros(linear.FAMILIES)
    slices = [linear.TextBatch(pa.array(TEXTS[a:a + 3], pa.string())) for a in range(0, len(TEXTS), 3)]
    parts = np.concatenate([b.logits(weights, 0.25, sums) for b in slices])
    assert (parts == batch.logits(weights, 0.25)).all()
    for none in ([], [None, ""]):
        got = linear.TextBatch(pa.array(none, pa.string()))
        assert got.logits(weights, 0.25).tolist() == [0.25] * len(none) and len(got.sparse()) == len(none)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = pa.array(["short words and " + "w" * 40_000 + " more of them " * 3000])
    buf, offsets = tx.flat(text)
    starts, ends, _ = tx.word_bounds(buf, offsets, tx.SPACES)
    whole = tx.run_hashes(buf, starts, ends)
    monkeypatch.setattr(tx, "PIECE", 41)
    assert (tx.run_hashes(buf, starts, ends) == whole).all()
    alone = [tx.run_hashes(buf[a:z], np.array([0]), np.array([z - a]))[0] for a, z in zip(starts[:20], ends[:20])]
    assert whole[:20].tolist() == [int(h) for h in alone]


def test_meta_features_equal_plain_ones():
    rows = pa.RecordBatch.from_pydict({
        "lang": pa.array([None] * len(TEXTS), pa.string()), "source": pa.array(["a"] * len(TEXTS)),
        "n_chars": pa.array([None if t is None else len(t) for t in TEXTS], pa.int64())})
    got = cotraining.meta_features(rows, linear.TextBatch(pa.array(TEXTS, pa.string())))
    level = lambda x: int(min(31, np.log2(x + 1)))
    for row, text in zip(got.tolist(), TEXTS):
        data = (text or "").encode()
        lines, words = data.count(b"\n") + 1, max(1, len((text or "").encode("ascii", "replace").decode().split(None)))
        share = lambda keep: int(min(31, sum(map(keep, data)) / max(1, len(data)) * 60))
        other = lambda c: 32 < c < 127 and not chr(c).isalnum()
        want = [0 if text is None else level(len(text)), level(lines), level(words / lines),
                share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(other),
                share(lambda c: c in b"#*$%&|<>"), share(lambda c: c >= 128), share(lambda c: c in b" \t\n\x0b\x0c\r")]
        assert [v - 256 - 32 * k for k, v in enumerate(row[2:])] == want


def test_scoring_costs_few_passes(rng, words):
    """CPU time of a scoring pass, in passes of a plain sum over as many bytes."""
    text = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(800)]
    batch = pa.RecordBatch.from_pydict({
        "text": pa.array(text), "lang": pa.array(["en"] * 800), "source": pa.array(["a"] * 800),
        "n_chars": pa.array([*map(len, text)], pa.int64())})
    weights = np.ones(linear.SIZE, np.float32)
    data = tx.flat(batch.column("text"))[0]
    slices = [*tx.pieces(iter([batch]), "text", getattr(cotraining, "PIECE", tx.PIECE))]

    def score():
        for part in slices:
            texts = linear.TextBatch(part.column("text"))
            cotraining.meta_features(part, texts)
            texts.logits(weights, 0.0)

    def plain():
        for at in range(0, len(data), 1 << 16):
            np.cumsum(data[at:at + (1 << 16)], dtype=np.uint64)

    def least(function):
        times = []
        for _ in range(7):
            start = time.process_time()
            function()
            times.append(time.process_time() - start)
        return min(times)

    # 21 when written, and 51 with arrays of 8 MB, masks of windows and running sums of every kind of byte.
    assert least(score) < 35 * least(plain)
