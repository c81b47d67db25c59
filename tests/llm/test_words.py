"""The word kernel against regular expressions."""

import re

import numpy as np
import pyarrow as pa

from shelfseek.llm import text as tx

TEXTS = ["", "one", " two  words ", "tab\tnew\nline\x0bx", None, "é ü\u00a0ñ", "a" * 50, "x y " * 40, "\u2003wide\u2003 space"]


def _words(table):
    buf, offsets = tx.flat(pa.array(TEXTS, pa.string()))
    starts, ends, first = tx.word_bounds(buf, offsets, table)
    data = buf.tobytes()
    words = [data[a:b].decode() for a, b in zip(starts, ends)]
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


def test_words():
    assert _words(tx.SPACES) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert _words(tx.NOT_ALNUM) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "") for t in TEXTS]


def test_slices_of_arrays():
    buf, offsets = tx.flat(pa.array(["zero", "one", None, "three"]).slice(1))
    assert buf.tobytes() == b"onethree" and offsets.tolist() == [0, 3, 3, 8]


def test_hashes_depend_on_content_only(monkeypatch):
    words = ["alpha", "beta", "alpha", "bet", "a", "alpha"] * 300
    buf, offsets = tx.flat(pa.array([" ".join(words)]))
    starts, ends, _ = tx.word_bounds(buf, offsets, tx.SPACES)
    whole = tx.run_hashes(buf, starts, ends)
    assert len(set(whole.tolist())) == 4
    assert len({(w, h) for w, h in zip(words, whole.tolist())}) == 4
    monkeypatch.setattr(tx, "PIECE", 37)
    assert (tx.run_hashes(buf, starts, ends) == whole).all()


def test_windows():
    values = np.arange(10, dtype=np.uint64)
    assert len(tx.window_hashes(values, 4)) == 7 and len(tx.window_hashes(values, 11)) == 0


def test_pieces_hold_whole_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", "bb", None, "c" * 100, "d"]})
    sizes = [p.num_rows for p in tx.pieces(iter([batch]), "t", 7)]
    assert sizes == [3, 1, 1]
