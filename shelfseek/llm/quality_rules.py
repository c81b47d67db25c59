"""Quality rules: fixed counts per text, and a calibrated n-gram classifier for the rest.

The classifier is a logistic regression over hashed word and character
n-grams, fitted on labelled rows and calibrated on a fifth of them that the
fit did not see. It is fitted on a bounded sample of labelled rows: at most
``MAX_LABELLED`` of each class, those with the smallest hash of their id.
Everything else covers every document and its whole text.

Defined results. A null or empty text has no words and fails the base rule.
Without labels of both classes there is no classifier and the base rule alone
decides. Labels that are null, or that have no document, are ignored; of
contradicting labels of one id the smaller counts. Repeated rows are judged
one by one. Empty tables give no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from shelfseek.llm import linear, text as tx

MAX_LABELLED = 1500
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.split(None, 1):
            seen.add(line)
    return found


def repeated_words(words: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each row that lie in a window which its text holds at least twice."""
    rows = tx.rows_of(first)
    hashes = tx.window_hashes(words, width)
    n = len(hashes)
    inside = rows[:n] == rows[width - 1:] if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    keys = tx.mix(hashes[at] + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def counts(batch: linear.TextBatch) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    buf, offsets = batch.buf, batch.offsets
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    data = buf.tobytes()
    return {
        "n_words": np.diff(batch.first),
        "word_chars": np.diff(batch.first_char) - per_row(tx.SPACES[buf]),
        "n_symbols": per_row(SYMBOLS[buf]),
        "n_dup_lines": np.array([duplicate_lines(data[a:b]) for a, b in zip(
            offsets[:-1].tolist(), offsets[1:].tolist())], np.int64),
        "n_repeat_words": repeated_words(batch.words, batch.first)}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED,
                    columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Labelled documents: of each class at most ``limit``, by the smallest hash of the id; one row of each id."""
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.min(F.col(label).cast("int")).alias("_label")).filter("_label in (0, 1)")
    picked = None
    for value in (0, 1):
        part = clean.filter(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * limit rows of two numbers.
    rows = docs.select(*columns).join(F.broadcast(picked), "doc_id")
    others = [c for c in rows.columns if c != "doc_id"]
    # Of repeated ids the least row, found while tasks still aggregate.
    return rows.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("least")).select(
        "doc_id", *[F.col("least")[c].alias(c) for c in others])


def sparse_rows(sample: DataFrame) -> DataFrame:
    """Hashed features of the sample's texts."""
    def featurize(batches):
        for batch in tx.pieces(batches, "text"):
            rows = linear.TextBatch(batch.column("text")).sparse()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"),
                 pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
                names=["doc_id", "_label", "at", "value"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    return tx.mapped(sample.select("doc_id", "_label", "text"), featurize,
                     f"doc_id {kind}, _label int, at binary, value binary")


def unpack(table: pa.Table) -> tuple[list, np.ndarray]:
    order = pc.sort_indices(table, [("doc_id", "ascending")]).to_pylist()
    # Views of what was collected, not copies.
    at, value = table["at"], table["value"]
    rows = [(np.frombuffer(at[i].as_buffer(), "<i4"), np.frombuffer(value[i].as_buffer(), "<f4")) for i in order]
    return rows, np.array(table["_label"].to_pylist(), np.int64)[order]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          limit: int = MAX_LABELLED) -> linear.Logistic | None:
    """The calibrated classifier, or None without labels of both classes."""
    def fitted(batches):
        batches = list(batches)
        model = None
        if batches:
            rows, y = unpack(pa.Table.from_batches(batches))
            model = fit_calibrated(rows, y, linear.SIZE)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The bounded sample meets in one task, and the model alone comes to the driver.
    sample = sparse_rows(labelled_sample(docs, labels, label, limit)).repartition(1)
    found = tx.mapped(sample, fitted, "model binary").first()
    return None if found is None else pickle.loads(found["model"])


def fit_calibrated(rows: list, y: np.ndarray, size: int) -> linear.Logistic | None:
    """Fit on four of five rows and calibrate on the fifth."""
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        return None
    model = linear.fit([r for r, h in zip(rows, held) if not h], y[~held], size)
    return linear.calibrate(model, linear.score_sparse(model, [r for r, h in zip(rows, held) if h]), y[held])


def apply_rules(docs: DataFrame, labels: DataFrame, *, label: str = "quality",
                threshold: float = THRESHOLD, limit: int = MAX_LABELLED,
                carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default) with the base counts, ``base_failed``, ``score``, ``kept``.

    ``score`` is the calibrated probability of good quality, null without a classifier.
    """
    model = train(docs, labels, label, limit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = docs.columns if carry is None else carry
    new = [*COUNTS, "base_failed", "score", "kept"]
    out = docs.select(*[c for c in carry if c not in new], F.col("text").alias("_text"))

    def judge(batches):
        model = shared.value
        for batch in tx.pieces(batches, "_text"):
            texts = linear.TextBatch(batch.column("_text"))
            found = counts(texts)
            failed = (found["n_words"] < MIN_WORDS) | (
                found["n_repeat_words"] > MAX_REPEATED * found["n_words"])
            if model is None:
                score, good = pa.nulls(batch.num_rows, pa.float64()), ~failed
            else:
                p = model.probability(texts.logits(model.weights, model.bias))
                score, good = pa.array(p), ~failed & (p >= threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(found[c], pa.int64()) for c in COUNTS),
                 pa.array(failed), score, pa.array(good)],
                names=[*batch.schema.names[:-1], *new])

    schema = out.drop("_text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")
    return tx.mapped(out, judge, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    return apply_rules(docs, labels, carry=["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    # Rows travel as one column, so that no name of theirs meets one of these steps.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    judged = apply_rules(whole, labels, carry=["_row"])
    return judged.filter("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
