"""Benchmark decontamination by suffix arrays over shards of the training text.

Each shard of documents is turned into word codes and sorted as a suffix
array; every suffix of every benchmark item is then looked up in it by binary
search. A window is ``width`` consecutive item words; an item with fewer
words, but at least one, is a single shorter window.

Only training suffixes that begin with known words are kept in an array: a
suffix with another word among its first words cannot match any window.

Defined results. Null or empty texts have no words, and such items no window.
Items without an id mark words but are not listed. Repeated documents are
judged row by row; repeated items count once. Empty tables give no rows, or
rows without hits. Other columns of the documents are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfseek.llm import text as tx
from shelfseek.sources.tables import stored

WIDTH = 10
#: A larger benchmark is searched in blocks of about this size, one after the other.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20


class TestSuffixes:
    """The word codes and windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WIDTH):
        buf, offsets = tx.flat(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = tx.word_bounds(tx.LOWER[buf], offsets, tx.NOT_ALNUM)
        hashes = tx.run_hashes(tx.LOWER[buf], starts, ends)
        self.width = width
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        codes = codes.astype(np.uint32) + np.uint32(1)
        self.ids = [i for i, _ in items]
        self.codes = [codes[a:b] for a, b in zip(first[:-1], first[1:])]
        windows: dict[bytes, list[int]] = {}
        self.suffixes: list[tuple[int, int]] = []
        for item, words in enumerate(self.codes):
            size = min(width, len(words))
            for at in range(len(words) - size + 1) if size else ():
                windows.setdefault(words[at:at + size].astype(">u4").tobytes(), []).append(
                    len(self.suffixes))
                self.suffixes.append((item, at))
        keys = sorted(windows)
        self.sizes = np.array([len(k) // 4 for k in keys], np.int64)
        self.low = np.array([k.ljust(4 * width, b"\0") for k in keys], f"S{4 * width}")
        self.high = np.array([k.ljust(4 * width, b"\xff") for k in keys], f"S{4 * width}")
        self.of_window = [windows[k] for k in keys]

    def encode(self, buf, offsets):
        """Word codes of a shard (0: no word of the items) and the first word of each row."""
        starts, ends, first = tx.word_bounds(buf, offsets, tx.NOT_ALNUM)
        hashes = tx.run_hashes(buf, starts, ends)
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint32), first
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32), first

    def suffix_array(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the shard's suffixes in sorted order, and their leading words as bytes."""
        least = int(self.sizes.min()) if len(self.sizes) else 0
        if not least or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, f"S{4 * self.width}")
        end = first[1:][tx.rows_of(first)]
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        at = np.arange(len(codes))
        upto = at + least
        ok = upto <= end
        at, end = at[ok], end[ok]
        ok = known[at + least] - known[at] == least
        at, end = at[ok], end[ok]
        key = np.zeros((len(at), self.width), ">u4")
        for k in range(self.width):
            inside = at + k < end
            key[inside, k] = codes[at[inside] + k]
        key = np.ascontiguousarray(key).view(f"S{4 * self.width}").reshape(-1)
        order = np.argsort(key, kind="stable")
        return at[order], key[order]

    def occurrences(self, codes, first) -> Iterator[tuple[int, np.ndarray]]:
        """For each window found in the shard, its number and the word positions."""
        at, key = self.suffix_array(codes, first)
        low = np.searchsorted(key, self.low, "left")
        high = np.searchsorted(key, self.high, "right")
        for window in np.flatnonzero(high > low):
            yield int(window), at[low[window]:high[window]]


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int,
            width: int) -> Iterator[TestSuffixes]:
    items = benchmark.select(F.col(id_column).cast("string").alias("id"),
                             F.coalesce(F.col(text_column), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    for block in range(count):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block)
        yield TestSuffixes([(r["id"], r["text"]) for r in part.collect()], width)


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text",
              item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``_n_words``, ``_hits`` (hit word positions) and ``_items`` (ids found).

    Rows travel as one column, so that no name of theirs meets one of these steps.
    """
    spark = docs.sparkSession
    names = ["row", "_text"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"),
                      F.lit(0).cast("long").alias("_n_words"), F.array().cast("array<int>").alias("_hits"),
                      F.array().cast("array<string>").alias("_items"))
    blocks = list_ahead(_blocks(benchmark, item_id, item_text, block_bytes, width))
    for block, more in blocks:
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            tests: TestSuffixes = shared.value
            for batch in tx.pieces(batches, "_text", SHARD_BYTES):
                buf, offsets = tx.flat(batch.column("_text"))
                codes, first = tests.encode(tx.LOWER[buf], offsets)
                hit = np.zeros(len(codes) + 1, np.int64)
                found: list[tuple[np.ndarray, int]] = []
                for window, at in tests.occurrences(codes, first):
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + tests.sizes[window], -1)
                    rows = np.unique(np.searchsorted(first, at, "right") - 1)
                    found.append((rows, window))
                hit = np.cumsum(hit[:-1]) > 0
                items: dict[int, set[str]] = {}
                for rows, window in found:
                    ids = {tests.ids[tests.suffixes[s][0]] for s in tests.of_window[window]} - {None}
                    for row in rows:
                        items.setdefault(int(row), set()).update(ids)
                old_hits, old_items = batch.column("_hits"), batch.column("_items")
                hits, listed = [], []
                marked = np.concatenate([[0], np.cumsum(hit)])
                for row in range(batch.num_rows):
                    a, b = first[row], first[row + 1]
                    before = old_hits[row].as_py()
                    here = np.flatnonzero(hit[a:b]) if marked[b] > marked[a] else ()
                    hits.append(np.union1d(here, before).astype(np.int32) if before else here)
                    listed.append(sorted(items.get(row, set()) | set(old_items[row].as_py())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in names] + [
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([list(h) for h in hits], pa.list_(pa.int32())),
                        pa.array(listed, pa.list_(pa.string()))], names=batch.schema.names)

        out = tx.mapped(out, search, out.schema)
        if more:
            out = stored(out, "decontaminate")
    return out.drop("_text")


def list_ahead(values: Iterator) -> Iterator[tuple]:
    """Each value with whether another follows."""
    values = iter(values)
    current = next(values)
    for following in values:
        yield current, True
        current = following
    yield current, False


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id",
                    text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every longest verbatim match: where it is in the item and in the document, and its words.

    A match cannot be extended to either side. Columns ``doc_id``, ``doc_word``,
    ``item_id``, ``item_word``, ``n_words``.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, doc_word long, item_id string, item_word long, n_words long"
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_bytes, width):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            tests: TestSuffixes = shared.value
            for batch in tx.pieces(batches, text, SHARD_BYTES):
                buf, offsets = tx.flat(batch.column(text))
                codes, first = tests.encode(tx.LOWER[buf], offsets)
                rows: list[tuple] = []
                for window, found in tests.occurrences(codes, first):
                    for suffix in tests.of_window[window]:
                        item, at = tests.suffixes[suffix]
                        words = tests.codes[item]
                        for pos in found.tolist():
                            row = int(np.searchsorted(first, pos, "right")) - 1
                            if at and pos > first[row] and codes[pos - 1] == words[at - 1]:
                                continue
                            most = min(len(words) - at, int(first[row + 1]) - pos)
                            differ = np.flatnonzero(codes[pos:pos + most] != words[at:at + most])
                            size = int(differ[0]) if len(differ) else most
                            rows.append((batch.column(0)[row].as_py(), pos - int(first[row]),
                                         tests.ids[item], at, size))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()),
                     pa.array(columns[4], pa.int64())],
                    names=["doc_id", "doc_word", "item_id", "item_word", "n_words"])

        part = tx.mapped(docs.select(doc_id, text), search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, and a digest of the items found in it."""
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.size("_hits").cast("long")
    return found.select(
        "row.doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window, with their columns."""
    return find_hits(docs, benchmark).filter(F.size("_hits") == 0).select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
