"""Vectorised word handling over Arrow batches of texts.

A batch of texts is one byte array and the offsets of its rows. Words are
maximal runs of bytes outside a set of gap bytes; UTF-8 keeps every byte of a
character beyond ASCII at 0x80 or more, so byte classes and character classes
of ASCII separators agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from shelfseek.session import ship_package

#: Bytes of text handled at once, so that temporary arrays stay small.
PIECE = 1 << 20
BATCH_BYTES = 16 << 20
#: Bytes of words hashed at once, so that what a step computes stays in a core's cache.
HASHED = 1 << 14

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_POWERS, _INVERSES = _powers(_MULTIPLIER, HASHED), _powers(_INVERSE, HASHED)


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Separators of plain words: space and 0x09 to 0x0D.
SPACES = _bytes_in((0x20, 0x20), (0x09, 0x0D))
#: Separators of letter and digit words: ASCII but a-z and 0-9, to be used after lower-casing.
NOT_ALNUM = _bytes_in((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def prepare(spark: SparkSession) -> None:
    """What Arrow operators need of a session: this package on the workers, batches bounded in bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the session prepared."""
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offset of each row in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or
                              pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``limit`` bytes of ``column``; a longer row comes alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def word_bounds(buf: np.ndarray, offsets: np.ndarray,
                gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of its first word."""
    inside = ~gaps.take(buf)
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][offsets[:-1] < len(buf)]
        first[begins] = inside[begins]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run; runs are in order of their starts and of their ends."""
    out = np.empty(len(starts), np.uint64)
    block = min(PIECE, HASHED)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        low, high = starts[i], ends[j - 1]
        n = high - low
        values = buf[low:high].astype(np.uint64)
        values += np.uint64(1)
        # A longer run comes alone.
        values *= _POWERS[:n] if n <= HASHED else _powers(_MULTIPLIER, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * _INVERSES[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values; one for each position that has enough after it."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_MULTIPLIER) + words[k:k + n])
    return out


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of every word, from the number of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
