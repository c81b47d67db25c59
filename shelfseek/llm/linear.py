"""Hashed n-gram features and logistic regression with calibrated probabilities.

A text has four feature families: single words, word pairs, and runs of two
and of four characters. Each family is hashed into its own range of buckets
and weighs the same in every text, whatever the text's length: a feature's
value is its share of the family's occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from shelfseek.llm import text as tx

BITS = 16
FAMILIES = 4
SIZE = FAMILIES << BITS
#: Shares are small numbers; this makes a typical feature's value about one.
SCALE = 20.0
#: Features whose products a step of the fit holds at once.
BLOCK_FEATURES = 1 << 18

_MULTIPLIER, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _joined(values: np.ndarray, width: int) -> np.ndarray:
    """One number of each two runs of ``width`` values side by side, from the number of each such run."""
    mixed = values[:max(0, len(values) - width)] * np.uint64(pow(_MULTIPLIER, width, 1 << 64))
    mixed += values[width:]
    return mixed


def _buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each hash within its family, as indices that need no further copy."""
    return (hashes >> np.uint64(64 - BITS)).view(np.int64)


def _spread_buckets(mixed: np.ndarray) -> np.ndarray:
    """The same of numbers whose bits are yet to be spread."""
    out = mixed * _SPREAD
    out ^= out >> np.uint64(32)
    out *= _SPREAD
    out >>= np.uint64(64 - BITS)
    return out.view(np.int64)


class TextBatch:
    """The words and characters of a slice of texts."""

    def __init__(self, column: pa.Array):
        self.buf, self.offsets = tx.flat(column)
        self.starts, self.ends, self.first = tx.word_bounds(self.buf, self.offsets, tx.SPACES)
        self.words = tx.run_hashes(self.buf, self.starts, self.ends)
        inner = np.flatnonzero((self.buf & 0xC0) == 0x80)
        #: Characters before each row.
        self.first_char = self.offsets - np.searchsorted(inner, self.offsets)

    def features(self):
        """For each family, the bucket of every window, and each row's first window and the end of its last.

        Windows between those of two rows cross their border and belong to neither.
        """
        yield _buckets(self.words), *self._rows(self.first, 1)
        yield _spread_buckets(_joined(self.words, 1)), *self._rows(self.first, 2)
        codes = np.frombuffer(self.buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.uint64)
        pairs = _joined(codes, 1)
        yield _spread_buckets(pairs), *self._rows(self.first_char, 2)
        yield _spread_buckets(_joined(pairs, 2)), *self._rows(self.first_char, 4)

    @staticmethod
    def _rows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, int(first[-1]) - width + 1)
        begin = np.minimum(first[:-1], n)
        return begin, np.maximum(begin, first[1:] - width + 1)

    def sparse(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct buckets and values of each row."""
        rows: list[list] = [[] for _ in range(len(self.offsets) - 1)]
        for family, (buckets, begin, end) in enumerate(self.features()):
            for row, part in enumerate(buckets[a:z] for a, z in zip(begin.tolist(), end.tolist())):
                if len(part):
                    at, count = np.unique(part.astype(np.int32), return_counts=True)
                    rows[row].append((at + np.int32(family << BITS), (count * (SCALE / len(part))).astype(np.float32)))
        none = (np.zeros(0, np.int32), np.zeros(0, np.float32))
        return [(np.concatenate([a for a, _ in r]), np.concatenate([v for _, v in r])) if r else none
                for r in rows]

    def logits(self, weights: np.ndarray, bias: float, sums: np.ndarray | None = None) -> np.ndarray:
        """The linear score of each row, the same as of its sparse features.

        ``sums`` are the running sums of the families and go on here: slices that are scored one after another
        with the same array get the scores of one whole, to the last bit.
        """
        sums = np.zeros(FAMILIES) if sums is None else sums
        out = np.full(len(self.offsets) - 1, bias)
        for family, (buckets, begin, end) in enumerate(self.features()):
            run = np.empty(len(buckets) + 1)
            run[0] = sums[family]
            run[1:] = weights[family << BITS:(family + 1) << BITS].take(buckets)
            # Windows that cross a border count nothing.
            for k in range(int((begin[1:] - end[:-1]).max(initial=0))):
                at = end[:-1] + k
                run[1 + at[at < begin[1:]]] = 0.0
            np.cumsum(run, out=run)
            sums[family] = run[-1]
            out += (run[end] - run[begin]) * SCALE / np.maximum(end - begin, 1)
        return out


@dataclass
class Logistic:
    """Weights, and the scale and shift that turn a linear score into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    held_out: dict = field(default_factory=dict)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logits + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int = SIZE,
        steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Logistic:
    """Logistic regression over sparse rows by full gradients with adaptive steps.

    Both classes weigh the same in sum. The rows are those of a bounded sample; of what a step computes only
    blocks of rows are held, added up in the order of the rows.
    """
    y = labels.astype(np.float64)
    lengths = np.array([len(a) for a, _ in rows])
    at = np.concatenate([np.zeros(0, np.int32), *(a for a, _ in rows)])
    value = np.concatenate([np.zeros(0, np.float32), *(v for _, v in rows)])
    present = np.bincount(at, minlength=size) > 0
    used = np.flatnonzero(present)
    at = (np.cumsum(present, dtype=np.int32) - 1)[at]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    cuts = [0]
    while cuts[-1] < len(rows):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + BLOCK_FEATURES, "right")) - 1))
    blocks = [(a, b, slice(int(ends[a]), int(ends[b])), np.repeat(np.arange(b - a, dtype=np.int32), lengths[a:b]))
              for a, b in zip(cuts, cuts[1:])]
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, steps + 1):
        light, score = w.astype(np.float32), np.zeros(len(rows))
        for a, z, part, row in blocks:
            score[a:z] = np.bincount(row, light[at[part]] * value[part], z - a)
        error = (sigmoid(score + b) - y) * share
        light, g = error.astype(np.float32), np.zeros(len(used))
        for a, z, part, row in blocks:
            np.add.at(g, at[part], (light[a:z][row] * value[part]).astype(np.float64))
        g += decay * w
        gb = float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Logistic(weights, b)


def score_sparse(model: Logistic, rows) -> np.ndarray:
    return np.array([float(np.dot(model.weights[a].astype(np.float64), v)) + model.bias for a, v in rows])


def calibrate(model: Logistic, logits: np.ndarray, labels: np.ndarray) -> Logistic:
    """Fit slope and shift on held-out rows (Platt scaling with smoothed targets)."""
    y = labels.astype(bool)
    pos, neg = int(y.sum()), int((~y).sum())
    if not pos or not neg:
        return model
    target = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = float(np.abs(logits).max()) or 1.0
    x = logits / spread

    def loss(a, b):
        z = a * x + b
        return float((np.logaddexp(0, z) - target * z).sum()) + 5e-4 * a * a

    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * x + b)
        g = np.array([np.dot(p - target, x) + 1e-3 * a, (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[np.dot(h, x * x) + 1e-3, np.dot(h, x)], [np.dot(h, x), h.sum() + 1e-6]])
        step, size, now = np.linalg.solve(hess, g), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-7:
            break
    a /= spread
    if a > 0:
        model.slope, model.shift = float(a), float(b)
    p = model.probability(logits)
    model.held_out = {"rows": len(y), "accuracy": float(((p >= 0.5) == y).mean()),
                      "brier": float(((p - y) ** 2).mean())}
    return model
