"""Exact removal of repeated passages, by a sparse suffix array sorted deep-shallow.

A byte goes if it lies in a string of ``GRAM`` bytes that also starts in a
document with a smaller id. Such a string is found through its anchor: of the
``SEED`` byte strings in it, the one with the least hash. Equal strings have equal
anchors at equal places, so only anchors that occur in more than one document
matter, and the suffix array needs to hold no other suffixes.

Three rounds over the texts, dealt into parts by id and text, so that rows without
id or with a repeated one spread too:

1. Anchors meet by hash; those of more than one document are sent back.
2. Each part sends the distinct surroundings of those anchors (the bytes that a
   string around the anchor can reach). Surroundings that share an anchor are
   sorted to the right and, reversed, to the left: words of bytes by multikey
   sorting to the depth ``SHALLOW``, groups with a longer common prefix by blind
   tries. Neighbours' common prefixes then tell for every offset which strings are
   equal, and the least document of each.
3. Each part marks and cuts its texts.

Parts and groups are bounded in bytes: anchors and surroundings are made
distinct in each part before they move, and an anchor with very many surroundings
is split into its strings, each grouped by its own content.

Defined results. A null or empty text has no bytes and nothing removed. Documents
without id come after all others and remove nothing from each other, as rows
with the same id do. Texts shorter than ``GRAM`` stay. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from shelfseek.llm import text as tx
from shelfseek.sources.tables import stored

GRAM = 50
SEED = 20
REACH = GRAM - SEED
SHALLOW = 16
#: Bytes of text in a part, anchors in a group, and the fewest of both.
PART_BYTES = 8 << 20
GROUP_ANCHORS = 1 << 20
LEAST_PARTS = 64
#: An anchor that so many parts and documents hold is split into strings.
HOT_ENTRIES = 20_000
BLOCK = 1 << 18
NO_ID = (1 << 63) - 1
_HOT = np.uint64(1 << 63)

_M = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def part_of(places: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the hash of id and text."""
    return (tx.mix(places.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _slide(x: np.ndarray, f) -> np.ndarray:
    """``f`` over each ``REACH + 1`` (31) neighbours, by doubling."""
    for step in (1, 2, 4, 8):
        x = f(x[:-step], x[step:])
    return f(x[:-15], x[15:])


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of ``GRAM`` bytes within rows."""
    found, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if not _powers:
        size = tx.PIECE + GRAM
        for name, value in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            _powers[name] = np.full(size, value, np.uint64)
            _powers[name][0] = 1
            _powers[name] = np.cumprod(_powers[name])
    for start in range(0, max(0, len(buf) - GRAM + 1), tx.PIECE):
        seg = buf[start:start + tx.PIECE + GRAM - 1]
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * _powers["up"][:len(seg)], out=sums[1:])
        n = len(seg) - SEED + 1
        h = tx.mix((sums[SEED:] - sums[:-SEED]) * _powers["down"][:n])
        least = _slide(h, np.minimum)
        # Strings across the end of a row do not count.
        ends = offsets[(offsets > start) & (offsets < start + len(seg))] - start
        cross = np.zeros(len(least) + 1, np.int64)
        np.add.at(cross, np.clip(ends - GRAM + 1, 0, len(least)), 1)
        np.add.at(cross, np.clip(ends, 0, len(least)), -1)
        least[np.cumsum(cross[:-1]) > 0] = 0
        wide = np.zeros(len(least) + 2 * REACH, np.uint64)
        wide[REACH:-REACH] = least
        at = np.flatnonzero(_slide(wide, np.maximum) == h)
        found.append(at + start)
        hashes.append(h[at])
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(hashes)[first]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (first one leads), starts of equal runs in it, and each row's run."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


def _row_hashes(rows: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of byte rows and further values."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    words = padded.view(np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = np.full(len(rows), seed, np.uint64)
        for column in [*words.T, *(m.astype(np.uint64) for m in more)]:
            h = tx.mix(h * np.uint64(seed) + column)
        out.append(h)
    return out[0], out[1]


# ---- round 1

def _anchor_blocks(batches, buckets: int, parts: int):
    """Rows of ``bucket``, ``hashes``, ``ids`` and ``places`` (parts): of each part's hash the first and last document."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def flush():
        h, ids, place = (np.concatenate(x) for x in zip(*held))
        order, starts, _ = _groups(h, place, ids)
        h, ids, place = (x[order][starts] for x in (h, ids, place))
        edge = np.ones(len(h), bool)
        edge[1:] = (h[1:] != h[:-1]) | (place[1:] != place[:-1])
        last = np.ones(len(h), bool)
        last[:-1] = edge[1:]
        h, ids, place = (x[edge | last] for x in (h, ids, place))
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, ids, place, bucket = h[order], ids[order], place[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        narrow = [x.view(np.uint8).reshape(-1, 8)[:, :6] for x in np.split(h, cuts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(b[0]) for b in np.split(bucket, cuts)], pa.int32()),
             pa.array([np.ascontiguousarray(x).tobytes() for x in narrow], pa.binary()),
             *(pa.array([_pack(x) for x in np.split(values, cuts)], pa.binary()) for values in (ids, place))],
            names=["bucket", "hashes", "ids", "places"])

    for batch in tx.pieces(batches, "text", 4 * tx.PIECE):
        buf, offsets = tx.flat(batch.column("text"))
        pos, h = anchors(buf, offsets)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        place = part_of(batch.column("place").to_numpy(zero_copy_only=False), parts)
        row = np.searchsorted(offsets, pos, "right") - 1
        held.append((h >> np.uint64(16), ids[row], place[row]))
        count += len(pos)
        if count >= BLOCK:
            yield flush()
            held, count = [], 0
    if count:
        yield flush()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _shared_anchors(table: pa.Table, hot: int) -> pa.Table:
    """For each part, its hashes that more than one document has; the top bit marks hot ones."""
    h = np.concatenate([_wide(x) for x in table["hashes"].to_pylist()])
    ids = np.concatenate([_unpack(x, np.int64) for x in table["ids"].to_pylist()])
    place = np.concatenate([_unpack(x, np.int32) for x in table["places"].to_pylist()])
    order, starts, run = _groups(h)
    low, high = np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts)
    many = np.diff(np.append(starts, len(h))) > hot
    keep = (low < high)[run]
    h = np.where(many[run], h | _HOT, h)[keep]
    place = place[keep]
    order, starts, _ = _groups(place, h)
    h, place = h[order][starts], place[order][starts]
    cuts = np.flatnonzero(np.diff(place)) + 1
    some = [x for x in np.split(h, cuts) if len(x)]
    return pa.table({"part": pa.array([int(x[0]) for x in np.split(place, cuts) if len(x)], pa.int32()),
                     "kind": pa.array(["shared"] * len(some), pa.string()),
                     "one": pa.array([_pack(x) for x in some], pa.binary()),
                     "two": pa.array([b""] * len(some), pa.binary())})


# ---- round 2

class Part:
    """The occurrences of shared anchors in a part's texts, and the distinct surroundings (units)."""

    def __init__(self, texts: pa.Table, shared: np.ndarray):
        order = np.argsort(texts["id"].to_numpy(), kind="stable")
        self.texts = texts.take(pa.array(order))
        self.ids = self.texts["id"].to_numpy()
        unzip = zstandard.ZstdDecompressor()
        data = [unzip.decompress(x) for x in self.texts["packed"].to_pylist()]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        self.buf = np.frombuffer(b"".join(data), np.uint8)
        hot = np.sort(shared[shared >= _HOT] ^ _HOT)
        known = np.sort(shared & ~_HOT)
        pos, h = anchors(self.buf, self.offsets)
        member = lambda keys, x: (keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x
                                  if len(keys) else np.zeros(len(x), bool))
        seen = member(known, h >> np.uint64(16))
        self.pos, h = pos[seen], h[seen]
        self.row = np.searchsorted(self.offsets, self.pos, "right") - 1
        begin, end = self.offsets[self.row], self.offsets[self.row + 1]
        left = np.minimum(self.pos - begin, REACH).astype(np.uint8)
        right = np.minimum(end - self.pos - SEED, REACH).astype(np.uint8)
        around = self._around(left, right)
        first_hash, second_hash = _row_hashes(around, h, left, right)
        order, starts, self.entry = _groups(first_hash, second_hash)
        of = order[starts]
        doc = np.minimum.reduceat(self.ids[self.row][order], starts) if len(starts) else np.zeros(0, np.int64)
        split = member(hot, h[of] >> np.uint64(16))
        # Units: surroundings of ordinary anchors, then the strings of hot ones.
        self.hot = split
        self.unit = np.where(split, -1, np.cumsum(~split) - 1)
        self.string_unit = np.full((len(of), REACH + 1), -1, np.int64)
        self.h, self.left, self.right, self.around, self.doc = (
            x[~split] for x in (h[of], left[of], right[of], around[of], doc))
        self.valid = np.arange(REACH + 1) <= left[of][:, None]
        self.valid &= REACH - np.arange(REACH + 1) <= right[of][:, None]
        if split.any():
            self._split(around[of], doc)

    def _around(self, left, right) -> np.ndarray:
        """The bytes around each anchor, zero outside its row."""
        out = np.zeros((len(self.pos), GRAM + REACH), np.uint8)
        for k in range(GRAM + REACH):
            inside = (k >= REACH - left.astype(np.int64)) & (k < GRAM + right.astype(np.int64))
            out[inside, k] = self.buf[self.pos[inside] + k - REACH]
        return out

    def _split(self, around, doc):
        entry, o = np.nonzero(self.valid & self.hot[:, None])
        grams = np.zeros((len(entry), GRAM), np.uint8)
        for shift in range(REACH + 1):
            at = o == shift
            grams[at] = around[entry[at], REACH - shift:REACH - shift + GRAM]
        first_hash, second_hash = _row_hashes(grams)
        order, starts, run = _groups(first_hash, second_hash)
        self.string_unit[entry, o] = len(self.h) + run
        of = order[starts]
        rows = np.zeros((len(of), GRAM + REACH), np.uint8)
        rows[:, REACH:] = grams[of]
        self.h = np.concatenate([self.h, _row_hashes(grams[of, :SEED])[0]])
        self.left = np.concatenate([self.left, np.zeros(len(of), np.uint8)])
        self.right = np.concatenate([self.right, np.full(len(of), REACH, np.uint8)])
        self.around = np.concatenate([self.around, rows])
        self.doc = np.concatenate([self.doc, np.minimum.reduceat(doc[entry][order], starts)])

    def units(self, buckets: int, part: int) -> pa.Table:
        """The units dealt by anchor into buckets."""
        bucket = (tx.mix(self.h) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((self.h, bucket))
        bucket = bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, np.int64)
        pieces = np.split(order, cuts) if len(bucket) else []
        pack = lambda values: pa.array([_pack(values[p]) for p in pieces], pa.binary())
        return pa.table({
            "bucket": pa.array([int(b) for b in bucket[np.append(0, cuts)]] if len(bucket) else [], pa.int32()),
            "part": pa.array([part] * len(pieces), pa.int32()), "h": pack(self.h), "left": pack(self.left),
            "right": pack(self.right), "around": pack(self.around), "doc": pack(self.doc),
            "seq": pa.array([_pack(p.astype(np.uint32)) for p in pieces], pa.binary())})

    def cut(self, masks: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        """Per text: bytes, removed bytes, removed runs, remaining bytes; in the order of ``texts``."""
        cover = np.zeros(len(self.buf) + 1, np.int32)
        ids = self.ids[self.row]
        for o in range(REACH + 1):
            unit = np.where(self.hot, self.string_unit[:, o], self.unit)
            bit = np.where(self.hot, 0, o).astype(np.uint32)
            ok = (unit >= 0) & self.valid[:, o]
            safe = np.maximum(unit, 0)
            least = np.where(ok, self.doc[safe], NO_ID) if len(self.doc) else np.zeros(len(unit), np.int64)
            marked = ok & ((masks[safe] >> bit) & 1 > 0) if len(masks) else np.zeros(len(unit), bool)
            gone = (ids > least[self.entry]) | marked[self.entry]
            start = self.pos[gone] - o
            np.add.at(cover, start, 1)
            np.add.at(cover, start + GRAM, -1)
        removed = np.cumsum(cover[:-1], dtype=np.int32) > 0
        out = []
        for a, b in zip(self.offsets[:-1], self.offsets[1:]):
            here = removed[a:b]
            n = int(here.sum())
            runs = int(here[0]) + int((here[1:] & ~here[:-1]).sum()) if n else 0
            out.append((int(b - a), n, runs, self.buf[a:b][~here].tobytes() if n else self.buf[a:b].tobytes()))
        return out


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length, by a trie that stores branching places only."""
    root: list | int = 0                       # a leaf is its string's number, a node [place, {byte: child}]
    for number in range(1, len(strings)):
        mine = strings[number]
        node = root
        while not isinstance(node, int):       # blind: compare at branching places only
            node = node[1].get(mine[node[0]], next(iter(node[1].values())))
        other = strings[node]
        place = next(i for i in range(len(mine)) if mine[i] != other[i])
        parent, byte, node = None, None, root
        while not isinstance(node, int) and node[0] < place:
            parent, byte, node = node, mine[node[0]], node[1][mine[node[0]]]
        if not isinstance(node, int) and node[0] == place:
            node[1][mine[place]] = number
            continue
        branch = [place, {other[place]: node, mine[place]: number}]
        if parent is None:
            root = branch
        else:
            parent[1][byte] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
    return out


def suffix_array(h: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place among the sorted distinct (anchor, bytes), and the common prefixes of neighbours.

    Deep-shallow: multikey sorting by words of eight bytes to the depth
    ``SHALLOW``, then blind tries. Between different anchors the common prefix is -1.
    """
    first_hash, second_hash = _row_hashes(strings, h)
    order, starts, run = _groups(first_hash, second_hash)
    of = order[starts]
    h, rows = h[of], strings[of]
    words = np.zeros((len(of), SHALLOW), np.uint8)
    words[:, :min(SHALLOW, rows.shape[1])] = rows[:, :SHALLOW]
    words = words.view(">u8").astype(np.uint64)
    order, starts, _ = _groups(h, *words.T)
    ends = np.append(starts[1:], len(order))
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        group = order[a:b]
        deep = [rows[i, SHALLOW:].tobytes() for i in group]
        order[a:b] = group[blind_trie_order(deep)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows, h = rows[order], h[order]
    same = rows[1:] == rows[:-1]
    prefix = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1)) if len(same) else np.zeros(0, int)
    prefix[h[1:] != h[:-1]] = -1
    return place[run], prefix


def _masks(table: pa.Table) -> pa.Table:
    """For each part, the units with strings that a smaller document than their own first one has."""
    join = lambda name, kind: np.concatenate([_unpack(x, kind) for x in table[name].to_pylist()])
    h, left, right, doc = join("h", np.uint64), join("left", np.uint8), join("right", np.uint8), join("doc", np.int64)
    around = join("around", np.uint8).reshape(-1, GRAM + REACH)
    seq = [_unpack(x, np.uint32) for x in table["seq"].to_pylist()]
    part = np.repeat(np.array(table["part"].to_pylist(), np.int32), [len(x) for x in seq])
    seq = np.concatenate(seq)
    first_hash, second_hash = _row_hashes(around, h, left, right)
    order, starts, unit = _groups(first_hash, second_hash)
    of = order[starts]
    least = np.minimum.reduceat(doc[order], starts)
    h, left, right, around = h[of], left[of], right[of], around[of]
    to_right, right_prefix = suffix_array(h, around[:, GRAM:])
    to_left, left_prefix = suffix_array(h, around[:, REACH - 1::-1])
    masks = np.zeros(len(doc), np.uint32)
    for o in range(REACH + 1):
        ok = np.flatnonzero((o <= left) & (REACH - o <= right))
        if not len(ok):
            continue
        on_left = np.concatenate([[0], np.cumsum(left_prefix < o)])[to_left[ok]]
        on_right = np.concatenate([[0], np.cumsum(right_prefix < REACH - o)])[to_right[ok]]
        order, starts, run = _groups(on_left * (len(h) + 1) + on_right)
        owner = np.full(len(h), NO_ID)
        owner[ok] = np.minimum.reduceat(least[ok][order], starts)[run]
        masks |= (owner[unit] < doc).astype(np.uint32) << np.uint32(o)
    hit = np.flatnonzero(masks)
    order = hit[np.lexsort((seq[hit], part[hit]))]
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    pieces = [p for p in np.split(order, cuts) if len(p)]
    return pa.table({"part": pa.array([int(part[p[0]]) for p in pieces], pa.int32()),
                     "kind": pa.array(["masks"] * len(pieces), pa.string()),
                     "one": pa.array([_pack(seq[p]) for p in pieces], pa.binary()),
                     "two": pa.array([_pack(masks[p]) for p in pieces], pa.binary())})


# ---- the whole

_REPLY = "part int, kind string, one binary, two binary"


def _shared_of(replies: pa.Table) -> np.ndarray:
    blobs = [x for x, k in zip(replies["one"].to_pylist(), replies["kind"].to_pylist()) if k == "shared"]
    return np.concatenate([np.zeros(0, np.uint64), *(_unpack(x, np.uint64) for x in blobs)])


def remove_repeats(docs: DataFrame, *, keep_bytes: bool = True, part_bytes: int = PART_BYTES,
                   hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the remaining bytes).

    What remains need not be whole characters. Without ``keep_bytes`` ``kept`` is null.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, math.ceil(size / part_bytes))
    buckets = max(LEAST_PARTS, math.ceil(size * 2 / (REACH + 2) / GROUP_ANCHORS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                         F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("place"))

    def find_anchors(batches):
        yield from _anchor_blocks(batches, buckets, parts)

    def share(table: pa.Table) -> pa.Table:
        return _shared_anchors(table, hot_entries)

    blocks = tx.mapped(source.select("id", "text", "place"), find_anchors,
                       "bucket int, hashes binary, ids binary, places binary")
    shared = stored(blocks.groupBy("bucket").applyInArrow(share, _REPLY), "anchors")

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in tx.pieces(batches, "text", 4 * tx.PIECE):
            ids = batch.column("id")
            buf, offsets = tx.flat(batch.column("text"))
            data = buf.tobytes()
            packed = [packer.compress(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part_of(batch.column("place").to_numpy(zero_copy_only=False), parts), pa.int32()),
                 batch.column("doc_id"), ids, pa.array(packed, pa.binary())],
                names=["part", "doc_id", "id", "packed"])

    texts = tx.mapped(source, pack, f"part int, doc_id {kind}, id long, packed binary").groupBy("part")

    def surroundings(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return Part(left, _shared_of(right)).units(buckets, key[0].as_py())

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left, _shared_of(right))
        masks = np.zeros(len(part.h), np.uint32)
        for k, one, two in zip(*(right[c].to_pylist() for c in ("kind", "one", "two"))):
            if k == "masks":
                masks[_unpack(one, np.uint32)] = _unpack(two, np.uint32)
        n_bytes, removed, spans, rest = zip(*part.cut(masks)) if len(part.ids) else [[]] * 4
        return pa.table({
            "doc_id": part.texts["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()),
            "kept": pa.array(rest if keep_bytes else [None] * len(rest), pa.binary())})

    units = texts.cogroup(shared.groupBy("part")).applyInArrow(
        surroundings, "bucket int, part int, h binary, left binary, right binary, around binary, "
                      "doc binary, seq binary")
    masks = units.groupBy("bucket").applyInArrow(_masks, _REPLY)
    return texts.cogroup(shared.unionByName(masks).groupBy("part")).applyInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """What is removed from every document, and a digest of what remains."""
    return remove_repeats(docs, keep_bytes=False).drop("kept")
