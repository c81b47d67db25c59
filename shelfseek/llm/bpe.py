"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Text is cut by the usual pattern of byte-level vocabularies and each cut merged
by rank. Both steps read a text in windows and hold only what later text may
still change:

* A cut is final once three more characters are known; a run longer than
  ``OPEN_CHARS`` is not held but passed on while it is read.
* Merges inside a run reach to the left only by chains: a merge across the
  frontier of what is certain moves it left by the merge's left part, and the
  next one needs a later merge whose right part begins, in its own history,
  with that left part. The longest chain over the merge list is its sufficient
  lookahead: tokens that end further than that before the end of what was read
  are stable and emitted.

So memory does not grow with a text or a run. Decoding keeps the bytes of an
unfinished character alone.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from shelfseek.llm.text import flat, mapped

#: Characters read at once, and characters of a run from which it is passed on in parts.
WINDOW_CHARS = 1 << 16
OPEN_CHARS = 1 << 10
#: Characters behind a cut that can still change it: the longest suffix of the pattern is ``'re``.
UNSURE_CHARS = 3
#: Rank of pairs that do not merge.
NO_MERGE = 1 << 40
#: Cuts whose tokens are remembered by a worker, twice at most; longer ones are rare and left out.
REMEMBERED, REMEMBERED_CHARS = 1 << 17, 32

# Letters and numbers of the regex module that are too new for the tokenizers library,
# which takes them for other characters, as code points from and to.
TOO_NEW = (
    "0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD "
    "A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB "
    "11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")
_NEW = "".join("\\U{:0>8}-\\U{:0>8}".format(*r.split("-")) for r in TOO_NEW.split())
_CLASSES = (rf"[\p{{L}}--[{_NEW}]]", rf"[\p{{N}}--[{_NEW}]]", rf"[^\p{{White_Space}}[[\p{{L}}\p{{N}}]--[{_NEW}]]]")
SPACE = r"\p{White_Space}+"


def pattern(letter: str, number: str, other: str) -> regex.Pattern:
    """The pattern that byte-level vocabularies of this kind cut by, with the given classes."""
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+"
                         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+", regex.V1)


PATTERN = pattern(*_CLASSES)
# The letters, numbers and white space of Latin-1.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The same pattern for text in Latin-1, by the faster module.
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
                   rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
RUNS = [regex.compile(f"{c}+", regex.V1) for c in _CLASSES]


def cuts_of(data: str) -> list[str]:
    try:
        data.encode("latin-1")
    except UnicodeEncodeError:
        return PATTERN.findall(data)
    return LATIN.findall(data)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, others counted on from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Ids and merges of a tokenizer file; ``specials`` are strings that stand for one id wherever they occur."""

    def __init__(self, file: str):
        data = json.loads(file)
        model, cut = data["model"], data["pre_tokenizer"]
        plain = [t for t in data["added_tokens"] if not (t["single_word"] or t["lstrip"] or t["rstrip"])]
        if (model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]
                or data["normalizer"] or len(plain) < len(data["added_tokens"])
                or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                              "end_of_word_suffix", "byte_fallback", "ignore_merges"))):
            raise ValueError("only plain byte-level BPE files are read")
        ids = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in plain}
        self.first = [ids[c] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((ids[a], ids[b]), rank)
        self.made = [ids[a + b] for a, b in pairs]
        self.bytes_of = {}
        for token, number in chain(ids.items(), self.specials.items()):
            known = all(c in byte_of for c in token)
            self.bytes_of[number] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes before the end of a known text within which later text may move token boundaries.

        Merges are taken by rank. ``reach[t]`` is the longest chain so far whose
        last merge had ``t`` as left part, which stays a token beginning at the
        frontier; ``starts[t]`` are the tokens that ``t`` began with while it grew.
        """
        starts: dict[int, set[int]] = {t: {t} for t in self.first}
        reach: dict[int, int] = {}
        for (a, b), rank in sorted(self.ranks.items(), key=lambda m: m[1]):
            both = self.made[rank]
            before = max((reach.get(t, 0) for t in starts.get(b, {b})), default=0)
            starts.setdefault(both, {both}).update(starts.get(a, {a}))
            reach[a] = max(reach.get(a, 0), before + len(self.bytes_of[a]))
        return max(reach.values(), default=0)

    def merged(self, text: bytes) -> list[int]:
        """The tokens of one cut: the merge of least rank first, the leftmost of equal ones."""
        ids = [self.first[b] for b in text]
        return self._few(ids) if len(ids) < 40 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NO_MERGE:
            at = ranks.index(least)
            both = made[least]
            ids[at:at + 2] = [both]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], both), NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank_of((both, ids[at + 1]), NO_MERGE)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        ranks, made, n = self.ranks, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, ids[k], ids[k + 1]) for k in range(n - 1)
                if (rank := ranks.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue
            both = made[rank]
            ids[k], ids[right], after[k] = both, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (rank := ranks.get((both, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (rank, k, both, ids[after[k]]))
            left = before[k]
            if left >= 0 and (rank := ranks.get((ids[left], both))) is not None:
                heapq.heappush(heap, (rank, left, ids[left], both))
        return [t for t in ids if t >= 0]


class Run:
    """Merges of one cut that is read in parts; holds a bounded number of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""
        self.block = 4 * vocabulary.lookahead + 4096

    def push(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.block):
            self.held += data[start:start + self.block]
            if len(self.held) >= self.block:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        done, limit = 0, len(self.held) - self.vocabulary.lookahead
        for token in self.vocabulary.merged(self.held):
            end = done + len(self.vocabulary.bytes_of[token])
            if end > limit:
                break
            yield token
            done = end
        self.held = self.held[done:]

    def finish(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.vocabulary.merged(rest)


class Known(dict):
    """Tokens of cuts that were seen before. What was not seen since the last time it was full is forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, cut: str) -> tuple[int, ...]:
        tokens = self.older.get(cut) or tuple(self.vocabulary.merged(cut.encode()))
        if len(cut) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[cut] = tokens
        return tokens


class Encoder:
    """Tokens of a text fed in parts; what is emitted is final. One instance may serve many texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.space = regex.compile(SPACE)
        names = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.starts = {s[:k] for s in names for k in range(1, len(s))}
        self.longest = max(map(len, names), default=1)
        self.known = Known(vocabulary)
        self._reset()

    def _reset(self) -> None:
        self.held, self.run, self.of = "", None, None

    def feed(self, text: str, last: bool = False) -> array:
        """Tokens that are certain once ``text`` has been read; all the rest if it is the ``last`` part."""
        out, data = array("i"), self.held + text
        self.held = ""
        done = 0
        if self.special:
            for found in self.special.finditer(data):
                self._segment(data[done:found.start()], True, out)
                out.append(self.vocabulary.specials[found.group()])
                done = found.end()
        data = data[done:]
        kept = 0 if last else next((k for k in range(min(self.longest, len(data)), 0, -1)
                                    if data[-k:] in self.starts), 0)
        self._segment(data[:len(data) - kept], last, out)
        self.held += data[len(data) - kept:]
        if last:
            self._reset()
        return out

    def encode(self, text: str) -> array:
        """All tokens of a text, read in windows."""
        out = array("i")
        for start in range(0, len(text) - WINDOW_CHARS, WINDOW_CHARS):
            out.extend(self.feed(text[start:start + WINDOW_CHARS]))
        rest = max(0, (len(text) - 1) // WINDOW_CHARS) * WINDOW_CHARS
        out.extend(self.feed(text[rest:], True))
        return out

    def _segment(self, data: str, last: bool, out: array) -> None:
        """Cuts of text between special strings; ``last`` if it ends here."""
        if self.run:
            data = self._go_on(data, last, out)
            if self.run:
                return
        cuts = cuts_of(data)
        held = 0
        if not last:
            while cuts and held < UNSURE_CHARS:
                held += len(cuts[-1])
                first = cuts.pop()
        out.extend(chain.from_iterable(map(self.known.__getitem__, cuts)))
        if not held:
            return
        self.held = data[len(data) - held:]
        if len(first) >= OPEN_CHARS and len(first) == held:
            self.run = Run(self.vocabulary)
            self.of = next((c for c in RUNS if c.fullmatch(first[-1])), self.space)
            self._pass_on(first, out)

    def _pass_on(self, data: str, out: array) -> None:
        """Part of a run; the last of white space may belong to what follows and is held."""
        self.held = data[-1:] if self.of is self.space else ""
        out.extend(self.run.push(data[:len(data) - len(self.held)].encode()))

    def _go_on(self, data: str, last: bool, out: array) -> str:
        """Read on in an open run; returns what lies behind it."""
        found = self.of.match(data)
        end = found.end() if found else 0
        if end == len(data) and not last:
            if data:
                self._pass_on(data, out)
            return ""
        if self.of is self.space and end < len(data):
            end -= 1
        out.extend(self.run.push(data[:end].encode()))
        out.extend(self.run.finish())
        self.run = self.of = None
        return data[end:]


class Decoder:
    """Text of tokens fed in parts: an incremental machine from bytes to characters.

    Bytes that are no UTF-8 become U+FFFD, one for each longest start of a
    character; ids that the vocabulary lacks are passed over.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.unknown = max(vocabulary.bytes_of) + 1
        self.tokens = pa.array([vocabulary.bytes_of.get(t, b"") for t in range(self.unknown + 1)], pa.binary())
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        ids = np.asarray(ids, np.int64)
        ids = np.where((ids < 0) | (ids > self.unknown), self.unknown, ids)
        text = self.machine.decode(flat(self.tokens.take(pa.array(ids)))[0].tobytes(), last)
        if last:
            self.machine.reset()
        return text

    def decode(self, ids: np.ndarray) -> str:
        """The text of all tokens, fed in windows."""
        parts = [self.feed(ids[k:k + WINDOW_CHARS]) for k in range(0, len(ids), WINDOW_CHARS)]
        return "".join(parts) + self.feed((), True)


_loaded: dict[str, tuple[Encoder, Decoder]] = {}


def _machines(file: Broadcast) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a broadcast file, made once by each worker, so that later tasks know its cuts."""
    if file.value not in _loaded:
        vocabulary = Vocabulary(file.value)
        _loaded[file.value] = Encoder(vocabulary), Decoder(vocabulary)
    return _loaded[file.value]


def read_file(df: DataFrame, path: str) -> Broadcast:
    """A tokenizer file of the driver, sent to the workers; it does not grow with the data."""
    with open(path, encoding="utf-8") as handle:
        return df.sparkSession.sparkContext.broadcast(handle.read())


def _with(df: DataFrame, name: str, kind, function) -> DataFrame:
    """``df`` with column ``name`` made by ``function`` from batches; an older column of that name is replaced."""
    fields = [f for f in df.schema if f.name != name]
    return mapped(df, function, StructType([*fields, StructField(name, kind)]))


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return batch.select(keep).append_column(name, values)


def encoded(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the tokens of whole texts as array column ``ids``.

    Null and empty texts have no tokens; rows are independent, so that ids,
    repeated rows and other columns do not matter. A column already called as the
    result is replaced. Special strings in a text become their own token.
    """
    file = read_file(df, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _machines(file)[0]
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            values, ends = array("i"), [0]
            for value in texts:
                raw = value.as_py()
                if raw:
                    values.extend(encoder.encode(raw.decode("utf-8", "replace")))
                ends.append(len(values))
            yield _replaced(batch, ids, pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32())))

    return _with(df, ids, ArrayType(IntegerType()), encode)


def decoded(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the tokens in array column ``ids`` as column ``text``; null and empty arrays give ''."""
    file = read_file(df, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _machines(file)[1]
        for batch in batches:
            rows = (decoder.decode(row.values.to_numpy() if row.is_valid else ()) for row in batch.column(ids))
            yield _replaced(batch, text, pa.array(rows, pa.string()))

    return _with(df, text, StringType(), decode)


def report(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, tokens encoded and decoded again."""
    rows = decoded(encoded(docs.select("doc_id", "text"), path).drop("text"), path)
    listed = F.array_join(F.transform("ids", lambda t: t.cast("string")), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
