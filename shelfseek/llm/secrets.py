"""Secret scan: fixed patterns, and strings that zstandard cannot explain from what surrounds them.

The patterns give the base spans. The novelty part looks at strings behind
words such as ``key`` or ``auth``: at every one that begins within ``REACH``. Such
a string is compressed with a dictionary of the code around it and of common
identifiers; the bytes that it adds tell how much of it is new. Copies of it in
that code are left out of the dictionary, as else a key that occurs twice would
explain itself. Strings that stay almost as long as they are, or as long as
random letters of their alphabet would, and mix letters with digits, are reported
as ``novel`` unless a base span covers any of them.

Spans are in code points, with exclusive end. Defined results. A null or
empty text has no spans. Repeated rows are scanned one by one. Empty tables
give no rows. Redaction replaces merged spans and leaves null texts null.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import math
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from shelfseek.llm import text as tx

# Fixed values.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?-i:([A-Za-z0-9+/_.=-]+))""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "novel"]

CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credential|bearer|private)",
                     re.IGNORECASE | re.ASCII)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: How far behind a context word a candidate may begin, and how much code around it is the dictionary.
REACH = 48
AROUND = 1024
NOVELTY = 0.8
#: Strings around a candidate that share so many characters with it, a digit among them, are copies.
COPY = 12
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % COPY)
#: Alphabets of keys by size, and the share of a candidate's characters that its alphabet has.
ALPHABETS = [frozenset(a) for a in (
    "0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")]
COVERED = 7 / 8

IDENTIFIERS = " ".join(sorted({*keyword.kwlist, *dir(builtins), *dir(str), *dir(dict), *CONTEXT_WORDS})).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind number and end of every base match."""
    folded = text.lower()
    spans = []
    if any(w in folded for w in ("password", "passwd", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def marginal_bytes(candidate: bytes, dictionary: bytes) -> int:
    """Compressed bytes that ``candidate`` adds to what the dictionary knows."""
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False,
                                      write_content_size=False, write_dict_id=False)
    return len(packer.compress(candidate)) - len(packer.compress(b""))


def entropy_bytes(value: str) -> float:
    """Bytes that random letters of the value's alphabet hold: the least one that has most of its characters."""
    counts = Counter(value)
    for alphabet in ALPHABETS:
        if sum(n for c, n in counts.items() if c in alphabet) >= COVERED * len(value):
            return len(value) * math.log2(len(alphabet)) / 8
    return len(value) * 6 / 8


def without_copies(around: str, value: str) -> str:
    """``around`` with the strings blanked that share ``COPY`` characters with ``value``."""
    parts = lambda s: (s[i:i + COPY] for i in range(len(s) - COPY + 1))
    near = {p for run in RUN.findall(around) for p in parts(run) if re.search("[0-9]", p)}
    shared = near and near.intersection(parts(value))
    return RUN.sub(lambda m: " " if any(p in shared for p in parts(m[0])) else m[0], around) if shared else around


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether neither the code around a string nor identifiers explain it."""
    value = text[start:end]
    if not (re.search("[A-Za-z]", value) and re.search("[0-9]", value)):
        return False
    dictionary = IDENTIFIERS + b"".join(without_copies(part, value).encode() for part in (
        text[max(0, start - AROUND):start], text[end:end + AROUND]))
    return marginal_bytes(value.encode(), dictionary) >= min(NOVELTY * len(value), entropy_bytes(value))


def novel_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Start, kind number and end of incompressible strings in sensitive context."""
    folded = text.lower()
    if not any(w in folded for w in CONTEXT_WORDS):
        return []
    found: dict[int, tuple[int, bool]] = {}
    for context in CONTEXT.finditer(text):
        at, last = context.end(), context.end() + REACH
        while at <= last and (candidate := CANDIDATE.search(text, at, min(len(text), last + 16))):
            start = candidate.start()
            if start not in found:
                end = CANDIDATE.match(text, start).end()
                free = not any(s < end and start < e for s, _, e in taken)
                found[start] = end, free and is_novel(text, start, end)
            at = found[start][0]
    return [(s, 3, e) for s, (e, novel) in sorted(found.items()) if novel]


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as start, kind number, end; in order."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base))


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact_text(text: str, spans, mask: str = "[SECRET]") -> str:
    """The text with every merged span replaced."""
    out, at, until = [], 0, -1
    for start, _, end in spans:
        if start >= until:
            out += [text[at:start], mask]
        until = max(until, end)
        at = until
    return "".join(out) + text[at:] if spans else text


def scan(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None,
         redacted: bool = False) -> DataFrame:
    """The ``carry`` columns (all by default) with counts per kind, ``base_sha256`` and ``spans``.

    With ``redacted`` a last column ``redacted`` holds the text without its secrets.
    """
    names = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"] + ["redacted"] * redacted
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    out = docs.select(*carry, F.col(text).alias("_text"))

    def find(batches):
        for batch in tx.pieces(batches, "_text", 4 * tx.PIECE):
            counts: list[list[int]] = [[], [], [], []]
            digests, lists, masked = [], [], []
            for value in batch.column("_text").to_pylist():
                spans = scan_text(value or "")
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in spans))
                base = listed([x for x in spans if x[1] < 3])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                lists.append(listed(spans))
                masked.append(None if value is None else redact_text(value, spans) if redacted else "")
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                       pa.array(lists, pa.string())] + [pa.array(masked, pa.string())] * redacted
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns],
                                             names=[*batch.schema.names[:-1], *names])

    schema = out.drop("_text").schema
    for name in names:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return tx.mapped(out, find, schema)


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""
    return scan(docs, carry=["doc_id"])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked; ``n_chars`` follows the text. Columns stay as they are."""
    cleaned = scan(docs.select("text", F.struct(*docs.columns).alias("_row")), carry=["_row"], redacted=True)
    changed = F.col("spans") != ""
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted")}
    return cleaned.select(*[
        F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"_row.`{c}`")).alias(c)
        if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
