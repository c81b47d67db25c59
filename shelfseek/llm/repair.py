"""Repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation is an optional system turn and then user and assistant
by turns, ``(s?(ua)+)?`` in initials, or nothing. Edits are Keep, Rerole, Delete
and Insert; an automaton of four states (nothing yet, after system, after user,
after assistant) says what may follow. A row is a 4 x 4 table of least costs
from state to state, and so is any stretch of rows.

Rows are laid out in order over the whole table and cut into pieces of bounded
size, wherever conversations begin. Forward vectors of costs over the first half
of a stretch and backward ones over the second meet in the middle; the crossing
that starts the audit-least of the cheapest audits is kept and both halves are
solved alone, in linear space. This is done first over the pieces of a
conversation, then in each piece over its rows, so that a conversation with a
third of all rows is spread over many tasks like any other.

Audits compare by prefixes: what leads to one row's end is never a prefix of
what leads to it by another way, so an order (rank) of the four ways to a row
is all that ties need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfseek.llm.text import mapped
from shelfseek.sources.tables import stored

#: Costs of edits; a truncated row that stays costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a piece.
PIECE_ROWS = 2048
#: Leading characters of a text that order rows of one turn and role; the digest orders the rest.
LEADING = 32

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: State after a turn of the given initial, where it may follow.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Initials to insert for an accepted end.
TAIL = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
ROLES = {"u": "user", "a": "assistant"}


# ---- tables of least cost

def _inserted(state: int) -> Iterator[tuple[str, int]]:
    """What may be inserted at a state, with the state reached; more would only go round."""
    yield "", state
    done = ""
    for _ in range(2):
        initial = "a" if state == USER else "u"
        done, state = done + initial, NEXT[state, initial]
        yield done, state


def step(initial: str, must_go: bool, truncated: bool) -> tuple[list[list[int]], list[list[int]], list[list]]:
    """Of one row: least costs from state to state, rank of the audits from each state, and the edits.

    Edits are (initials inserted before, edit, initial of the row or '').
    """
    best: list[list] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        for before, at in _inserted(start):
            ways = [(DELETE, "D", "", at)]
            if not must_go:
                for edit, cost, as_role in [("K", KEEP, initial), ("R", REROLE, "u"), ("R", REROLE, "a")]:
                    if (at, as_role) in NEXT:
                        ways.append((cost + TRUNCATED * truncated, edit, as_role, NEXT[at, as_role]))
            for cost, edit, role, end in ways:
                way = (cost + INSERT * len(before), "I" * len(before) + edit, before, role)
                if best[start][end] is None or way[:2] < best[start][end][:2]:
                    best[start][end] = way
    costs = [[FAR if w is None else w[0] for w in row] for row in best]
    ranks = []
    for row in best:
        order = sorted((w[1], s) for s, w in enumerate(row) if w is not None)
        rank = [4] * 4
        for k, (_, s) in enumerate(order):
            rank[s] = k
        ranks.append(rank)
    edits = [[None if w is None else (w[2], w[1][-1], w[3]) for w in row] for row in best]
    return costs, ranks, edits


STEPS = {(i, m, t): step(i, m, t) for i in ("s", "u", "a", "") for m in (False, True) for t in (False, True)}


def follow(vector: tuple[list[int], list[int]], costs, ranks) -> tuple[list[int], list[int]]:
    """The vector of least costs and audit ranks after one more table."""
    cost, rank = vector
    new, keys = [FAR] * 4, [(4, 4, 0)] * 4
    for end in range(4):
        least, key = FAR, (4, 4, end)
        for start in range(4):
            total = cost[start] + costs[start][end]
            if total < FAR and (total < least or (total == least and rank[start] < key[0])):
                least, key = total, (rank[start], ranks[start][end], end)
        new[end], keys[end] = least, key
    out = [0] * 4
    for k, key in enumerate(sorted(keys)):
        out[key[2]] = k
    return new, out


def alone(state: int) -> tuple[list[int], list[int]]:
    """The vector at a known state."""
    return [0 if s == state else FAR for s in range(4)], [0] * 4


def crossings(tables: list, start: int, end: int) -> list[int]:
    """The state after each table on the audit-least of the cheapest ways from ``start`` to ``end``.

    Halves are solved from a stack; besides the result only one vector for
    each direction is held.
    """
    states = [end] * len(tables)
    todo = [(0, len(tables), start, end)]
    while todo:
        low, high, first, last = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        forward = alone(first)
        for k in range(low, middle):
            forward = follow(forward, *tables[k][:2])
        backward = alone(last)[0]
        for k in range(high - 1, middle - 1, -1):
            backward = [min(tables[k][0][s][e] + backward[e] for e in range(4)) for s in range(4)]
        cross = min(range(4), key=lambda s: (forward[0][s] + backward[s], forward[1][s]))
        states[middle - 1] = cross
        todo += [(low, middle, first, cross), (middle, high, cross, last)]
    return states


def last_state(vector: tuple[list[int], list[int]]) -> int:
    """The state in which the audit-least of the cheapest whole audits leaves the last row."""
    return min(range(4), key=lambda s: (vector[0][s] + INSERT * len(TAIL[s]), vector[1][s]))


# ---- rows in order

ROW_KEYS = ("conv", "turn", "role", "leading", "digest")


def _prepared(rows: DataFrame) -> DataFrame:
    """``conv`` (never null), ``turn``, ``role``, ``text`` and what orders and judges a row."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.select(name.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                       text.alias("text")).select(
        "*", F.substring("text", 1, LEADING).alias("leading"), F.unhex(F.md5("text")).alias("digest"),
        F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"))


def _in_order(rows: DataFrame) -> DataFrame:
    """``rows`` numbered by partition ``part`` and ``place`` in the order of the whole table.

    The row's number in the scan parts equal rows, which are interchangeable.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "leading", "digest", "scan"]
    keyed = rows.drop("text").withColumn("scan", F.monotonically_increasing_id())
    laid = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return stored(mapped(laid.drop("scan"), _numbered, ORDERED), "turns")


ORDERED = ("conv string, turn long, role string, leading string, digest binary, initial string, blank boolean, "
           "cut boolean, part int, place long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in batches:
        yield batch.append_column("place", pa.array(range(done, done + batch.num_rows), pa.int64()))
        done += batch.num_rows


def _judged(ordered: DataFrame) -> DataFrame:
    """Narrow rows with their piece and their first fault: blank, duplicate or truncated.

    The first row of each role and text of a conversation is found by an
    aggregate; rows meet it by their own number, so no common text gathers rows.
    """
    firsts = (ordered.groupBy("conv", "role", "leading", "digest").agg(F.min(F.struct("part", "place")).alias("at"))
              .select("at.part", "at.place", F.lit(True).alias("first")))
    rows = ordered.join(firsts, ["part", "place"], "left")
    repeated = F.col("first").isNull()
    fault = F.when(F.col("blank"), "b").when(repeated, "d").when(F.col("cut"), "t").otherwise("")
    return rows.select("part", (F.col("place") / PIECE_ROWS).cast("int").alias("piece"), "place", "conv", "turn",
                       "initial", fault.alias("fault"))


def _by_piece(rows: DataFrame) -> DataFrame:
    return rows.repartition("part", "piece").sortWithinPartitions("part", "piece", "place")


def _stretches(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...],
               keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal values in the first ``keys`` columns, with those values."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held[0][:keys], held
                held = []
            held.append(row)
    if held:
        yield held[0][:keys], held


def _table(initial: str, fault: str):
    return STEPS[initial if initial in ("s", "u", "a") else "", fault in ("b", "d"), fault == "t"]


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _out(held, schema)
            held = []
    if held:
        yield _out(held, schema)


LEGAL = frozenset(("su", "ua", "au"))
PIECES = ("part int, piece int, conv string, costs array<long>, ranks array<int>, first_turn long, last_turn long, "
          "turns long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long")
_PIECES = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("conv", pa.string()), ("costs", pa.list_(pa.int64())),
                     ("ranks", pa.list_(pa.int32())), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                     ("turns", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
                     ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a piece: its table of costs and ranks, and counts."""
    def rows():
        names = ("part", "piece", "conv", "turn", "initial", "fault")
        for (part, piece, conv), held in _stretches(batches, names, 3):
            tables = [_table(row[4], row[5]) for row in held]
            costs, ranks = [], []
            for state in range(4):
                vector = alone(state)
                for table in tables:
                    vector = follow(vector, *table[:2])
                costs += vector[0]
                ranks += vector[1]
            turns = [row[3] for row in held if row[3] is not None]
            illegal = sum(a[4] + b[4] not in LEGAL for a, b in zip(held, held[1:]))
            yield (part, piece, conv, costs, ranks, turns[0] if turns else None, turns[-1] if turns else None,
                   len(set(turns)), held[0][4], held[-1][4],
                   *(sum(row[5] == f for row in held) for f in "bdt"), illegal)
    yield from _batched(rows(), _PIECES)


WAYS = ("conv string, part int, piece int, start int, finish int, whole boolean, gaps long, blank long, duplicate long, "
        "truncated long, illegal long, cost long, tail string")
_WAYS = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("start", pa.int32()),
                   ("finish", pa.int32()), ("whole", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()),
                   ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                   ("tail", pa.string())])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at which a conversation crosses its pieces, and one row of its counts."""
    def rows():
        names = ("conv", "part", "piece", *_PIECES.names[3:])
        for (conv,), held in _stretches(batches, names, 1):
            tables = [([row[3][4 * s:4 * s + 4] for s in range(4)], [row[4][4 * s:4 * s + 4] for s in range(4)])
                      for row in held]
            vector = alone(START)
            for table in tables:
                vector = follow(vector, *table)
            end = last_state(vector)
            start = START
            for row, state in zip(held, crossings(tables, START, end)):
                yield conv, row[1], row[2], start, state, False, *[None] * 7
                start = state
            turns = sum(row[7] for row in held)
            illegal = sum(row[13] for row in held)
            for a, b in zip(held, held[1:]):
                illegal += a[9] + b[8] not in LEGAL
            seen = [row for row in held if row[5] is not None]
            turns -= sum(a[6] == b[5] for a, b in zip(seen, seen[1:]))
            gaps = seen[-1][6] - seen[0][5] + 1 - turns if seen else 0
            yield (conv, None, None, None, end, True, gaps, *(sum(row[c] for row in held) for c in (10, 11, 12)),
                   illegal, vector[0][end] + INSERT * len(TAIL[end]), TAIL[end])
    yield from _batched(rows(), _WAYS)


EDITS = "conv string, part int, place long, before string, edit string, role_initial string"
_EDITS = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("before", pa.string()),
                    ("edit", pa.string()), ("role_initial", pa.string())])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edit of every row, each piece's part of a conversation solved between its two states."""
    def rows():
        names = ("part", "piece", "conv", "place", "initial", "fault", "start", "finish")
        for (part, _, conv), held in _stretches(batches, names, 3):
            tables = [_table(row[4], row[5]) for row in held]
            start = held[0][6]
            for row, table, state in zip(held, tables, crossings(tables, start, held[0][7])):
                yield conv, part, row[3], *table[2][start][state]
                start = state
    yield from _batched(rows(), _EDITS)


def solve(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ordered rows, the edit of each, and the counts and closing inserts of each conversation."""
    ordered = _in_order(_prepared(rows))
    judged = stored(_judged(ordered), "judged")
    pieces = mapped(_by_piece(judged), _summed, PIECES)
    ways = stored(mapped(pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece"), _crossed, WAYS), "ways")
    between = ways.filter("not whole").select("part", "piece", "conv", "start", "finish")
    edits = stored(mapped(_by_piece(judged.join(between, ["part", "piece", "conv"])), _edited, EDITS), "edits")
    return ordered, edits, ways.filter("whole").drop("part", "piece", "start", "finish", "whole")


# ---- results

def _lines(rows: DataFrame, ordered: DataFrame, edits: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: ``conv, part, place, sub, role, text, edit``.

    Of equal rows at most one stays, so texts come by the columns that order rows.
    """
    left = edits.filter("edit <> 'D'").join(ordered, ["conv", "part", "place"])
    texts = _prepared(rows).groupBy(*ROW_KEYS).agg(F.max("text").alias("text"))
    same = [left[c].eqNullSafe(texts[c]) if c == "turn" else left[c] == texts[c] for c in ROW_KEYS]
    as_role = F.when(left.edit == "K", left.role).when(left.role_initial == "u", "user").otherwise("assistant")
    kept = left.join(texts, same).select(
        left.conv, "part", "place", F.lit(9).alias("sub"), left.turn, as_role.alias("role"), "text", "edit")
    inserted = edits.filter("before <> ''").select("conv", "part", "place", F.col("before").alias("add")).unionByName(
        ends.filter("tail <> ''").select("conv", F.lit((1 << 31) - 1).alias("part"), F.lit(0).cast("long").alias("place"),
                                         F.col("tail").alias("add")))
    new = inserted.select("conv", "part", "place", F.posexplode(F.split("add", "(?!^)(?!$)")).alias("sub", "one")).select(
        "conv", "part", "place", "sub", F.lit(None).cast("long").alias("turn"),
        F.when(F.col("one") == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"),
        F.lit("I").alias("edit"))
    return kept.unionByName(new)


def _names(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.groupBy(name.alias("conv")).agg(F.first("conv_id").alias("conv_id"))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, part, place, sub, turn, role, text, edit``.

    ``rows`` has ``conv_id, turn, role, text``; other columns are not read.
    Turns of a conversation come in the order of ``part, place, sub``; ``edit`` is K, R or I
    (inserted turns have no ``turn`` and an empty text). Rows of one turn are
    ordered by role, the leading characters of the text, and its digest; null turns come
    first. A null role or text is one space, so such a text is blank. Rows
    without ``conv_id`` are one conversation; repeated rows are duplicates, and an empty table gives none.
    """
    ordered, edits, ends = solve(rows)
    return _lines(rows, ordered, edits, ends).join(_names(rows), "conv").drop("conv")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, fed line by line."""
    import hashlib

    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

    def rows():
        conv, digest = None, None
        for batch in batches:
            for name, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                line = f"{role}:{text}"
                if name != conv:
                    if digest is not None:
                        yield conv, digest.hexdigest()
                    conv, digest = name, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n")
                    digest.update(line.encode())
        if digest is not None:
            yield conv, digest.hexdigest()
    yield from _batched(rows(), schema)


def audited(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row for each ``conv_id`` of ``originals`` (or ``rows``): faults, cost, audit, digest of the repaired text.

    The audit is joined from the pieces; the digest is fed row by row, as it
    has to be, in the task of the conversation.
    """
    ordered, edits, ends = solve(rows)
    lines = _lines(rows, ordered, edits, ends)
    hashes = mapped(lines.select("conv", "part", "place", "sub", "role", "text").repartition("conv")
                    .sortWithinPartitions("conv", "part", "place", "sub"), _hashed, "conv string, repaired_sha256 string")
    letters = edits.select("conv", "part", (F.col("place") / PIECE_ROWS).cast("int").alias("piece"), "place", F.concat(
        F.repeat(F.lit("I"), F.length("before")), "edit").alias("a"))
    joined = letters.groupBy("conv", "part", "piece").agg(
        F.sort_array(F.collect_list(F.struct("place", "a"))).alias("l")).select(
        "conv", "part", "piece", F.array_join("l.a", "").alias("a"))
    audits = joined.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "a"))).alias("l")).select(
        "conv", F.array_join("l.a", "").alias("audit"))
    whole = _names(rows if originals is None else originals).join(ends, "conv", "left").join(
        audits, "conv", "left").join(hashes, "conv", "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        "conv_id", *counts,
        F.concat(F.coalesce("audit", F.lit("")), F.repeat(F.lit("I"), F.coalesce(F.length("tail"), F.lit(0)))).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b"").cast("binary"), 256)).alias("repaired_sha256"))


# ---- planted damage

def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by the CRC-32 of ``conv_id:turn`` (a null is one space)."""
    space = F.lit(" ")
    crc = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                           F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    plain = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                        F.coalesce("text", space).alias("text"), crc.cast("int").alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(
        F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def report(rows: DataFrame) -> DataFrame:
    """Faults, cheapest audit and digest of every conversation of ``rows`` after planted damage."""
    return audited(damage(rows), rows)
