"""Conversation repair against whole-string search, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shelfseek.llm import repair

DDL = "conv_id long, turn long, role string, text string, part int, place long, cut boolean, conv string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, True, "extra") for r in rows], DDL)


def relaxed(best):
    for _ in range(4):
        for state, (cost, audit, out) in list(best.items()):
            for initial, role in (("u", "user"), ("a", "assistant")):
                if (state, initial) in NEXT:
                    to, way = NEXT[state, initial], (cost + 2, audit + "I", out + [f"{role}:"])
                    if to not in best or way[:2] < best[to][:2]:
                        best[to] = way
    return best


def cheapest(rows):
    """Cost, audit and lines by a search that carries whole audits forward."""
    best = {0: (0, "", [])}
    for role, text, flaw in rows:
        new = {}
        for state, (cost, audit, out) in relaxed(dict(best)).items():
            ways = [(state, cost + 3, audit + "D", out)]
            if flaw not in ("b", "d"):
                more = flaw == "t"
                if (state, role[:1]) in NEXT:
                    ways.append((NEXT[state, role[:1]], cost + more, audit + "K", out + [f"{role}:{text}"]))
                for initial, other in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in NEXT:
                        ways.append((NEXT[state, initial], cost + 2 + more, audit + "R", out + [f"{other}:{text}"]))
            for to, *way in ways:
                if to not in new or tuple(way[:2]) < new[to][:2]:
                    new[to] = tuple(way)
        best = new
    return min((v for s, v in relaxed(best).items() if s in (0, 3)), key=lambda v: v[:2])


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, held in by.items():
        held.sort()
        seen, flawed = set(), []
        for _, _, role, text in held:
            body = text.strip(" \t\n\r\x0b\x0c")
            flaw = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            flawed.append((role, text, flaw))
        turns = [h[1] for h in held if h[0]]
        cost, audit, lines = cheapest(flawed)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(sum(f[2] == k for f in flawed) for k in "bdt"),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(flawed, flawed[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in df.collect()}


def some_rows(rng, conversations, most):
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", "u", None]
    texts = ["Yes.", "No!", "why", "", " \n", None, "So?", "a b.", "x"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3]) * 2 + 1, rng.choice(roles),
                         rng.choice([f"Line {turn}.", f"Line {turn}.", rng.choice(texts)])))
    seen = set()
    rows = [r for r in rows if not ((r[0], r[1]) in seen or seen.add((r[0], r[1])))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [2, 5, 2048])
def test_cheapest_audits(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = some_rows(random.Random(piece), 60, 14)
    assert got(repair.audited(frame(spark, rows))) == expected(rows)


def test_one_conversation_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 8)
    rng = random.Random(3)
    rows = [(r[0] // 100, r[1] + 100 * (r[0] % 100), r[2], r[3]) for r in some_rows(rng, 100, 10)]
    assert got(repair.audited(frame(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (None, 4, "user", "No id."), (1, None, "assistant", "late."),
            (1, 0, "user", "word " * 100_000), (2, 0, "user", "Copy."), (2, 0, "user", "Copy."), (3, 7, "", "!")]
    assert got(repair.audited(frame(spark, rows))) == expected(rows)
    assert repair.report(frame(spark, [])).collect() == [] and repair.repair(frame(spark, [])).collect() == []


def test_repaired_rows(spark):
    rows = [(5, 0, "system", "Be kind."), (5, 1, "user", "Hello."), (5, 2, "user", "Anyone?"), (5, 3, "user", "Hello.")]
    made = sorted(repair.repair(frame(spark, rows)).collect(), key=lambda r: (r.part, r.place, r.sub))
    assert [(r.edit, r.role, r.text, r.turn) for r in made] == [
        ("K", "system", "Be kind.", 0), ("K", "user", "Hello.", 1), ("R", "assistant", "Anyone?", 2)]


def test_report_damages_first(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    plain = [tuple(r) for r in rows.collect()] + [(10 ** 6, 13, "user", None), (None, None, None, "?")]
    damaged = []
    for conv, turn, role, text in plain:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault:
            text = "" if fault == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else text
            damaged += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    right = expected(damaged)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(repair.report(frame(spark, plain))) == {c: right.get(c, none) for c in {r[0] for r in plain}}
