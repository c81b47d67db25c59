"""Surrogates against a plain search for entities, and on texts that patterns could choke on."""

import random
import string
import time

import regex

from shelfseek.llm import pii

PLAIN = regex.compile(pii.PATTERN)
PARTS = ["Mr McDonald", "Mrs Smith-Jones", "Dr. O'Brien", "Ms. J. Keller", "Herr Müller", "Госпожа Иванова", "plain words",
         "anna@Example.com", "bob.x+1@mail.example.org", "4111 1111 1111 1111", "3782 822463 10005", "+44 20 7946 0958",
         "+14155550123", "555-010-4477", "(415) 555 0199", "123-45-6789", "10.1.2.3", "2001:db8:1:2:3:4:5:6", "x@",
         "DE89 3704 0044 0532 0130 00", "a1b2", "17:30", "Keller's", "Mister Nobody", "@here", "3.14"]


def test_what_a_plain_search_finds_is_replaced_and_nothing_else(docs_of):
    rng = random.Random(8)
    raw = [" | ".join(rng.choices(PARTS, k=rng.randint(1, 9))) for _ in range(120)]
    made = {r.doc_id: r for r in pii.with_surrogates(docs_of(raw)).collect()}
    units, seen = {}, {}
    for i, text in enumerate(raw):
        assert made[i].n_entities == len(PLAIN.findall(text))
        new_parts = made[i].text.split(" | ")
        assert len(new_parts) == text.count(" | ") + 1
        for part, new in zip(text.split(" | "), new_parts):
            found = PLAIN.search(part)
            if not found:
                assert new == part
                continue
            end = len(part) - found.end()
            assert new[:found.start()] == part[:found.start()] and new[len(new) - end:] == part[len(part) - end:]
            entity, new = found.group(), new[found.start():len(new) - end]
            assert entity.lower() != new.lower()
            assert units.setdefault(entity, new) == new and seen.setdefault(new, entity) == entity
            if any(c.isdigit() for c in entity) and "@" not in entity and entity.count(".") != 3:
                assert regex.sub(r"\w", "w", entity) == regex.sub(r"\w", "w", new), "format stays"
    assert len(units) > 15 and units["Mr McDonald"].startswith("Mr ")
    assert regex.fullmatch(r"Ms\. \p{Lu}\. \p{Lu}\p{Ll}+", units["Ms. J. Keller"])


def test_reported_leaks(docs_of):
    raw = ["Mr McDonald met nobody.", "Dr. O'Brien", "+44 20 7946 0958", "+14155550123", "2001:db8:1:2:3:4:5:6",
           "3782 822463 10005", "4111111111111111foo@x.de", "Mr J. R. R. Tolkien"]
    made = {r.doc_id: r.text for r in pii.with_surrogates(docs_of(raw)).collect()}
    for i, bits in enumerate(["Donald Mc", "Brien O'", "7946 0958", "5550123", "2001 db8", "822463 10005", "foo 4111", "Tolkien R."]):
        assert not any(b in made[i] for b in bits.split()), made[i]


def test_long_runs_take_seconds(docs_of):
    raw = ["a" * 1_000_000, "a@" + "b." * 20_000 + "com", "a" * 100_000 + "@x.de", "1" * 300_000, "a." * 200_000 + "@"]
    start = time.time()
    made = {r.doc_id: r for r in pii.with_surrogates(docs_of(raw)).collect()}
    assert time.time() - start < 60
    assert [made[i].n_entities for i in range(5)] == [0, 1, 1, 0, 0]
    assert [len(made[i].text) for i in range(5)] == [len(t) for t in raw]


def test_all_short_addresses_get_surrogates(docs_of):
    raw = [f"{a}@{b}.de" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    made = [r.text for r in pii.with_surrogates(docs_of(raw)).collect()]
    assert len(set(made)) == len(raw) and not set(made) & set(raw)
    assert all(regex.fullmatch(r"[a-z]+@[a-z]\.de", m) for m in made)


def test_columns_of_any_name_stay(spark):
    names = ["row", "t", "found", "later", "hash", "e", "k", "_found", "_later", "_hash", "kind", "norm"]
    rows = [(1, "Mr Smith", *["x"] * len(names)), (2, None, *["x"] * len(names))]
    docs = spark.createDataFrame(rows, "id long, text string, " + ", ".join(f"{n} string" for n in names))
    for r in pii.with_surrogates(docs).collect():
        assert all(r[n] == "x" for n in names) and (r.text is None) == (r.id == 2)
