"""Text functions as column expressions: folding, normalising, terms, trigrams."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

# Characters a raw query may keep, shortest token, and the
# trigram thresholds by query length.
QUERY_JUNK = r"[^\p{IsAlphabetic}\p{IsDigit}\s\-']"
MIN_TOKEN_CHARS = 2
TRIGRAM_SHORT_CHARS, TRIGRAM_SHORT = 3, 0.55
TRIGRAM_MEDIUM_CHARS, TRIGRAM_MEDIUM = 6, 0.4
TRIGRAM_LONG = 0.3

# Letters that do not decompose but fold to a base letter or two.
FOLD_ONE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H",
            "ı": "i", "ł": "l", "Ł": "L", "ŧ": "t", "Ŧ": "T", "ĸ": "q"}
FOLD_TWO = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}

HANGUL = range(0xAC00, 0xD7A4)
WORD = r"[\p{L}\p{N}]+"
HYPHENATED_WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"

QUERY_GROUPS = ("array<struct<required:array<string>,excluded:array<string>,phrases:array<array<string>>,"
                "barred:array<array<string>>>>")


@functools.cache
def _decomposed() -> tuple[str, str]:
    """All characters whose canonical decomposition is one base character plus marks."""
    sources, targets = [], []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or code in HANGUL:
            continue
        char = chr(code)
        if unicodedata.category(char)[0] == "M":
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char)
                       if unicodedata.category(c)[0] != "M")
        if base != char and len(base) == 1:
            sources.append(char)
            targets.append(base)
    return "".join(sources), "".join(targets)


def strip_marks(text: Column) -> Column:
    """Drop diacritics. Composed Hangul stays composed, as it is in the catalogue."""
    sources, targets = _decomposed()
    return F.regexp_replace(F.translate(text, sources, targets), r"\p{M}+", "")


def fold(text: Column) -> Column:
    """``strip_marks`` plus letters that fold without decomposing (ø, ß, æ). ASCII texts are left as they are."""
    sources, targets = _decomposed()
    sources += "".join(FOLD_ONE)
    targets += "".join(FOLD_ONE.values())
    folded = F.regexp_replace(F.translate(text, sources, targets), r"\p{M}+", "")

    def spelled(folded):
        out = folded
        for char, pair in FOLD_TWO.items():
            out = F.replace(out, F.lit(char), F.lit(pair))
        return F.when(folded.rlike("[" + "".join(FOLD_TWO) + "]"), out).otherwise(folded)

    # A one-element transform names a value that is used several times.
    once = F.transform(F.array(folded), spelled)[0]
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(once)


def normalize_query(raw: Column) -> Column:
    """Clean a raw query: junk to spaces, marks dropped, spaces collapsed, lower case.

    Junk goes first, so an accent typed as a separate mark becomes a space.
    """
    cleaned = F.regexp_replace(F.coalesce(raw, F.lit("")), QUERY_JUNK, " ")
    return F.lower(F.trim(F.regexp_replace(strip_marks(cleaned), r"\s+", " ")))


def query_tokens(normalized: Column) -> Column:
    long_enough = F.filter(F.split(normalized, " "), lambda t: F.length(t) >= MIN_TOKEN_CHARS)
    bare = F.transform(long_enough, lambda t: F.replace(t, F.lit("'"), F.lit("")))
    return F.filter(bare, lambda t: F.trim(t) != "")


def prefix_query_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit(":*"))), " & ")


def phrase_query_text(tokens: Column) -> Column:
    return F.array_join(tokens, " <-> ")


def clean_filter(value: Column) -> Column:
    """A filter value trimmed of control and space characters; blank means not set."""
    trimmed = F.lower(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.when(~trimmed.rlike(r"^\s*$"), trimmed)


def lexemes(text: Column) -> Column:
    """Words of letters and digits in order; a hyphenated word gives itself, then its parts."""
    words = F.regexp_extract_all(F.lower(fold(text)), F.lit(HYPHENATED_WORD), F.lit(0))
    return F.when(F.instr(text, "-") == 0, words).otherwise(F.flatten(F.transform(words, lambda w: F.when(
        F.instr(w, "-") > 0, F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w)))))


def with_query_groups(df: DataFrame, normalized: str = "normalized") -> DataFrame:
    """Adds ``groups``: web-style query text as OR groups of required and excluded terms.

    Words are ANDed, ``or`` between two operands separates groups, a leading
    ``-`` negates. A hyphenated word stands for the compound only. A word of several terms,
    as an apostrophe makes it, asks for its terms side by side, as a document has them: its terms are required and it is
    one of the group's ``phrases``, or one that is ``barred``.
    """
    none, no_lists = "cast(array() as array<string>)", "cast(array() as array<array<string>>)"
    state = ("named_struct('groups', {}, 'required', {}, 'excluded', {}, 'phrases', {}, 'barred', {}, 'negated', {}, "
             "'expecting', {})")
    closed = ("if(size(s.required) + size(s.excluded) + size(s.barred) > 0, concat(s.groups, array(named_struct("
              "'required', s.required, 'excluded', s.excluded, 'phrases', s.phrases, 'barred', s.barred))), s.groups)")
    negated, single = "(s.negated <> (x.dashes % 2 = 1))", "(size(x.found) < 2)"
    operand = state.format(
        "s.groups",
        f"if({negated}, s.required, array_union(s.required, x.terms))",
        f"if({negated} and {single}, array_union(s.excluded, x.terms), s.excluded)",
        f"if({negated} or {single}, s.phrases, array_union(s.phrases, array(x.terms)))",
        f"if(not {negated} or {single}, s.barred, array_union(s.barred, array(x.terms)))",
        f"{negated} and size(x.terms) = 0", "size(x.terms) = 0 and s.expecting")
    separator = state.format(closed, none, none, no_lists, no_lists, "false", "true")
    start = state.format(f"cast(array() as {QUERY_GROUPS})", none, none, no_lists, no_lists, "false", "true")
    found = f"regexp_extract_all(t, r'{HYPHENATED_WORD}', 0)"
    beside = "flatten(transform(found, w -> if(instr(w, '-') > 0, concat(array(w), split(w, '-')), array(w))))"
    operands = f"""transform(filter(split(_folded, ' '), t -> t <> ''), (t, i) -> transform(array({found}),
        found -> named_struct('word', t, 'i', i, 'found', found, 'terms', if(size(found) > 1, {beside}, found),
        'dashes', length(regexp_extract(t, '^(-*)', 1))))[0])"""
    groups = f"""aggregate(_operands, {start}, (s, x) -> if(
        x.word = 'or' and not s.expecting and x.i < size(_operands) - 1, {separator}, {operand}),
        s -> {closed})"""
    return (df.withColumn("_folded", F.lower(fold(F.col(normalized))))
            .withColumn("_operands", F.expr(operands))
            .withColumn("groups", F.expr(groups)).drop("_folded", "_operands"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased words, each padded by two blanks and one."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))

    def grams(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1),
                           lambda i: padded.substr(i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts; 0 when neither has any."""
    left, right = trigrams(a), trigrams(b)
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / union)


def trigram_threshold(normalized: Column) -> Column:
    size = F.length(normalized)
    return (F.when(size <= TRIGRAM_SHORT_CHARS, TRIGRAM_SHORT)
            .when(size <= TRIGRAM_MEDIUM_CHARS, TRIGRAM_MEDIUM).otherwise(TRIGRAM_LONG))


def title_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
