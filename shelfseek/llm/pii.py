"""Surrogates for personal data, with built-in SQL functions only.

Entities are e-mail addresses, payment card, phone and social security
numbers, IP addresses, account numbers and names behind a title. Each is made
of units: a name of its words, any other entity of itself. A unit's surrogate is
derived from a secret key, its kind and its normal form, so the same unit gets
the same surrogate in every document and in every spelling. Surrogates keep
format, punctuation and case; numbers keep their check digit valid; name words
keep their script, and given names the gender of the title.

All distinct units of the corpus are checked: where two of a kind would share a
surrogate, or a surrogate is a unit of the corpus, all but the first are derived
again with the next attempt number until none collides. Only units with an
attempt above 0 are joined to the documents.

Defined results. A null text stays null, an empty one empty. Repeated rows get
equal results. Null ids are allowed. Empty tables give no rows. Columns other
than ``text``, and ``n_chars`` where it exists, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfseek.sources.tables import stored

# Fixed values.
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Signora|Госпожа|Κυρία"
TITLES_M = "Mr|Herr|Señor|Monsieur|Signor|Господин|Κύριος"
TITLES_X = "Dr|Prof|Professor"
#: Vowels and consonants of each script in which names are made up.
ALPHABETS = {"latin": ("aeiou", "bcdfghjklmnprstvwz"), "cyrillic": ("аеиоу", "бвгдзклмнпрст"),
             "greek": ("αειου", "βγδκλμνπρστ")}
#: Last letters of given names, of women and of men.
ENDINGS = {"latin": ("a", "o"), "cyrillic": ("а", "н"), "greek": ("α", "ν")}

#: A capital and more letters; inside, an apostrophe or hyphen stands before a capital.
_WORD = r"\p{Lu}(?:(?:['’-](?=\p{Lu}))?\p{L}){1,40}"
#: A run of address characters is entered at its start, or where the last entity ended, and read once.
_RUN = r"(?:(?<![\p{L}\p{N}._+-])|\G)"
PATTERNS = {
    "email": _RUN + r"[\p{L}\p{N}._+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}",
    "card": (r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})"
             r"(?![0-9])"),
    "phone": (r"(?:(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
              r"|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9]))"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}})(?:{TITLES_F}|{TITLES_M}|{TITLES_X})\.? (?:\p{{Lu}}\. ){{0,3}}{_WORD}(?: {_WORD}){{0,2}}",
}
PATTERN = "|".join(PATTERNS.values())
#: What every text with an entity has.
HINT = rf"[0-9]|@|(?:{TITLES_F}|{TITLES_M}|{TITLES_X})\.? \p{{Lu}}"
MAX_ATTEMPTS = 200


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def kind_sql(e: str) -> str:
    """The kind of a detected entity."""
    cases = " ".join(f"WHEN {e} RLIKE {_quoted('^(?:' + p + ')$')} THEN '{k}'" for k, p in PATTERNS.items())
    return f"CASE {cases} END"


def units_sql(e: str, kind: str) -> str:
    """The units of an entity: an array of structs of kind and normal form."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    title = f"substring_index({e}, ' ', 1)"
    gender = (f"CASE WHEN {title} RLIKE {_quoted(f'^(?:{TITLES_F})')} THEN 'f' "
              f"WHEN {title} RLIKE {_quoted(f'^(?:{TITLES_M})')} THEN 'm' ELSE 'x' END")
    words = f"filter(slice(split({e}, ' '), 2, 6), w -> right(w, 1) <> '.')"
    # An array, for the words of a name; its last word is the family name.
    names = (f"transform({words}, (w, i) -> named_struct('kind', IF(i = size({words}) - 1, 'family', "
             f"concat('given_', {gender})), 'norm', lower(w)))")
    norm = (f"CASE {kind} WHEN 'phone' THEN right({digits}, 10) WHEN 'card' THEN {digits} "
            f"WHEN 'ssn' THEN {digits} WHEN 'account' THEN replace({e}, ' ', '') ELSE lower({e}) END")
    return f"IF({kind} = 'name', {names}, array(named_struct('kind', {kind}, 'norm', {norm})))"


def _letters(text: str) -> str:
    """The characters of a text as an array, so that long ones are read once."""
    return f"regexp_extract_all({text}, '(?s).', 0)"


def _luhn_sum(digits: str, odd: int) -> str:
    """Sum of digits by the Luhn rule; every other digit from the right, from place ``odd``, is doubled."""
    value = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
    return (f"aggregate(transform(sequence(0, length({digits}) - 1), i -> "
            f"IF(i % 2 = {odd}, {value} * 2 - IF({value} > 4, 9, 0), {value})), 0, (a, b) -> a + b)")


def surrogate_sql(kind: str, norm: str, attempt: str, key: str) -> str:
    """The surrogate of a unit, in its normal form."""
    seed = lambda n: f"sha2(concat_ws(chr(1), {_quoted(key)}, '{n}', {kind}, {norm}, {attempt}), 256)"
    stream = f"concat({seed(0)}, {seed(1)})"
    byte = lambda i: f"CAST(conv(substr(s, 2 * (({i}) % 64) + 1, 2), 16, 10) AS INT)"
    pick = lambda letters, i: f"substr('{letters}', {byte(i)} % {len(letters)} + 1, 1)"
    each = lambda body, size=f"length({norm})": f"array_join(transform(sequence(0, {size} - 1), i -> {body}), '')"
    digit = f"CAST({byte('i')} % 10 AS STRING)"
    char = "n[i]"
    plain = (f"CASE WHEN {char} RLIKE '[0-9]' THEN {digit} WHEN {char} RLIKE '[A-Z]' THEN "
             f"upper({pick('abcdefghijklmnopqrstuvwxyz', 'i')}) WHEN {char} RLIKE '\\\\p{{L}}' THEN "
             f"{pick('abcdefghijklmnopqrstuvwxyz', 'i')} ELSE {char} END")
    tail = f"length(substring_index({norm}, '.', -1))"
    # Later attempts grow, as those of names do, so that there always are free ones.
    more = (f"array_join(transform(filter(sequence(0, CAST({attempt} / 8 AS INT)), i -> i > 0), i -> "
            f"{pick('abcdefghijklmnopqrstuvwxyz', 'i + 40')}), '')")
    kept = f"(length({norm}) - {tail})"
    email = _let("z", kept, f"concat({more}, {each(f'IF(i >= z, {char}, {plain})')})")
    hexed = each(f"IF({char} = ':', ':', substr('0123456789abcdef', {byte('i')} % 16 + 1, 1))")
    number = each(digit)
    phone = each(f"IF(length({norm}) = 10 AND i IN (0, 3), CAST({byte('i')} % 8 + 2 AS STRING), {digit})")
    body = f"concat(left({norm}, 1), substr({each(digit)}, 2, length({norm}) - 2))"
    card = _let("c", body, (
        f"concat(c, CAST(IF({_luhn_sum(norm, 1)} % 10 = 0, (10 - {_luhn_sum('c', 0)} % 10) % 10, "
        f"{byte(63)} % 10) AS STRING))"))
    ip = f"concat_ws('.', {byte(0)} % 223 + 1, {byte(1)}, {byte(2)}, {byte(3)})"
    account = f"concat(left({norm}, 2), substr({each(plain)}, 3))"

    def word(script):
        vowels, consonants = ALPHABETS[script]
        woman, man = ENDINGS[script]
        size = f"greatest(4, least(8, length({norm})))"
        letters = each(f"IF(i % 2 = 0, {pick(consonants, 'i')}, {pick(vowels, 'i')})", f"({size} - 1)")
        last = (f"CASE {kind} WHEN 'given_f' THEN '{woman}' WHEN 'given_m' THEN '{man}' "
                f"ELSE {pick(consonants, '62')} END")
        # Later attempts grow, so that there always are free ones.
        return f"concat({letters}, repeat({pick(vowels, '61')}, CAST({attempt} / 8 AS INT)), {last})"

    name = (f"CASE WHEN {norm} RLIKE '\\\\p{{IsCyrillic}}' THEN {word('cyrillic')} "
            f"WHEN {norm} RLIKE '\\\\p{{IsGreek}}' THEN {word('greek')} ELSE {word('latin')} END")
    return _let("s", stream, _let("n", _letters(norm), (
        f"CASE {kind} WHEN 'email' THEN {email} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} "
        f"WHEN 'ssn' THEN {number} WHEN 'ip' THEN {ip} WHEN 'ip6' THEN {hexed} WHEN 'account' THEN {account} "
        f"ELSE {name} END")))


def render_sql(e: str, kind: str, made: str) -> str:
    """An entity's surrogate in the entity's own format; ``made`` is the array of its units' surrogates."""
    char = f"substr({e}, i + 1, 1)"
    rank = f"length(regexp_replace(substr({e}, i + 1), '[^0-9]', ''))"
    filled = (f"array_join(transform(sequence(0, length({e}) - 1), i -> IF({char} RLIKE '[0-9]' AND "
              f"{rank} <= length({made}[0]), substr({made}[0], length({made}[0]) - {rank} + 1, 1), {char})), '')")
    # A grown surrogate is longer than its entity; what it has more comes first.
    longer = f"(length({made}[0]) - length({e}))"
    cased = _let("d", longer, _let("a", _letters(e), _let("b", _letters(f"{made}[0]"), (
        "array_join(transform(b, (x, i) -> IF(i >= d AND a[i - d] = upper(a[i - d]), upper(x), x)), '')"))))
    hexed = f"IF({e} = upper({e}), upper({made}[0]), {made}[0])"
    placed = f"length(replace(substr({e}, 1, i + 1), ' ', ''))"
    spaced = (f"array_join(transform(sequence(0, length({e}) - 1), i -> IF({char} = ' ', ' ', "
              f"substr({made}[0], {placed}, 1))), '')")
    # Initials follow the family name, so that they say nothing about the person.
    initials = f"filter(slice(split({e}, ' '), 2, 3), w -> right(w, 1) = '.')"
    family = f"element_at({made}, -1)"
    named = (f"array_join(concat(array(substring_index({e}, ' ', 1)), transform({initials}, (w, i) -> "
             f"concat(upper(substr({family}, i + 1, 1)), '.')), transform({made}, w -> initcap(w))), ' ')")
    return (f"CASE {kind} WHEN 'name' THEN {named} WHEN 'email' THEN {cased} WHEN 'ip' THEN {made}[0] "
            f"WHEN 'ip6' THEN {hexed} "
            f"WHEN 'account' THEN {spaced} ELSE {filled} END")


def entities(text: Column) -> Column:
    """All entities of a text, in order: an array, empty for a null text."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def units(docs: DataFrame) -> DataFrame:
    """Distinct ``kind`` and ``norm`` of all units."""
    found = docs.select(F.explode(entities(F.col("text"))).alias("e")).withColumn("k", F.expr(kind_sql("e")))
    found = found.groupBy("e", "k").agg(F.lit(1).alias("_"))
    return found.select(F.inline(F.expr(units_sql("e", "k")))).distinct()


def later_attempts(found: DataFrame, key: str) -> DataFrame:
    """``kind``, ``norm`` and ``attempt`` of the units whose first surrogates collide.

    In each round only the units that lost the last one are derived again: they must miss the
    units of the corpus, the surrogates settled before, and each other. Those
    settled are written once and never rewritten.
    """
    made = F.expr(surrogate_sql("kind", "norm", "attempt", key))
    real = found.select("kind", F.col("norm").alias("made"))
    keys, rows, settled = ["kind", "made"], found.withColumn("attempt", F.lit(0)), None
    for attempt in range(1, MAX_ATTEMPTS):
        rows = stored(rows.withColumn("made", made), "derived")
        free = rows.join(real, keys, "left_anti")
        if settled is not None:
            free = free.join(settled.select(*keys), keys, "left_anti")
        won = stored(free.groupBy(*keys).agg(F.min("norm").alias("norm")).withColumn(
            "attempt", F.lit(attempt - 1)), "settled")
        settled = won if settled is None else settled.unionByName(won)
        rows = stored(rows.join(won, ["kind", "norm"], "left_anti").select(
            "kind", "norm", F.lit(attempt).alias("attempt")), "lost")
        if rows.isEmpty():
            return settled.filter("attempt > 0").select("kind", "norm", "attempt")
    raise ValueError("no free surrogates are left")


def with_surrogates(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """The documents with surrogates in their texts, and ``n_entities``; ``n_chars`` follows the text.

    Rows travel as one column, so that no name of theirs meets one of these steps.
    """
    later = stored(later_attempts(stored(units(docs), "units"), key), "attempts")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("t"),
                        entities(F.col("text")).alias("found"))
    if later.isEmpty():
        found = found.withColumn("later", F.lit(None).cast("map<string,int>"))
    else:
        # Rows with equal texts need equal attempts, so that the text's hash may stand for the row.
        hashed = found.withColumn("hash", F.sha2("t", 256))
        used = (hashed.filter(F.size("found") > 0).select("hash", F.explode("found").alias("e"))
                .withColumn("k", F.expr(kind_sql("e")))
                .select("hash", F.inline(F.expr(units_sql("e", "k"))))
                .join(later, ["kind", "norm"]).groupBy("hash").agg(F.map_from_entries(F.collect_set(
                    F.struct(F.concat_ws(":", "kind", "norm"), "attempt"))).alias("later")))
        found = hashed.join(used, "hash", "left")
    attempt = "coalesce(later[concat_ws(':', u.kind, u.norm)], 0)"
    made = f"transform({units_sql('e', 'k')}, u -> {surrogate_sql('u.kind', 'u.norm', attempt, key)})"
    replaced = f"transform(found, e -> {_let('k', kind_sql('e'), _let('m', made, render_sql('e', 'k', 'm')))})"
    pattern = _quoted(PATTERN)
    text = F.expr(f"IF(size(found) = 0, t, array_join(flatten(zip_with(split(t, {pattern}, -1), "
                  f"{replaced}, (a, b) -> array(a, coalesce(b, '')))), ''))")
    out = found.select("row", "found", text.alias("t"))
    new = {"text": F.col("t")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("found") > 0, F.length("t").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns if c != "n_entities"],
                      F.size("found").cast("long").alias("n_entities"))


def report(docs: DataFrame) -> DataFrame:
    """Every document's text with surrogates, and how many entities were replaced."""
    return with_surrogates(docs).select("doc_id", "text", "n_entities")
