"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (
  SELECT page_id, strlen(body) AS size, sha1(body) AS digest FROM p),
f AS (
  SELECT digest, max(page_id) AS keeper FROM h WHERE size >= 1000 GROUP BY digest)
SELECT page_id, size AS payload_bytes, h.digest AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM h LEFT JOIN f ON h.digest = f.digest AND size >= 1000
"""

URL_RULES = f"""
WITH s AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
      THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
      THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM s)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d CROSS JOIN ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
p AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM k LEFT JOIN n USING (doc_id)
"""

REPEATED = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS gram
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
o AS (SELECT gram, min(doc_id) AS owner FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i FROM g JOIN o ON g.gram = o.gram AND owner < doc_id),
mark AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS begins
  FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (
  SELECT doc_id, min(i) AS first, max(i) + 50 AS after
  FROM (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark)
  GROUP BY doc_id, k),
piece AS (
  SELECT doc_id, first, coalesce(lag(after) OVER w, 0) AS low, first AS high
  FROM run WINDOW w AS (PARTITION BY doc_id ORDER BY first)
  UNION ALL SELECT doc_id, max(first) + 1, max(after), 1000000000 FROM run GROUP BY doc_id),
rest AS (
  SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY first) AS h
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(after - first) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a string, bit by bit."""
    digit = "instr('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1"
    octets = (f"list_transform(range(1, 2 * strlen({text}), 2), "
              f"lambda i: ({digit.format(text, 'i')}) * 16 + {digit.format(text, 'i + 1')})")
    return (f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: list_reduce("
            "list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")


CONVERSATIONS = rf"""
WITH RECURSIVE c AS (
  SELECT coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
f AS (SELECT *, {_crc32('place')} % 20 AS fault FROM c),
d AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text), copy) AS i
  FROM d),
e AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth, left(role, 1) AS initial FROM o),
r AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't'
    ELSE '' END AS flaw, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS earlier FROM e),
put(s, n, lines, reached) AS (VALUES
  (0, 0, []::VARCHAR[], 0), (0, 1, ['user:'], 2), (0, 2, ['user:', 'assistant:'], 3),
  (1, 0, [], 1), (1, 1, ['user:'], 2), (1, 2, ['user:', 'assistant:'], 3),
  (2, 0, [], 2), (2, 1, ['assistant:'], 3), (2, 2, ['assistant:', 'user:'], 2),
  (3, 0, [], 3), (3, 1, ['user:'], 2), (3, 2, ['user:', 'assistant:'], 3)),
follows(s, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edit(e, price) AS (VALUES ('D', 3), ('K', 0), ('Ru', 2), ('Ra', 2)),
walk AS (
  SELECT conv, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best
  FROM (SELECT DISTINCT conv FROM r)
  UNION ALL
  SELECT r.conv, r.i, coalesce(follows.t, put.reached), min({{
    'cost': (best.cost + 2 * n + price + (e <> 'D' AND flaw = 't')::INT)::BIGINT,
    'audit': best.audit || repeat('I', n) || left(e, 1),
    'lines': best.lines || put.lines || CASE e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text]
      WHEN 'Ru' THEN ['user:' || text] ELSE ['assistant:' || text] END}})
  FROM walk JOIN r ON r.conv = walk.conv AND r.i = walk.i + 1 JOIN put ON put.s = walk.s CROSS JOIN edit
  LEFT JOIN follows ON follows.s = put.reached
    AND follows.c = CASE e WHEN 'K' THEN initial WHEN 'Ru' THEN 'u' WHEN 'Ra' THEN 'a' END
  WHERE e = 'D' OR (flaw NOT IN ('b', 'd') AND follows.s IS NOT NULL)
  GROUP BY r.conv, r.i, coalesce(follows.t, put.reached)),
closing(s, n, lines) AS (VALUES (0, 0, []::VARCHAR[]), (1, 2, ['user:', 'assistant:']), (2, 1, ['assistant:']), (3, 0, [])),
whole AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (flaw = 'b') AS blank,
    count(*) FILTER (flaw = 'd') AS duplicate, count(*) FILTER (flaw = 't') AS truncated,
    count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv),
done AS (
  SELECT walk.conv, min({{'cost': best.cost + 2 * closing.n, 'audit': best.audit || repeat('I', closing.n),
    'lines': best.lines || closing.lines}}) AS best
  FROM walk JOIN whole ON whole.conv = walk.conv AND whole.n = walk.i JOIN closing ON closing.s = walk.s GROUP BY walk.conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS conv FROM conversations) AS a
LEFT JOIN whole ON whole.conv = a.conv LEFT JOIN done ON done.conv = a.conv
"""

SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
      translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), '{_UPPER}', '{_LOWER}') AS run
    FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {_crc32("(id || ':' || run)")} AS crc FROM runs),
w AS (
  SELECT CASE WHEN crc % 31 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
less AS (
  SELECT word, k, left(word, k - 1) || substr(word, k + 1) AS part
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.part = b.part AND a.k = b.k AND a.word <> b.word
  UNION SELECT less.word, w.word FROM less JOIN w ON less.part = w.word
  UNION SELECT w.word, less.word FROM less JOIN w ON less.part = w.word),
near AS (
  SELECT a AS word, count(*) AS n_near, min({{'less': -w.n, 'near': b}}) AS best
  FROM pairs JOIN w ON w.word = b GROUP BY a),
x AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.near END AS form,
    CASE WHEN -best.less >= 10 * w.n THEN -best.less END AS form_n
  FROM w LEFT JOIN near ON near.word = w.word),
walk AS (
  SELECT word, word AS place, form AS next FROM x
  UNION ALL SELECT walk.word, x.word, x.form FROM walk JOIN x ON x.word = walk.next)
SELECT x.word, x.form, walk.place AS root, x.n, x.n_near, x.form_n
FROM x JOIN walk ON walk.word = x.word AND walk.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_index": WARC, "op6_url_rules": URL_RULES, "op7_repeated_passages": REPEATED,
            "op8_near_duplicates": NEAR_DUPLICATES, "op9_decontaminate": DECONTAMINATE,
            "op11_conversations": CONVERSATIONS, "op13_spelling": SPELLING}
