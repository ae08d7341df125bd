"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# Exact dedup: equal after each run of the six white-space characters is one space.
OP6 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

# Source mix: limited shares by weight, then whole passes and one shorter pass in the order of a hash.
OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS o
  FROM documents
), s AS (
  SELECT k, CAST(sum(size) AS HUGEINT) AS words, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM d GROUP BY k
), r AS (
  SELECT *, row_number() OVER (ORDER BY words * (6 // w), k) AS n FROM s
), b AS (
  SELECT *, sum(words) OVER () - coalesce(sum(words) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS left_words,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
  FROM r
), f AS (
  SELECT n AS first_n, CAST(left_words AS DOUBLE) / CAST(left_w AS DOUBLE) AS share FROM b
  WHERE w * left_words <= 3 * words * left_w ORDER BY n LIMIT 1
), t AS (
  SELECT k, words, CASE WHEN n < first_n THEN CAST(3 * words AS DOUBLE) ELSE w * share END AS target FROM b, f
), q AS (
  SELECT *, least(CAST(floor(target + 0.5) AS HUGEINT), 3 * words) AS take FROM t
), p AS (
  SELECT d.*, q.words, q.target, CASE WHEN q.words > 0 THEN take // q.words ELSE 0 END AS passes,
         CASE WHEN q.words > 0 THEN take % q.words ELSE 0 END AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY o, doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN q ON d.k = q.k
)
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target,
       CAST(passes * size + greatest(least(size, rest - start), 0) AS BIGINT) AS taken
FROM p
"""

# Conversation repair: backwards over the rows, the least (cost, letters) for each of the four states.
def _put(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 't': '{letter}' || {state}.t}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_NEVER = "{'c': 1000000000::BIGINT, 't': ''}"


def _if_stays(way: str, also: str = "true") -> str:
    return f"CASE WHEN r.fault IN (0, 3) AND {also} THEN {way} ELSE {_NEVER} END"


def _kept(x: str) -> str:
    return _if_stays(_put(f"d.{x}", "r.extra", "K"), f"r.x = '{x}'")


_TO_USER = (_kept("u"), _if_stays(_put("d.u", "3 + r.extra", "R")))
_TO_ASSISTANT = (_kept("a"), _if_stays(_put("d.a", "3 + r.extra", "R")))
OP12 = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), kinds AS (
  SELECT n.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named n, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM hurt
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault,
         lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS two
  FROM again
), r AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM faults),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM r GROUP BY conv_id
), dp AS (
  SELECT conv_id, n AS i, {{'c': 3::BIGINT * 0, 't': ''}} AS e, {{'c': 6::BIGINT, 't': 'II'}} AS s, {{'c': 3::BIGINT, 't': 'I'}} AS u,
         {{'c': 0::BIGINT, 't': ''}} AS a FROM stats
  UNION ALL
  SELECT conv_id, i, {_least("e", _put("u2", "3", "I"))}, {_least("s", _put("u2", "3", "I"))}, u2, {_least("a", _put("u", "3", "I"))}
  FROM (SELECT *, {_least("u", _put("a", "3", "I"))} AS u2
        FROM (SELECT d.conv_id, d.i - 1 AS i, {_least(_put("d.e", "4", "D"), _kept("s"), *_TO_USER)} AS e,
                     {_least(_put("d.s", "4", "D"), *_TO_USER)} AS s, {_least(_put("d.u", "4", "D"), *_TO_ASSISTANT)} AS u,
                     {_least(_put("d.a", "4", "D"), *_TO_USER)} AS a
              FROM dp d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i))
), best AS (SELECT conv_id, e.c AS cost, e.t AS audit FROM dp WHERE i = 0),
letters AS (
  SELECT conv_id, audit, unnest(string_split(audit, '')) AS l, generate_subscripts(string_split(audit, ''), 1) AS nth FROM best WHERE audit <> ''
), edits AS (
  SELECT *, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS place,
         count(*) FILTER (l <> 'D') OVER (PARTITION BY conv_id) AS total
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
), lines AS (
  SELECT e.conv_id, e.place, CASE WHEN l = 'K' THEN r.role WHEN (place - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN l = 'I' THEN '' ELSE r.text END AS line
  FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i WHERE l <> 'D'
), joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS body FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN joined ON joined.conv_id IS NOT DISTINCT FROM c.conv_id
"""

# Source divergence: every kept term against every two groups of its language, in 128-bit integers.
OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT row_no, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term
           GROUP BY w.lang, w.source, w.term),
groups AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
totals AS (SELECT g.lang, g.source, coalesce(n, 0) + coalesce(v, 0) AS total FROM groups g
           LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN vocab ON vocab.lang = g.lang),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // t.total AS p
  FROM totals t JOIN kept k ON k.lang = t.lang
  LEFT JOIN counts x ON x.lang = t.lang AND x.source = t.source AND x.term = k.term
), q AS (
  SELECT c.lang, c.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c.c) + 1)) // any_value(l.total) AS q
  FROM counts c JOIN (SELECT s.lang, sum(n) + any_value(v) AS total FROM sums s JOIN vocab ON vocab.lang = s.lang GROUP BY s.lang) l
    ON l.lang = c.lang
  GROUP BY c.lang, c.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(((p - q) * (p - q)) // q AS BIGINT)
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": OP6, "op11_source_mix": OP11, "op12_conversation_repair": OP12, "op13_source_divergence": OP13}
