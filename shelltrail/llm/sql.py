"""The queries in SQL, where SQL can express them."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1 AS weight FROM sources
), placed AS (
  SELECT *, 3 * source_size / weight AS ratio,
    row_number() OVER (ORDER BY 3 * source_size / weight, source IS NULL, source) AS place FROM weighted
), stepped AS (
  SELECT *, CAST((SELECT sum(source_size) FROM placed) - coalesce(sum(3 * source_size) OVER (
      ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM placed
), filled AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE),
    weight * coalesce((SELECT arg_min(level, place) FROM stepped WHERE level <= ratio), 1e300)) AS target FROM stepped
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, least(3 * size, CAST(floor(
    CASE WHEN source_size > 0 THEN size * target / source_size ELSE 0 END
    + CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0) AS BIGINT)) AS taken
FROM sized JOIN filled ON sized.source IS NOT DISTINCT FROM filled.source
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) + 8 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: The crc32 byte by byte, bit by bit; then a table of the best audit to each state, turn by turn.
REPAIR = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, [ord(c)::BIGINT FOR c IN string_split(name, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS way FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, copy,
    CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, (VALUES (1), (2)) copies(copy) WHERE way <> 0 AND (copy = 1 OR way = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS seen FROM placed
), judged AS (
  SELECT *, CASE WHEN said = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS facing FROM seen
), moves(state, letter, cost, role, become) AS (
  VALUES (0, 'K', 0, 's', 1), (0, 'K', 0, 'u', 2), (1, 'K', 0, 'u', 2), (3, 'K', 0, 'u', 2), (2, 'K', 0, 'a', 3),
    (0, 'R', 2, '', 2), (1, 'R', 2, '', 2), (3, 'R', 2, '', 2), (2, 'R', 2, '', 3),
    (0, 'D', 3, '', 0), (1, 'D', 3, '', 1), (2, 'D', 3, '', 2), (3, 'D', 3, '', 3)
), inserted(state, audit, cost, become) AS (
  VALUES (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 4, 3), (1, '', 0, 1), (1, 'I', 2, 2), (1, 'II', 4, 3),
    (2, '', 0, 2), (2, 'I', 2, 3), (3, '', 0, 3), (3, 'I', 2, 2)
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS state, '0000000000' AS found FROM (SELECT DISTINCT conv_id FROM placed)
  UNION ALL
  SELECT b.conv_id, b.place + 1, m.become,
    min(printf('%010d', CAST(left(b.found, 10) AS INTEGER) + i.cost + m.cost + CASE WHEN j.fault = 't' AND m.letter <> 'D' THEN 1 ELSE 0 END)
      || substr(b.found, 11) || i.audit || m.letter)
  FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.place = b.place + 1
    JOIN inserted i ON i.state = b.state JOIN moves m ON m.state = i.become
  WHERE m.letter = 'D' OR (j.fault NOT IN ('b', 'd') AND m.role IN ('', j.initial) AND (m.letter = 'R' OR m.role <> ''))
  GROUP BY b.conv_id, b.place, m.become
), ends AS (
  SELECT b.conv_id, min(printf('%010d', CAST(left(found, 10) AS INTEGER) + c.cost) || substr(found, 11) || c.audit) AS found
  FROM best b JOIN (VALUES (0, '', 0), (1, 'II', 4), (2, 'I', 2), (3, '', 0)) c(state, audit, cost) ON c.state = b.state
  WHERE b.place = (SELECT max(place) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM b.conv_id) GROUP BY b.conv_id
), edits AS (
  SELECT conv_id, unnest(string_split(substr(found, 11), '')) AS edit, generate_subscripts(string_split(substr(found, 11), ''), 1) AS nth_edit FROM ends
), walked AS (
  SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth_edit) AS place FROM edits
), kept AS (
  SELECT w.*, j.role, j.text, count(*) FILTER (WHERE NOT (edit = 'K' AND j.initial = 's')) OVER (PARTITION BY w.conv_id ORDER BY nth_edit) AS nth
  FROM walked w LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.place = w.place WHERE edit <> 'D'
), lines AS (
  SELECT conv_id, nth_edit, CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM kept
), texts AS (
  SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY nth_edit)) AS repaired_sha256 FROM lines GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE facing NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(left(found, 10), '0') AS BIGINT) AS cost,
  coalesce(substr(found, 11), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL = {
    "op9_chat": CHAT,
    "op10_mixing": MIXING,
    "op12_repair": REPAIR,
}
