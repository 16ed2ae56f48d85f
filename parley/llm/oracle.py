"""The same in SQL, where SQL can express it."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op9_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), ranked AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS place,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM bare WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM ranked
"""

ORACLE["op1_url_filter"] = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1),
           '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&+', '') AS query
  FROM cut
), keyed AS (
  SELECT page_id, host, path,
         regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS key
  FROM parts
), listed AS (
  SELECT DISTINCT key FROM keyed
  WHERE key <> '' AND list_has_any(string_split(host, '.'), ['spam-farm', 'casino-win'])
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT page_id, k.host, k.path, k.key, rule_host || rule_path AS rule, verdict
  FROM keyed k LEFT JOIN rules r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT page_id, host, path, key, max_by(rule, length(rule)) AS rule,
         max_by(verdict, length(rule)) AS rule_verdict
  FROM fitting GROUP BY page_id, host, path, key
)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END)
         AS verdict
FROM best
"""

ORACLE["op2_chat_format"] = """
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role,
         coalesce(text, '') AS text
  FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), ''
                    ORDER BY turn, role, text) AS text
  FROM turns GROUP BY conv_id
), distinct_ones AS (
  SELECT min(conv_id) AS conv_id, turns, any_value(n_turns) AS n_turns, count(*) AS n_logged,
         any_value(text) AS text
  FROM whole GROUP BY turns
)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, n_logged, text FROM distinct_ones a
WHERE NOT EXISTS (
  SELECT 1 FROM distinct_ones b
  WHERE b.turns[1] = a.turns[1] AND b.n_turns > a.n_turns AND b.turns[1:a.n_turns] = a.turns
)
"""

ORACLE["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS size FROM worded
), placed AS (
  SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM sized
), found AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM placed GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM found WHERE size > 1
), cuts AS (
  SELECT lang, phrase, w, f, size, unnest(range(1, size)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, n,
         CAST(CAST(1000 AS HUGEINT) * c.f * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
    JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), part_sizes AS (
  SELECT lang, w, f, size, unnest(range(2, size)) AS s FROM candidates WHERE size > 2
), parts AS (
  SELECT lang, w, f, s, unnest(range(1, size - s + 2)) AS i FROM part_sizes
), held AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS most FROM parts GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank,
       s.phrase, a, l, r, n, score
FROM weakest s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
WHERE h.most IS NULL OR 100 * h.most < 100 * a
QUALIFY rank <= 2000
"""

ORACLE["op13_substring_dedup"] = r"""
WITH worded AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS id, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT rid, id, i, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT rid, id, w, unnest(range(1, len(w) - 11)) AS i FROM worded)
), judged AS (
  SELECT rid, i, id > min(id) OVER (PARTITION BY words) AS repeated FROM windows
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 13)) AS place FROM judged WHERE repeated
), placed AS (
  SELECT rid, w, unnest(range(1, len(w) + 1)) AS place FROM worded
), kept AS (
  SELECT p.rid, count(*) AS n, string_agg(w[place], ' ' ORDER BY place) AS text
  FROM placed p ANTI JOIN gone g ON g.rid = p.rid AND g.place = p.place GROUP BY p.rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (rid)
"""
