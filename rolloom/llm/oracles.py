"""SQL for the queries that SQL can express, written from the contracts and not from the plans."""

from __future__ import annotations

from rolloom.llm import quality
from rolloom.llm.secret_scan import RULES
from rolloom.llm.texts import WORD

_DOCS_BYTES = """
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(16) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 4
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 4)
"""

_OP1 = (
    _DOCS_BYTES
    + """,
hexed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n,
    string_split(hex(encode(coalesce(text, ''))), '') AS h
  FROM documents
), nibbles AS (
  SELECT doc_id, n, list_prepend(4294967295::BIGINT,
    list_transform(range(2 * n), lambda i: (instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1)::BIGINT)) AS b
  FROM hexed
), sized AS (
  SELECT doc_id, (n + 1)::BIGINT AS size,
    xor(list_reduce(b, lambda c, x: xor(c >> 4, t[xor(c & 15, x) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM nibbles, crc_table
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM sized
), cut AS (
  SELECT *, least(15, floor((before * 2.0::DOUBLE + size) / (total * 2.0::DOUBLE) * 16))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
)

_NORMAL = """
  CASE WHEN {host}({url}) <> '' THEN regexp_replace({host}({url}), ':(80|443)$', '')
    || regexp_replace({path}({url}), '(/index\\.html?)?/*$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
         string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'),
         lambda p: p <> '' AND string_split(p, '=')[1] NOT IN (
           'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))), '&'), ''), '')
  END"""

_HOST = (
    "translate(coalesce(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), ''),"
    " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_PATH = "coalesce(regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"


def _normal(url: str) -> str:
    host, path = _HOST.format(url=url), _PATH.format(url=url)
    return _NORMAL.replace("{host}({url})", host).replace("{path}({url})", path).replace("{url}", url)


#: Absolute canonical links are followed; the tables have no other kind of link.
_OP2 = f"""
WITH RECURSIVE rules(action, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), numbered AS (SELECT row_number() OVER () AS r, * FROM pages
), parsed AS (
  SELECT r, page_id, {_HOST.format(url='url')} AS h, {_PATH.format(url='url')} AS p, {_normal('url')} AS node FROM numbered
), matched AS (
  SELECT r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
    arg_max(action, length(rules.host || rules.path)) AS action
  FROM parsed JOIN rules ON (h = rules.host OR ends_with(h, '.' || rules.host)) AND starts_with(p, rules.path)
  GROUP BY r
), judged AS (SELECT parsed.*, rule, action FROM parsed LEFT JOIN matched USING (r)
), tags AS (
  SELECT {_normal('url')} AS a, unnest(regexp_extract_all(regexp_extract(html, '(?is)^(.*?)<body', 1), '(?is)<link\\b[^>]*>')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical')
), hrefs AS (
  SELECT a, regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?([^"''> ]*)', 1) AS target FROM tags
  WHERE regexp_matches(tag, '(?is)\\srel\\s*=\\s*["'']?canonical\\b')
), edges AS (
  SELECT a, {_normal('target')} AS b FROM hrefs WHERE contains(target, '://')
), both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON other = a
), member AS (SELECT node, min(other) AS alias_of FROM reach GROUP BY node
), grouped AS (
  SELECT judged.*, alias_of, coalesce(alias_of, judged.node) AS g FROM judged LEFT JOIN member USING (node)
), decided AS (
  SELECT g, bool_or(action = 'allow') AS allows, bool_or(action = 'block') AS blocks FROM grouped WHERE g IS NOT NULL GROUP BY g
)
SELECT page_id, h AS host, p AS path, rule, alias_of,
  coalesce(action, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' END, 'allow') AS verdict
FROM grouped LEFT JOIN decided USING (g)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP3 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, unnest(regexp_extract_all(t, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS pos FROM docs
), windows AS (
  SELECT r, pos, w, count(*) OVER (PARTITION BY r, five) AS times, five IS NOT NULL AS whole
  FROM (SELECT *, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS five
        FROM words WINDOW o AS (PARTITION BY r ORDER BY pos))
), counted AS (
  SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(hit)::BIGINT AS n_repeat_words
  FROM (SELECT r, w, max((whole AND times > 1)::INT) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM windows)
  GROUP BY r
), lines AS (
  SELECT r, line, regexp_extract_all(line, '{WORD}') AS w
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{WORD}')
), shares AS (
  SELECT r, line, len(w) AS n,
    len(list_filter(w, lambda x: regexp_matches(x, {_quoted(quality.NAVIGATION.pattern)}))) AS seps,
    len(list_filter(w, lambda x: regexp_matches(x, {_quoted(quality.SYMBOL_END.pattern)}))) AS symbols,
    len(list_filter(w, lambda x: regexp_matches(x, {_quoted(quality.SHOUT.pattern)}))) AS shouts
  FROM lines
), faults AS (
  SELECT r, line, n,
    (seps > 0 AND seps * 5 >= n)
    OR (n <= 40 AND regexp_matches(line, {_quoted('(?i)' + quality.BOILERPLATE.pattern)}))
    OR 10 * symbols >= 3 * (n - seps)
    OR (n - seps >= 4 AND 2 * shouts >= n - seps)
    OR (n - seps >= 5 AND NOT regexp_matches(rtrim(line, {_SPACES}), {_quoted(quality.SENTENCE_END.pattern)})) AS fault
  FROM shares
), by_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (fault), 0)::BIGINT AS n_lost_words
  FROM faults GROUP BY r
), merged AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
  FROM docs LEFT JOIN counted USING (r) LEFT JOIN by_line USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_lost_words <= {quality.MOST_LOST}::DOUBLE * n_words AS kept
FROM merged
"""

_KINDS = " UNION ALL ".join(
    f"SELECT r, {at} AS k, '{rule.kind}' AS kind, {rule.least} AS least,"
    f" unnest(regexp_extract_all(t, {_quoted(rule.pattern)})) AS hit,"
    f" unnest(regexp_extract_all(t, {_quoted(rule.pattern)}, {rule.group})) AS part,"
    f" unnest(list_resize(string_split_regex(t, {_quoted(rule.pattern)}), len(regexp_extract_all(t, {_quoted(rule.pattern)})))) AS gap,"
    f" generate_subscripts(regexp_extract_all(t, {_quoted(rule.pattern)}), 1) AS i FROM docs"
    for at, rule in enumerate(RULES)
)
_OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), hits AS ({_KINDS}
), placed AS (
  SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) - length(hit))::BIGINT AS s FROM hits
), spans AS (
  SELECT r, k, kind, s, kind || ':' || s || ':' || (s + length(hit)) AS span FROM placed WHERE length(part) >= least
), grouped AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(span, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM docs LEFT JOIN grouped USING (r)
"""

_OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, md5(text), '') AS draw_key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::BIGINT AS cap,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT a.cap / a.weight AS ratio, any_value(total - capped) / any_value(rest) AS level
  FROM sources a, LATERAL (
    SELECT sum(source_size)::DOUBLE AS total, coalesce(sum(cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0.0) AS capped,
      sum(weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS rest
    FROM sources b)
  GROUP BY ratio
), final AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio
), targets AS (
  SELECT source, source_size, CASE WHEN cap < weight * level THEN cap ELSE weight * level END AS target FROM sources, final
), rated AS (
  SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix:' || draw_key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, source,
  (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies,
  size * (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS taken
FROM rated
"""

_OP12 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
), counted AS MATERIALIZED (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM candidates
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3
), rated AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = lp JOIN counted y ON y.lang = cuts.lang AND y.phrase = rp
), lowest AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3) GROUP BY lang, phrase
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase)
WHERE around IS NULL OR 100 * around < 50 * a
QUALIFY rank <= 2000
"""

#: The pages of the tables hold their text in one article of h1 and p; other layouts are covered by tests.
_OP13 = """
WITH numbered AS (
  SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body
  FROM pages
), cut AS (
  SELECT r, unnest(string_split_regex(body, '</?(?:h1|p)>')) AS part,
    generate_subscripts(string_split_regex(body, '</?(?:h1|p)>'), 1) AS i
  FROM numbered
), plain AS (
  SELECT r, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
    regexp_replace(part, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)),
    '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS block
  FROM cut
), joined AS (SELECT r, string_agg(block, chr(10) ORDER BY i) AS text FROM plain WHERE block <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars
FROM numbered LEFT JOIN joined USING (r)
"""

ORACLES: dict[str, str] = {
    "op1_byte_shards": _OP1,
    "op2_alias_urls": _OP2,
    "op3_line_quality": _OP3,
    "op4_blob_secrets": _OP4,
    "op8_source_mix": _OP8,
    "op12_parsed_phrases": _OP12,
    "op13_path_text": _OP13,
}
