"""SQL of the queries that SQL can express."""

from __future__ import annotations

_SUFFIX = r"(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+)"
_STRENGTH = """SELECT *, least(1000.0::DOUBLE, greatest(1.0::DOUBLE,
    CASE WHEN spread > noise THEN (binomial - noise) / (spread - noise) - 1 ELSE 1000.0::DOUBLE END)) AS strength FROM (
  SELECT *, sum(CASE WHEN n > 0 THEN n * pow(good / n - m, 2) END) OVER () AS spread, sum(CASE WHEN n > 0 THEN m * (1 - m) END) OVER () AS noise,
    sum(CASE WHEN n > 0 THEN n * m * (1 - m) END) OVER () AS binomial"""

OP4_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.*$', '') AS site FROM p
), h AS (
  SELECT site, sum(coalesce(quality, 0))::DOUBLE AS good, count(quality) AS n,
    CASE WHEN regexp_matches(site, '^([0-9.]+|\[.*)$') THEN site
      ELSE regexp_extract(site, '(?:^|\.)((?:[^.]+\.)?{_SUFFIX})$', 1) END AS domain,
    CASE WHEN regexp_matches(site, '^([0-9.]+|\[.*)$') THEN '#' ELSE regexp_extract(site, '(?:^|\.)({_SUFFIX})$', 1) END AS suffix
  FROM u LEFT JOIN labels ON doc_id = page_id WHERE site <> '' GROUP BY site
), d AS (
  SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM h GROUP BY domain, suffix
), s AS (
  SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY suffix
), s1 AS (
  SELECT *, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM s) AS m FROM s
), s2 AS (
  {_STRENGTH} FROM s1)
), d1 AS (
  SELECT d.*, (s2.good + s2.m * s2.strength) / (s2.n + s2.strength) AS m FROM d JOIN s2 USING (suffix) WHERE s2.n > 0
), d2 AS (
  {_STRENGTH} FROM d1)
), h1 AS (
  SELECT h.*, (d2.good + d2.m * d2.strength) / (d2.n + d2.strength) AS m FROM h JOIN d2 USING (domain)
), h2 AS (
  {_STRENGTH} FROM h1)
), beta AS (
  SELECT site, n AS seen, good + m * strength AS a, n - good + strength - m * strength AS b FROM h2
), bounds AS (
  SELECT site, seen, round(a / (a + b) + 1.645::DOUBLE * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 6) AS bound FROM beta
), cut AS (
  SELECT min(bound) AS cut FROM (SELECT bound, count(*) OVER (ORDER BY bound) AS upto, count(*) OVER () AS total FROM bounds WHERE seen > 0)
  WHERE upto >= 0.1::DOUBLE * total
), judged AS (
  SELECT page_id, host, path, bound, cut, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u LEFT JOIN bounds USING (site), cut
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL OR bound < cut THEN 'block' ELSE 'allow' END AS verdict, bound
FROM judged
"""

OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row_id, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), u AS (
  SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), g AS (
  SELECT row_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
    || ' ' || lead(word, 4) OVER o AS shingle FROM u WINDOW o AS (PARTITION BY row_id ORDER BY i)
), again AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, shingle) AS times FROM g WHERE shingle IS NOT NULL)
  WHERE times > 1
), covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY row_id
), c AS (
  SELECT row_id, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (row_id)
), m AS (
  SELECT *, n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS word_length FROM c
), texts AS (
  SELECT DISTINCT lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, symbols, dup_lines, repeats, word_length
  FROM m WHERE n_words >= 10
), v AS (
  SELECT lang, source, 'symbols' AS metric, symbols AS value FROM texts
  UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM texts
  UNION ALL SELECT lang, source, 'repeats', repeats FROM texts
  UNION ALL SELECT lang, source, 'word_length', word_length FROM texts
), fine AS (
  SELECT lang, source, metric, CASE WHEN value <= 0 THEN 0 ELSE 1 + ceil(ln(value::DOUBLE) / ln(1.02::DOUBLE)) END AS bin,
    count(*) AS n FROM v GROUP BY ALL
), levels AS (
  SELECT 'own' AS level, lang, source, metric, bin, n FROM fine
  UNION ALL SELECT 'lang', lang, '', metric, bin, sum(n) FROM fine GROUP BY ALL
  UNION ALL SELECT 'every', '', '', metric, bin, sum(n) FROM fine GROUP BY ALL
), placed AS (
  SELECT level, lang, source, metric, CASE WHEN bin = 0 THEN 0 ELSE pow(1.02::DOUBLE, bin - 1) END AS value,
    sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels
), q AS (
  SELECT level, lang, source, metric, max(total) AS total, min(CASE WHEN upto >= 0.25 * total THEN value END) AS q1,
    min(CASE WHEN upto >= 0.75 * total THEN value END) AS q3 FROM placed GROUP BY ALL
), lq AS (
  SELECT l.lang, l.metric, (l.total * l.q1 + 100 * e.q1) / (l.total + 100) AS q1, (l.total * l.q3 + 100 * e.q3) / (l.total + 100) AS q3
  FROM q l JOIN q e ON e.level = 'every' AND e.metric = l.metric WHERE l.level = 'lang'
), picked AS (
  SELECT o.lang, o.source, o.metric, (o.total * o.q1 + 100 * l.q1) / (o.total + 100) AS q1, (o.total * o.q3 + 100 * l.q3) / (o.total + 100) AS q3
  FROM q o JOIN lq l ON l.lang = o.lang AND l.metric = o.metric WHERE o.level = 'own'
), f AS (
  SELECT lang, source, metric, q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high FROM picked
), wide AS (
  SELECT lang, source, max(CASE WHEN metric = 'symbols' THEN high END) AS high_symbols,
    max(CASE WHEN metric = 'dup_lines' THEN high END) AS high_dup_lines, max(CASE WHEN metric = 'repeats' THEN high END) AS high_repeats,
    max(CASE WHEN metric = 'word_length' THEN low END) AS low_word_length,
    max(CASE WHEN metric = 'word_length' THEN high END) AS high_word_length
  FROM f GROUP BY lang, source
), sized AS (
  SELECT *, greatest(n_words, 1)::DOUBLE AS w, greatest(n_lines, 1)::DOUBLE AS l, word_chars::DOUBLE AS chars FROM m
), judged AS (
  SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',',
    CASE WHEN (n_symbols - 3 * sqrt(n_symbols::DOUBLE)) * 1000 / w > high_symbols THEN 'symbols' END,
    CASE WHEN (n_dup_lines - 3 * sqrt(n_dup_lines::DOUBLE)) * 1000 / l > high_dup_lines THEN 'dup_lines' END,
    CASE WHEN (n_repeat_words - 3 * sqrt(n_repeat_words::DOUBLE / 10) * 10) * 1000 / w > high_repeats THEN 'repeats' END,
    CASE WHEN (chars - 1.5::DOUBLE * chars / sqrt(w)) * 100 / w > high_word_length
      OR (chars + 1.5::DOUBLE * chars / sqrt(w)) * 100 / w < low_word_length THEN 'word_length' END) AS broken
  FROM sized m LEFT JOIN wide USING (lang, source)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken
FROM judged
"""
