"""SQL that gives the rows of this package's queries, for DuckDB."""

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) t(i)
), dw AS (
  SELECT doc_id, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, greatest(len(ws) - n + 2, 1))) t(i)
), m AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw ON dw.g = bw.g
), h AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(0, n)) t(k) GROUP BY doc_id
), f AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""

#: Shingles in common are counted between classes of equal sets; what a class reaches follows by recursion.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, least(5, len(ws)) AS n FROM d WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) t(i)
), c AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY own) AS class_id FROM (SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS own FROM s GROUP BY doc_id)
), k AS (
  SELECT class_id, n, g FROM c JOIN s USING (doc_id) WHERE doc_id = class_id
), linked AS (
  SELECT a.class_id AS u, b.class_id AS v FROM k a JOIN k b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
  SELECT DISTINCT class_id, class_id AS other FROM c UNION SELECT r.class_id, v FROM reached r JOIN linked ON r.other = u
), t AS (
  SELECT class_id, min(other) AS component_id FROM reached GROUP BY class_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept, coalesce(class_id, doc_id) AS class_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (class_id)
"""

#: Five digits of the hexadecimal digest are four of the base-32 one.
ARCHIVES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), s AS (
  SELECT page_id, html, last, list_transform(range(0, 8), lambda j: CAST('0x' || substr(sha1(html), CAST(5 * j + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM s
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, {LOWERED.format(f"trim(ls[i], {SPACE})")} AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)
), f AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.last <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL OR f.last = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY l.doc_id
"""

URL_FILTER = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT page_id, p.host, p.path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents
), w AS (
  SELECT doc_id, i, string_agg(ws[i], ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, len(ws) AS n
  FROM d, unnest(range(1, len(ws) + 1)) t(i)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w WHERE i + 7 <= n) WHERE c > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest(range(0, 8)) t(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    len(list_filter(ws, lambda w: w = '|')) AS n_bars, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    len(list_filter(ls, lambda l: regexp_matches(l, '([.]{3}|…)[\x20\x09-\x0D]*\z'))) AS n_cut, len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
    len(list_distinct(ws)) AS n_distinct, coalesce(list_max(list_transform(ws, lambda w: length(w))), 0) AS longest,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR (2 * n_symbols > n_words AND 10 * n_symbols > word_chars)
    OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 4 * n_bars > n_words
    OR 2 * n_capitals > word_chars OR 10 * n_cut > 3 * n_lines OR 10 * n_bullets > 9 * n_lines OR (n_words >= 100 AND n_distinct < 30) OR longest > 1000) AS kept
FROM m
"""
