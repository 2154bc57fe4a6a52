"""SQL that gives the same rows as the queries, for those that SQL can express."""

HOST_RULES = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1)
  GROUP BY r),
metrics AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 1000 * n_dup_lines > 50 * n_words AS noisy
  FROM metrics),
hosts AS (
  SELECT host, count(*) AS docs,
    sum(CASE WHEN base_failed OR noisy THEN 1 ELSE 0 END) AS failures
  FROM judged GROUP BY host),
rates AS (
  SELECT avg(failures / docs) AS m, avg((failures / docs) * (failures / docs)) AS q,
    avg(1 / docs) AS u FROM hosts),
spread AS (SELECT m, q - m * m - m * (1 - m) * u AS v FROM rates),
prior AS (
  SELECT m, greatest(0.3, 4 * m / (1 + 3 * m)) AS bound,
    CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2), 50) ELSE 50 END AS s
  FROM spread),
verdicts AS (
  SELECT host, bound, (failures + m * s) / (docs + s) AS rate FROM hosts, prior)
SELECT doc_id, judged.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  base_failed, round(rate, 6) AS host_rate, NOT base_failed AND NOT rate > bound AS kept
FROM judged JOIN verdicts ON judged.host IS NOT DISTINCT FROM verdicts.host
"""

DECONTAMINATION = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM texts, sizes WHERE len(w) >= n),
hits AS (
  SELECT r, i, p.n, item_id
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) p
  JOIN windows ON p.s = windows.s AND p.n = windows.n),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits
        WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

HARD_NEGATIVES = r"""
WITH rows_in AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT * FROM rows_in WHERE vec_id % 100 = 0),
scores AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label AS own, c.r AS c, c.vec_id, c.label,
    CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM anchors a JOIN rows_in c ON a.r <> c.r),
positives AS (
  SELECT a, anchor_id, own, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) AS place
  FROM scores WHERE label = own QUALIFY place <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.c)
      AS rank
  FROM positives p JOIN scores s ON p.a = s.a AND s.label <> p.own
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
  QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
  negative_score
FROM negatives
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
tokens AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
counted AS (SELECT r, lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
vocabulary AS (
  SELECT lang, term FROM counted GROUP BY lang, term HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
sums AS (
  SELECT lang, source, term, sum(n) AS n FROM counted JOIN vocabulary USING (lang, term)
  GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM sums GROUP BY ALL),
grps AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes USING (lang)
    LEFT JOIN totals USING (lang, source)),
dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM grps JOIN vocabulary USING (lang) LEFT JOIN sums USING (lang, source, term)),
lang_terms AS (
  SELECT lang, term,
    1 + (1000000000::HUGEINT * (sum(n) + 2))
      // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM dense GROUP BY lang, term),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item,
    sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM dense JOIN lang_terms USING (lang, term) WHERE n > 0 AND p > q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
