"""The queries that SQL can express, for DuckDB."""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body),
h AS (SELECT p.page_id, octet_length(encode(p.body)) AS n, sha1(p.body) AS hex, f.first FROM p JOIN f ON p.body = f.body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
         ((16 * (instr('0123456789abcdef', substr(hex, CAST(5 * k // 4 AS INTEGER) + 1, 1)) - 1)
             + (instr('0123456789abcdef', substr(hex, CAST(5 * k // 4 AS INTEGER) + 2, 1)) - 1))
          // CAST(pow(2, 3 - 5 * k % 4) AS BIGINT)) % 32) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM h
"""

_COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
"""

VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE x.norm > 0 AND y.norm > 0 AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_COMPONENTS}
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(l.b, v.vec_id) AS kept
FROM v LEFT JOIN counted c ON v.vec_id = c.a LEFT JOIN lowest l ON v.vec_id = l.a
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
single AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS c FROM single x JOIN single y
  ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (n + m - c)),
{_COMPONENTS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(l.b, s.doc_id) AS kept
FROM sets s LEFT JOIN lowest l ON s.doc_id = l.a
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORDS}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{_WORDS}') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS gram
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM sized)),
places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
  FROM d CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (
  SELECT p.doc_id, p.k, p.size, x.item
  FROM (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM places) p
  JOIN windows x ON p.gram = x.gram AND p.size = x.size),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY doc_id),
met AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN met m ON d.doc_id = m.doc_id
"""

# The prior of a rule as in host_rules.beta_prior, over the hosts' sums.
_RATES = {
    r: f"({r} + greatest(s_{r} * k_{r} / docs, 1e-9)) / (n + greatest(s_{r} * k_{r} / docs, 1e-9) + greatest(s_{r} * (1 - k_{r} / docs), 1e-9))"
    for r in ("word_length", "symbols", "dup_lines", "any_rule")
}
_STRENGTH = """CASE WHEN m < 2 OR k_{r} = 0 OR k_{r} = docs OR docs - nn / docs - (m - 1) <= 0 THEN 10.0 ELSE
  1 / least(greatest((kkn_{r} - k_{r} * k_{r} / docs - k_{r} / docs * (1 - k_{r} / docs) * (m - 1))
      / (k_{r} / docs * (1 - k_{r} / docs) * (docs - nn / docs - (m - 1))), 1e-9), 1.0) - 1 END AS s_{r}"""

HOST_RULES = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, nullif(lower(trim(source)), '') AS host, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
places AS (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM cut WHERE len(w) > 8),
windows AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS words FROM places),
twice AS (SELECT id, words FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT id, unnest(range(i, i + 8)) AS at FROM windows JOIN twice USING (id, words)),
repeated AS (SELECT id, count(*) AS n FROM covered GROUP BY id),
counts AS (
  SELECT c.id, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut c LEFT JOIN repeated r ON c.id = r.id),
failures AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length, 10 * n_symbols > n_words AS symbols,
    10 * n_dup_lines > 3 * n_lines AS dup_lines FROM counts),
hosts AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, count_if(word_length) AS word_length, count_if(symbols) AS symbols,
    count_if(dup_lines) AS dup_lines, count_if(base_failed OR word_length OR symbols OR dup_lines) AS any_rule
  FROM failures WHERE host IS NOT NULL GROUP BY host),
sums AS (
  SELECT count(*) AS m, sum(n) AS docs, sum(n * n) AS nn,
    {", ".join(f"CAST(sum({r}) AS DOUBLE) AS k_{r}, sum({r} * {r} / n) AS kkn_{r}" for r in _RATES)} FROM hosts),
prior AS (SELECT *, {", ".join(_STRENGTH.format(r=r) for r in _RATES)} FROM sums),
verdicts AS (SELECT host, {", ".join(f"{e} AS rate_{r}" for r, e in _RATES.items())} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(rate_any_rule > 0.5, FALSE) OR (word_length AND coalesce(rate_word_length > 0.25, FALSE))
    OR (symbols AND coalesce(rate_symbols > 0.25, FALSE)) OR (dup_lines AND coalesce(rate_dup_lines > 0.25, FALSE))) AS kept
FROM failures LEFT JOIN verdicts USING (host)
"""


def _assign(turn: int, book: str) -> str:
    """Nearest entry of every part; min_by over (distance, index) settles ties."""
    return f"""near{turn} AS (
  SELECT x.id, x.part, min((list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS hit
  FROM parts x JOIN {book} b ON x.part = b.part GROUP BY x.id, x.part)"""


def _replace(turn: int, book: str) -> str:
    return f"""sums{turn} AS (
  SELECT part, hit[2] AS entry, count(*) AS n, [{", ".join(f"CAST(sum(v[{i}]) AS BIGINT)" for i in range(1, 5))}] AS s
  FROM near{turn} JOIN parts USING (id, part) GROUP BY ALL),
book{turn} AS (
  SELECT b.part, b.entry, CASE WHEN n IS NULL THEN b.v ELSE list_transform(s, lambda c: (c - ((c % n) + n) % n) // n) END AS v
  FROM {book} b LEFT JOIN sums{turn} USING (part, entry))"""


VECTOR_CODES = f"""
WITH usable AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label,
    list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT id, part, x[part * 4 + 1:part * 4 + 4] AS v FROM usable, range(16) AS p(part)),
book0 AS (SELECT part, id AS entry, v FROM parts WHERE id < 64),
{_assign(1, "book0")}, {_replace(1, "book0")},
{_assign(2, "book1")}, {_replace(2, "book1")},
{_assign(3, "book2")},
coded AS (
  SELECT id, string_agg(printf('%02x', CAST(hit[2] AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(hit[1]) AS BIGINT) AS error
  FROM near3 GROUP BY id),
labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN usable USING (id) GROUP BY label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT u.vec_id, c.code, c.error, l.label_error, d.codebooks_sha256
FROM usable u JOIN coded c USING (id) JOIN labels l ON u.label IS NOT DISTINCT FROM l.label, digest d
"""
