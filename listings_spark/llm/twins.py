"""SQL twins (DuckDB) of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

SHARDING = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n::BIGINT, range(8)::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(coalesce(text, '')) AS x FROM documents
), summed AS (
  SELECT doc_id, size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda b:
        ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM sized, crc_table
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) AS nth, sum(size) OVER () AS total
  FROM summed
), cut AS (
  SELECT *, least(15, ((2 * before + size) * 16) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), weighed AS (
  SELECT *, CASE WHEN size < 100 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS odds FROM sized
), classes AS (
  SELECT source, odds, sum(size)::BIGINT AS class_size FROM weighed GROUP BY ALL
), sources AS (
  SELECT source, sum(class_size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM classes GROUP BY source
), levels AS (
  SELECT a.source, (sum(b.source_size) - 3.0 * sum(CASE WHEN 3.0 * b.source_size / b.weight
      < 3.0 * a.source_size / a.weight THEN b.source_size ELSE 0 END))
    / sum(CASE WHEN 3.0 * b.source_size / b.weight < 3.0 * a.source_size / a.weight
      THEN 0.0 ELSE b.weight END) AS level
  FROM sources a, sources b GROUP BY a.source
), free AS (
  SELECT min(3.0 * source_size / weight) AS least_free FROM sources
    JOIN levels ON sources.source IS NOT DISTINCT FROM levels.source
  WHERE level * weight <= 3.0 * source_size
), targets AS (
  SELECT s.source, s.source_size, CASE WHEN s.source_size > 0 THEN least(3.0 * s.source_size,
    coalesce((SELECT max(l.level) FROM levels l JOIN sources x ON l.source IS NOT DISTINCT FROM x.source, free
      WHERE 3.0 * x.source_size / x.weight = least_free), 1e300) * s.weight) ELSE 0.0 END::DOUBLE AS target
  FROM sources s
), tried AS (
  SELECT c.*, t.source_size, t.target,
    (t.target - 3.0 * coalesce(sum(class_size) OVER above, 0))
      / nullif(sum(odds * class_size) OVER (PARTITION BY c.source)
        - coalesce(sum(odds * class_size) OVER above, 0.0), 0.0) AS factor
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW above AS (PARTITION BY c.source ORDER BY odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), factors AS (
  SELECT source, arg_max(factor, odds) AS chosen FROM tried WHERE factor * odds <= 3 GROUP BY source
), planned AS (
  SELECT t.*, greatest(0.0, least(3.0, coalesce(f.chosen, 1e300) * t.odds))::DOUBLE AS expected
  FROM tried t LEFT JOIN factors f ON t.source IS NOT DISTINCT FROM f.source
), plan AS (
  SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS chance,
    target - sum(floor(expected) * class_size) OVER (PARTITION BY source) AS lacking
  FROM planned
), ranked AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.certain, p.chance, p.lacking,
    (('0x' || substr(md5('7|' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE)
      / 281474976710656.0::DOUBLE AS u
  FROM weighed d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.odds = p.odds
), run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY
    CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) ELSE 'inf'::DOUBLE END,
    doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked
), taken AS (
  SELECT *, certain + CASE WHEN chance > 0 AND before + size / 2 <= lacking THEN 1 ELSE 0 END AS copies FROM run
)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken
FROM taken
"""

WARC = """
WITH told AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM told
), marked AS (
  SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM firsts
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM marked
"""

EMBEDDINGS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (
  SELECT a, min(b) AS least FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN named ON vec_id = a
"""

SUFFIX = """
WITH told AS (
  SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents
), pieces AS (
  SELECT doc_id, n, part * 256 AS start, substr(x, part * 512 + 1, 2 * (256 + 49)) AS piece
  FROM (SELECT *, unnest(range((n + 255) // 256)) AS part FROM told)
), spread AS (
  SELECT *, unnest(range(least(256, n - start))) AS inside FROM pieces
), windows AS (
  SELECT doc_id, start + inside AS pos, substr(piece, 2 * inside + 1, 2) AS byte,
    CASE WHEN start + inside + 50 <= n THEN substr(piece, 2 * inside + 1, 100) END AS s
  FROM spread
), firsts AS (
  SELECT s, min(doc_id) AS least FROM windows WHERE s IS NOT NULL GROUP BY s
), marked AS (
  SELECT doc_id, pos, byte, coalesce(max((doc_id > least)::INTEGER) OVER
    (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM windows LEFT JOIN firsts USING (s)
), edged AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS starts FROM marked
), summed AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
    string_agg(byte, '' ORDER BY pos) FILTER (gone = 0) AS kept
  FROM edged GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM told LEFT JOIN summed USING (doc_id)
"""

DIVERGENCE = r"""
WITH read AS (
  SELECT row_number() OVER () AS nth, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
    ) AS terms
  FROM documents
), words AS (SELECT nth, lang, source, unnest(terms) AS term FROM read
), kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT nth) >= 30
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM read
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total, coalesce(any_value(v.v), 0) AS v
  FROM groups g LEFT JOIN counts c USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * t.v) AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), of_lang AS (
  SELECT lang, term,
    1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM shares GROUP BY lang, term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
