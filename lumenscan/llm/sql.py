"""DuckDB SQL for the operators that SQL can express."""

WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS first_id FROM p
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

# Words between ASCII white space, A-Z in lower case; trigrams, bigrams at 0.4, words at 0.16, by the counts of other documents.
BACKOFF = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), l AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d
), w AS (
  SELECT r, len(ws) AS size, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l
), b AS (
  SELECT r, size, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), n AS (
  SELECT r, size, i, v IS NOT NULL AS has2, u IS NOT NULL AS has3,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS n1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) AS n2,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) AS n3
  FROM b
), c AS (
  SELECT *, lag(n1) OVER o AS p1, lag(n2) OVER o AS p2, (SELECT count(*) FROM w) AS total FROM n WINDOW o AS (PARTITION BY r ORDER BY i)
), s AS (
  SELECT r, CASE
    WHEN has3 AND n3 >= 1 THEN ln(n3) - ln(p2)
    WHEN has2 AND n2 >= 1 THEN ln(n2) - ln(p1) + CASE WHEN has3 THEN ln(0.4) ELSE 0 END
    ELSE ln(greatest(n1, 1)) - ln(greatest(total - size, 1))
      + (CASE WHEN has3 THEN 1 ELSE 0 END + CASE WHEN has2 THEN 1 ELSE 0 END + CASE WHEN n1 < 1 THEN 1 ELSE 0 END) * ln(0.4) END AS g
  FROM c
), g AS (SELECT r, count(*) AS n, sum(g) AS g FROM s GROUP BY r)
SELECT l.doc_id, coalesce(g.n, 0) AS n_tokens, round(coalesce(g.g, 0.0), 6) AS log_score, round(g.g / g.n, 6) AS mean_log_score
FROM l LEFT JOIN g ON g.r = l.r
"""

# Components as whole numbers; every fiftieth vec_id asks, all other rows are candidates.
TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _codes(turn: int) -> str:
    """Assignment of all parts to the entries of book ``turn``, and the entries after it."""
    return f"""
, d{turn} AS (
  SELECT p.r, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS far FROM p JOIN b{turn} b ON b.part = p.part AND b.position = p.position
  GROUP BY p.r, p.part, b.entry
), a{turn} AS (
  SELECT r, part, entry, far FROM d{turn} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY far, entry) = 1
), m{turn} AS (
  SELECT p.part, a.entry, p.position, floor(sum(p.x) / count(*)) AS x
  FROM p JOIN a{turn} a ON a.r = p.r AND a.part = p.part GROUP BY p.part, a.entry, p.position
), b{turn + 1} AS (
  SELECT b.part, b.entry, b.position, coalesce(m.x, b.x) AS x
  FROM b{turn} b LEFT JOIN m{turn} m ON m.part = b.part AND m.entry = b.entry AND m.position = b.position
)"""


# 16 parts of equal length, 64 entries, two rounds; books start with the smallest vec_ids.
BALL_CODES = (
    """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT r, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) // 16 AS width FROM v
), p AS (
  SELECT r, i // width AS part, i % width AS position, x FROM u
), b0 AS (
  SELECT part, r AS entry, position, x FROM p WHERE r < 64
)"""
    + _codes(0)
    + _codes(1)
    + _codes(2)
    + """
, h AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, position)) AS codebooks_sha256 FROM b2
), c AS (
  SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY r
)
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM v JOIN c ON c.r = v.r CROSS JOIN h
"""
)

# The CRC-32 is folded bit by bit: a number of a byte is xored in, and each -1 behind it is one step of the polynomial.
VARIANTS = """
WITH RECURSIVE t AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), g AS (
  SELECT run, count(*) AS n, hex(concat(doc_id, ':', run)) AS hex FROM t GROUP BY doc_id, run
), f AS (
  SELECT run, n, flatten(list_transform(range(len(hex) // 2), lambda i: [CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS fold FROM g
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, fold),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM f
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n
  FROM h GROUP BY 1
), v AS (
  SELECT word, CAST(n AS BIGINT) AS n FROM w WHERE length(word) >= 6 AND n >= 5
), x AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), e AS (
  SELECT a.word, b.word AS other, b.n AS n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.rest
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.rest
), k AS (
  SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near FROM e QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1
), o AS (
  SELECT v.word, CASE WHEN k.n >= 5 * v.n THEN k.other END AS form, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= 5 * v.n THEN k.n END AS form_n
  FROM v LEFT JOIN k ON k.word = v.word
), c AS (
  SELECT word, word AS at FROM o UNION ALL SELECT c.word, o.form FROM c JOIN o ON o.word = c.at WHERE o.form IS NOT NULL
), z AS (
  SELECT c.word, c.at AS root FROM c JOIN o ON o.word = c.at WHERE o.form IS NULL
)
SELECT o.word, o.form, z.root, o.n, o.n_near, o.form_n FROM o JOIN z ON z.word = o.word
"""
