"""DuckDB SQL that says the same as some of the queries, each in its own way."""

OP9 = r"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT k.*, coalesce(c.first_doc <> k.doc_id, false) AS dropped FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP8 = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS raw,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), b AS (
  SELECT page_id, url, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM a
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), ruled AS (
  SELECT b.*, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS pick
  FROM b LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), p AS (SELECT * FROM ruled WHERE pick = 1
), u AS (
  SELECT url, count(*) AS n, min(rule_verdict) AS v FROM p WHERE length(url) > 0 GROUP BY url
), s AS (
  SELECT *, '^^' || regexp_replace(translate(regexp_replace(url, '[0-9]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^a-z0/.\-_?=&#%:+]', '~', 'g') AS t FROM u
), g AS (SELECT url, n, v, substr(t, i, 3) AS abc FROM (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM s)
), counted AS (
  SELECT side, abc, coalesce(sum(n) FILTER (v = side), 0)::DOUBLE AS k
  FROM g, (VALUES ('allow'), ('block')) AS sides(side) GROUP BY side, abc
), bi AS (SELECT side, substr(abc, 2) AS bc, sum(k) AS k FROM counted GROUP BY ALL
), uni AS (SELECT side, substr(bc, 2) AS c, sum(k) AS k FROM bi GROUP BY ALL
), tot AS (SELECT side, sum(k) AS k FROM uni GROUP BY ALL
), cab AS (SELECT side, substr(abc, 1, 2) AS ab, sum(k) AS n, count(*) FILTER (k > 0) AS t FROM counted GROUP BY ALL
), cb AS (SELECT side, substr(bc, 1, 1) AS b, sum(k) AS n, count(*) FILTER (k > 0) AS t FROM bi GROUP BY ALL
), p0 AS (SELECT uni.side, c, (uni.k + 1.0) / (tot.k + 40.0) AS p FROM uni JOIN tot USING (side)
), p1 AS (
  SELECT bi.side, bc, CASE WHEN cb.n > 0 THEN (bi.k + cb.t * p0.p) / (cb.n + cb.t) ELSE p0.p END AS p
  FROM bi JOIN cb ON cb.side = bi.side AND cb.b = substr(bc, 1, 1) JOIN p0 ON p0.side = bi.side AND p0.c = substr(bc, 2)
), p2 AS (
  SELECT x.side, abc, CASE WHEN cab.n > 0 THEN (x.k + cab.t * p1.p) / (cab.n + cab.t) ELSE p1.p END AS p
  FROM counted x JOIN cab ON cab.side = x.side AND cab.ab = substr(abc, 1, 2) JOIN p1 ON p1.side = x.side AND p1.bc = substr(abc, 2)
), m AS (SELECT abc, sum(CASE side WHEN 'allow' THEN ln(p) ELSE -ln(p) END) AS llr FROM p2 GROUP BY abc
), scored AS (SELECT url, any_value(n) AS n, any_value(v) AS v, avg(llr) AS llr FROM g JOIN m USING (abc) GROUP BY url
), mo AS (
  SELECT v, sum(n * llr) / sum(n) AS mean, sqrt(greatest(sum(n * llr * llr) / sum(n) - (sum(n * llr) / sum(n)) ** 2, 0.0)) + 1e-6 AS spread
  FROM scored WHERE v IS NOT NULL GROUP BY v
), th AS (
  SELECT (x.mean * y.spread + y.mean * x.spread) / (x.spread + y.spread) AS threshold
  FROM mo x, mo y WHERE x.v = 'allow' AND y.v = 'block'
)
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.rule_verdict, CASE WHEN scored.llr < (SELECT threshold FROM th) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN scored ON p.url = scored.url
"""

OP11 = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

#: CRC-32 byte by byte, by the usual table of 256 remainders of the reflected polynomial 0xEDB88320.
OP12 = r"""
WITH RECURSIVE entry AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
  FROM range(256) r(i)
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM entry
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::UBIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) % 256)::BIGINT + 1]))) AS crc
  FROM bytes, crc_table
), changed AS (
  SELECT CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::INTEGER) || substr(run, (crc % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS form, max(o.n) AS form_n
  FROM near JOIN words o ON o.word = other GROUP BY near.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS stop FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.stop WHERE formed.form IS NOT NULL
), ends AS (
  SELECT chain.word, stop AS root FROM chain JOIN formed ON formed.word = chain.stop WHERE formed.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
