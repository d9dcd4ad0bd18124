"""DuckDB SQL for the queries of this subpackage, by query name."""

op5_poisson_mixing = r"""
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(length(text), 0) + 1)::BIGINT AS size FROM documents GROUP BY source),
total AS (SELECT sum(size)::DOUBLE AS all_size, sum(sqrt(size)) AS all_share FROM sizes),
rates AS (SELECT source, rate, greatest(ceil(rate / 500), 1)::INTEGER AS parts FROM (SELECT source, sqrt(size) / all_share * (1.0 * all_size) / size AS rate FROM sizes, total)),
terms AS (
  SELECT source, rate / parts AS rate, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
drawn AS (SELECT r, doc_id, d.source, text, ('0x' || substr(md5('draw17|' || coalesce(doc_id::VARCHAR, '') || CASE WHEN parts > 1 THEN '|' || part ELSE '' END), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM (SELECT rows_.*, parts, unnest(range(1, parts + 1)) AS part FROM rows_ JOIN rates ON rates.source IS NOT DISTINCT FROM rows_.source) d),
counted AS (SELECT d.r, d.doc_id, d.source, d.text, count(*) FILTER (WHERE t.c <= d.u) AS n FROM drawn d JOIN terms t ON t.source IS NOT DISTINCT FROM d.source GROUP BY ALL)
SELECT doc_id, source, copy::BIGINT AS mix_copy,
  ('0x' || substr(md5('order17|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS mix_key, sha256(text) AS text_sha256
FROM counted, LATERAL (SELECT unnest(range(n)) AS copy)
"""

op7_winnowing = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

op11_suffix_dedup = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT r, t, unnest(range(1, octet_length(t) - 198)) AS p FROM d),
h AS (SELECT r, p, count(*) OVER (PARTITION BY md5(t[p:p + 199])) AS c FROM w),
e AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM h WHERE c > 1)),
s AS (SELECT r, run, min(p) AS lo, max(p) + 199 AS hi FROM e GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) + 1 AS a, lo - 1 AS b FROM s
  UNION ALL SELECT d.r, coalesce(max(hi), 0) + 1, octet_length(any_value(t)) FROM d LEFT JOIN s USING (r) GROUP BY d.r
),
kept AS (SELECT r, string_agg(CASE WHEN a <= b THEN hex(t[a:b]) ELSE '' END, '' ORDER BY a) AS x FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed FROM s GROUP BY r)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""

op12_hard_negatives = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
),
p AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT * FROM (SELECT r, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM p WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY pos.r, pos.k ORDER BY score DESC, id) AS rank
  FROM pos JOIN p ON p.r = pos.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
) WHERE rank <= 10
"""

op13_collocations = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, g, count(*)::HUGEINT AS f FROM (
    SELECT lang, w[i : i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS m FROM pieces) WHERE len(w) >= m))
  GROUP BY lang, g HAVING count(*) >= 100
),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, t.n, (1000 * c.f * t.n) // (l.f * r.f) AS score
  FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c JOIN totals t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, unnest([g[1:len(g) - 1], g[2:]]) AS g FROM best WHERE len(g) > 2),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.g = b.g AND i.a >= b.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)) WHERE rank <= 2000
"""
