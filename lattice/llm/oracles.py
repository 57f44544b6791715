"""DuckDB SQL for the queries that SQL can express.  Written from the operators' contracts, not from their code."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s + 1 : s + 13] AS g FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (SELECT doc_id, s, n, w[s + 1 : s + n] AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM grams JOIN win USING (g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS z, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, 3 * z AS cap, sum(z) OVER () AS total, coalesce(sum(3 * z) OVER (ORDER BY 3 * z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(w) OVER (ORDER BY 3 * z / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s),
c AS (SELECT *, (total - caps) / ws >= cap / w AS cut FROM l),
t AS (SELECT source, z, CASE WHEN cut THEN cap ELSE (total - coalesce(sum(CASE WHEN cut THEN cap END) OVER (), 0)) / (sum(CASE WHEN NOT cut THEN w END) OVER ()) * w END AS target FROM c),
p AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, size, z, target, passes, target - passes * z AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR)[1:15], d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, z::BIGINT AS source_size, target, (size * (passes + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP8 = """
WITH RECURSIVE s AS (SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS name FROM range(32) t(k)),
p AS (SELECT list(('0x' || md5(name || '/offset')[1:15])::BIGINT % 4099 ORDER BY k) AS o, list(('0x' || md5(name || '/stride')[1:15])::BIGINT % 4098 + 1 ORDER BY k) AS d, list(name ORDER BY k) AS names FROM s),
fill(step, free, slot) AS (
  SELECT 0, list_transform(range(4099), lambda x: true), -1::BIGINT
  UNION ALL
  SELECT step + 1, list_transform(free, lambda f, i: f AND i - 1 <> nxt), nxt FROM (
    SELECT step, free, list_filter(list_transform(range(4099), lambda j: (o[step % 32 + 1] + j * d[step % 32 + 1]) % 4099), lambda y: free[y + 1])[1] AS nxt FROM fill, p WHERE step < 4099)),
owner AS (SELECT slot::INTEGER AS slot, names[(step - 1) % 32 + 1] AS shard FROM fill, p WHERE step > 0)
SELECT doc_id, slot, shard FROM (SELECT doc_id, (('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % 4099)::INTEGER AS slot FROM documents) JOIN owner USING (slot)
"""

OP10 = """
WITH l AS (SELECT doc_id, i, l, ('0x' || md5(l)[1:7])::BIGINT AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE length(text) > 0)),
r AS (SELECT *, i = max(i) OVER (PARTITION BY doc_id) OR (h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 1000003) % 2147483647 % 4 = 0 AS ends FROM l),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r),
chunk AS (SELECT doc_id, c, count(*) AS m, min(i) AS first, string_agg(l, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, c),
ranked AS (SELECT doc_id, c, m, m >= 2 AND row_number() OVER (PARTITION BY body, m >= 2 ORDER BY doc_id, first) > 1 AS gone FROM chunk),
kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS t FROM n JOIN ranked USING (doc_id, c) WHERE NOT gone GROUP BY doc_id),
s AS (SELECT doc_id, sum(m)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_chunks, coalesce(sum(m) FILTER (gone), 0)::BIGINT AS n_removed FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_decontamination": OP1, "op5_mixing": OP5, "op8_sharding": OP8, "op10_line_dedup": OP10}
