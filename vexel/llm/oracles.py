"""DuckDB SQL of the operators that SQL can express."""

#: CRC-32 (polynomial 0xEDB88320) of a text's UTF-8 bytes, as a macro-like fragment over the column named ``t``.
CRC_TABLE = """crc_step AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i)))"""
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)))"""

OP2 = f"""WITH RECURSIVE {CRC_TABLE},
rows_in AS (
  SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, '')) + 1 AS size, {CRC.format(t="coalesce(text, '')")} AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 16))::UBIGINT::HUGEINT AS k
  FROM documents, crc_step),
walk(rid, n, k, b, j) AS (
  SELECT rid, n, k, -1::BIGINT, 0::BIGINT FROM rows_in, (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT rid, n, nk, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM walk WHERE j < n)),
placed AS (SELECT rid, max(b) FILTER (n = 16) AS shard, max(b) FILTER (n = 17) AS grown_shard FROM walk GROUP BY rid)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text_crc32::VARCHAR, size::VARCHAR)), 1, 3))::INTEGER,
    doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM rows_in JOIN placed USING (rid)"""


OP8 = """WITH doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
spans AS (SELECT item, w, least(len(w), 10) AS span FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, span, array_to_string(w[i:i + span - 1], ' ') AS win FROM (SELECT item, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM spans)),
doc_windows AS (
  SELECT rid, span, i, array_to_string(w[i:i + span - 1], ' ') AS win
  FROM (SELECT rid, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM doc_words, (SELECT DISTINCT span FROM spans) WHERE len(w) >= span)),
hit AS (SELECT rid, i, doc_windows.span, item FROM doc_windows JOIN windows ON doc_windows.span = windows.span AND doc_windows.win = windows.win),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + span)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""

OP6 = """WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
scored AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2]))::BIGINT AS score FROM q, v WHERE vec_id <> query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


OP11 = """WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
m AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (len(w) < 100)::INTEGER + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INTEGER + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INTEGER
    + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(first < d.doc_id, false)::INTEGER AS fails
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM r GROUP BY ALL),
c AS (SELECT part, s, sum(CASE WHEN fails & s = 0 THEN n ELSE 0 END)::BIGINT AS n, sum(CASE WHEN fails & s = 0 THEN good ELSE 0 END)::BIGINT AS good, sum(CASE WHEN fails & s = 0 THEN bad ELSE 0 END)::BIGINT AS bad
  FROM g, range(32) t(s) GROUP BY ALL),
l AS (SELECT i, chr(65 + i::INTEGER) AS name, 1 << i AS b FROM range(5) t(i)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS f FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, f[step] AS f, coalesce(list_sum(f[1:step - 1]), 0)::BIGINT AS before FROM o, range(1, 6) t(step)),
x AS (
  SELECT y.part, filter_order, step, f, y.n AS kept, b.n - y.n AS removed, z.n - a.n - (b.n - y.n) AS redundant, u.n - v.n AS unique_fails, b.good - y.good AS good_lost, b.bad - y.bad AS toxic_lost
  FROM steps JOIN c y ON y.s = before + f JOIN c b ON b.part = y.part AND b.s = before JOIN c z ON z.part = y.part AND z.s = 0 JOIN c a ON a.part = y.part AND a.s = f
  JOIN c u ON u.part = y.part AND u.s = 31 - f JOIN c v ON v.part = y.part AND v.s = 31)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM x"""

OP13 = f"""WITH RECURSIVE {CRC_TABLE},
split AS (
  SELECT row_number() OVER () AS rid, doc_id, src, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, text, 0 AS src FROM documents UNION ALL SELECT NULL, text, 1 FROM benchmark)),
f AS (SELECT rid, src, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM split),
named AS (SELECT g, ({CRC.format(t="g")}) % 10000 AS bucket FROM (SELECT DISTINCT g FROM f), crc_step),
counts AS (SELECT bucket, count(*) FILTER (src = 0) AS s, count(*) FILTER (src = 1) AS t FROM f JOIN named USING (g) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN named USING (g) JOIN gains USING (bucket) WHERE src = 0 GROUP BY rid),
weighed AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(sums.gain::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM split LEFT JOIN sums USING (rid) WHERE src = 0),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (25 * n) // 100 THEN place END::BIGINT AS rank FROM placed"""
