"""DuckDB SQL of the query catalogue, put together from shared common table expressions."""

from __future__ import annotations

K = 10
BASE = "base AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings)"
Q = "q AS (SELECT vec_id AS query_id, e AS qe FROM base WHERE vec_id % 100 = 0)"
CENTRES = "centres AS (SELECT vec_id::INTEGER AS cluster_id, e AS ce FROM base WHERE vec_id < 16)"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def signs(v: str) -> str:
    return f"list_transform({v}, lambda x: (x > 0)::INTEGER)"


def ham(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({signs(a)}, {signs(b)}), lambda p: (p[1] <> p[2])::BIGINT))::BIGINT"


DIST = {
    "l2": f"round({l2('qe', 'e')}, 6)",
    "sqrt": f"round(sqrt({l2('qe', 'e')}), 6)",
    "l1": "round(list_sum(list_transform(list_zip(qe, e), lambda p: abs(p[1] - p[2]))), 6)",
    "hamming": ham("qe", "e"),
    "jaccard": f"""(SELECT CASE WHEN u = 0 THEN 0.0 ELSE round(1 - i::DOUBLE / u, 6) END FROM (SELECT
        list_sum(list_transform(list_zip({signs('qe')}, {signs('e')}), lambda p: p[1] & p[2])) AS i,
        list_sum(list_transform(list_zip({signs('qe')}, {signs('e')}), lambda p: p[1] | p[2])) AS u))::DOUBLE""",
}


def ranked(rows: str, k: int = K, order: str = "dist, vec_id", more: str = "dist") -> str:
    """The first k rows of each query of a relation."""
    return f"""SELECT query_id, rank, vec_id, {more} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::BIGINT AS rank FROM {rows}) WHERE rank <= {k}"""


def knn(kind: str) -> str:
    return f"WITH {BASE}, {Q}, d AS (SELECT query_id, vec_id, {DIST[kind]} AS dist FROM q, base) {ranked('d')}"


NEAREST = f"WITH {BASE}, {Q}, d AS (SELECT query_id, vec_id, {DIST['l2']} AS dist FROM q, base) SELECT query_id, vec_id, dist FROM ({ranked('d', 1)})"
#: 160 dimensions: the vector, its reverse moved up, and its first half moved down.
WIDE = """base AS (SELECT vec_id, list_concat(list_concat(e, list_transform(list_reverse(e), lambda x: x + 0.05)), list_transform(e[1:32], lambda x: x - 0.05)) AS e, label
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings))"""


def wide(sql: str) -> str:
    """The same query over vectors of 160 dimensions."""
    return sql.replace(BASE, WIDE)


def word(e: str, w: int) -> str:
    """Word ``w`` of the sign bits as text: 64 dimensions, the first one highest, zeros where there are none."""
    bits = f"list_transform(range({64 * w + 1}, {64 * w + 65}), lambda i: coalesce(({e}[i] > 0)::HUGEINT, 0::HUGEINT))"
    u = f"list_reduce(list_concat([0::HUGEINT], {bits}), lambda s, x: s * 2 + x)"
    return f"(SELECT (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT::VARCHAR FROM (SELECT {u} AS u))"


SIGN_BITS = f"WITH {BASE} SELECT vec_id, {word('e', 0)} AS bits FROM base"
SIGN_BITS_WIDE = wide(f"WITH {BASE} SELECT vec_id, concat_ws(',', {word('e', 0)}, {word('e', 1)}, {word('e', 2)}) AS bits FROM base")


def lexicographic(dims: int = 64) -> str:
    half = dims // 2
    return f"""WITH {BASE}, {Q}, d AS (SELECT query_id, vec_id, {ham(f'qe[1:{half}]', f'e[1:{half}]')} AS h0, {ham(f'qe[{half + 1}:{dims}]', f'e[{half + 1}:{dims}]')} AS h1 FROM q, base)
{ranked('d', K, 'h0, h1, vec_id', 'h0, h1')}"""


def progressive(dims: int = 64) -> str:
    n = dims // 16
    return f"""WITH {BASE}, {Q},
h AS (SELECT query_id, vec_id, list_transform(range(16), lambda s: {ham(f'qe[{n} * s + 1:{n} * s + {n}]', f'e[{n} * s + 1:{n} * s + {n}]')}) AS h FROM q, base),
p AS (SELECT *, coalesce(list_min(list_filter(range(16), lambda s: h[s + 1] > 0)), 16) AS passed FROM h),
z AS (SELECT query_id, s, count(*) FILTER (passed > s) AS z FROM p, range(16) r(s) GROUP BY ALL),
stop AS (SELECT query_id, coalesce(min(s) FILTER (z <= {K}), 15) AS stop FROM z GROUP BY query_id),
d AS (SELECT query_id, vec_id, h[stop + 1] AS dist FROM p JOIN stop USING (query_id) WHERE passed >= stop)
{ranked('d')}"""


RERANK = f"""WITH {BASE}, {Q}, h AS (SELECT query_id, vec_id, {DIST['hamming']} AS dist FROM q, base), c AS ({ranked('h', 5 * K)}),
d AS (SELECT query_id, vec_id, {DIST['l2']} AS dist FROM c JOIN q USING (query_id) JOIN base USING (vec_id)) {ranked('d')}"""
CLUSTERS = f"""{CENTRES}, near AS (SELECT vec_id, cluster_id, round({l2('e', 'ce')}, 6) AS dist FROM base, centres),
clusters AS (SELECT vec_id, cluster_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) AS r FROM near) WHERE r = 1)"""
ASSIGN = f"WITH {BASE}, {CLUSTERS} SELECT * FROM clusters"


def probes(k: int, at_least: int) -> str:
    return f"""sizes AS (SELECT cluster_id, count(v.vec_id) AS members FROM centres LEFT JOIN clusters v USING (cluster_id) GROUP BY cluster_id),
cc AS (SELECT query_id, cluster_id, members, round({l2('qe', 'ce')}, 6) AS cc FROM q, centres JOIN sizes USING (cluster_id)),
placed AS (SELECT *, row_number() OVER w AS place, coalesce(sum(members) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cc WINDOW w AS (PARTITION BY query_id ORDER BY cc, cluster_id)),
chosen AS (SELECT query_id, cluster_id FROM placed WHERE before < {k} OR place <= {at_least})"""


def probe(kind: str) -> str:
    head = f"WITH {BASE}, {Q}, {CLUSTERS}, {probes(3 * K if kind == 'rerank' else K, 3)}"
    rows = f"SELECT query_id, vec_id, {DIST['l2' if kind == 'l2' else 'hamming']} AS dist FROM chosen JOIN clusters USING (cluster_id) JOIN base USING (vec_id) JOIN q USING (query_id)"
    if kind != "rerank":
        return f"{head}, d AS ({rows}) {ranked('d')}"
    return f"""{head}, h AS ({rows}), c AS ({ranked('h', 3 * K)}),
d AS (SELECT query_id, vec_id, {DIST['l2']} AS dist FROM c JOIN q USING (query_id) JOIN base USING (vec_id)) {ranked('d')}"""


PRUNED = f"""WITH {BASE}, {Q}, {CLUSTERS}, {probes(K, 1)},
d AS (SELECT query_id, vec_id, sqrt({l2('qe', 'e')}) AS dist FROM chosen JOIN clusters USING (cluster_id) JOIN base USING (vec_id) JOIN q USING (query_id)),
u AS (SELECT query_id, max(dist) AS u FROM ({ranked('d')}) GROUP BY query_id),
far AS (SELECT query_id, cluster_id, u, sqrt({l2('qe', 'ce')}) AS q_cc FROM q JOIN u USING (query_id), centres)
SELECT query_id, sum((q_cc - sqrt(dist) > u + 1e-5)::BIGINT)::BIGINT AS pruned FROM far JOIN clusters USING (cluster_id) GROUP BY query_id"""
RESCALE = f"""WITH {BASE}, f AS (SELECT avg(1 / s) AS f FROM (SELECT i, stddev_samp(e[i]) AS s FROM base, range(1, 65) r(i) GROUP BY i)),
s AS (SELECT vec_id, list_transform(e, lambda x: x * f) AS e FROM base, f)
SELECT vec_id, round(e[1], 6) AS x0, round(e[2], 6) AS x1, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS norm FROM s"""
GRAM = f"WITH {BASE} SELECT i - 1 AS i, j - 1 AS j, round(sum(e[i] * e[j]), 6) AS g FROM base, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j"
PCA_TOTAL = f"WITH {BASE} SELECT round(sum(list_sum(list_transform(e, lambda x: x * x))), 5) AS total FROM base"
NORMS = f"WITH {BASE} SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS norm_sq FROM base"
EXPLAINED = f"""WITH {BASE}, g AS (SELECT (i - 1) // 8 AS subspace, sum(e[i] * e[i]) AS g FROM base, range(1, 65) a(i) GROUP BY 1),
v AS (SELECT subspace, g / sum(g) OVER () AS var FROM g), c AS (SELECT *, sum(var) OVER (ORDER BY subspace) AS cum FROM v)
SELECT subspace, round(var, 6) AS var, round(cum, 6) AS cum, cum <= 0.9 + 1e-6 OR subspace = 0 AS kept FROM c"""
ALLOCATION = f"""WITH {BASE}, g AS (SELECT (i - 1) // 16 AS s, sum(e[i] * e[i]) AS g FROM base, range(1, 65) a(i) GROUP BY 1),
v AS (SELECT list(var ORDER BY var DESC) AS v FROM (SELECT round(g / sum(g) OVER (), 6) AS var FROM g)),
k AS (SELECT v, list_transform([1, 2, 3], lambda s: CASE WHEN v[s] >= v[s + 1] THEN pow(2, floor(log2(v[s] / v[s + 1])))::INTEGER ELSE 0 END) AS k FROM v),
c AS (SELECT [a, b, c, d] AS x, round(v[1] * a + v[2] * b + v[3] * c + v[4] * d, 10) AS gain FROM k, range(1, 7) t1(a), range(1, 7) t2(b), range(1, 7) t3(c), range(1, 7) t4(d)
  WHERE a + b + c + d = 14 AND a - b <= k[1] AND b - c <= k[2] AND c - d <= k[3]),
best AS (SELECT x FROM c ORDER BY gain DESC, x DESC LIMIT 1)
SELECT s AS subspace, x[s + 1]::BIGINT AS bits FROM best, range(4) r(s)"""
CELLS = "cells AS (SELECT vec_id, (i - 1)::INTEGER AS dim, e[i] AS x FROM base, range(1, 65) r(i))"
THRESHOLDS = f"""{CELLS}, sorted AS (SELECT dim, list(x ORDER BY x) AS xs, count(*) AS n FROM cells GROUP BY dim),
pos AS (SELECT dim, xs, n, q::INTEGER AS q, least(greatest((1 - q / 4.0) * -0.5 + q / 4.0 * (n - 0.5), 0.0), n - 1.0)::DOUBLE AS pos FROM sorted, range(1, 4) r(q)),
thresholds AS (SELECT dim, q, xs[floor(pos)::INTEGER + 1] + (pos - floor(pos)) * (xs[least(floor(pos)::INTEGER + 2, n)] - xs[floor(pos)::INTEGER + 1]) AS value FROM pos)"""
HAZEN = f"WITH {BASE}, {THRESHOLDS} SELECT dim, q, round(value, 6) AS value FROM thresholds"
CODED = "coded AS (SELECT vec_id, cells.dim, x, count(*) FILTER (value < x)::INTEGER AS code FROM cells JOIN thresholds ON cells.dim = thresholds.dim GROUP BY ALL)"
BUCKETS = f"WITH {BASE}, {THRESHOLDS}, {CODED} SELECT vec_id, dim, code FROM coded"
BUCKET_MEANS = f"WITH {BASE}, {THRESHOLDS}, {CODED} SELECT dim, code, round(avg(x), 6) AS centre FROM coded GROUP BY dim, code"
SCALAR_SEARCH = f"""WITH {BASE}, {Q}, {THRESHOLDS}, {CODED}, means AS (SELECT dim, code, avg(x) AS centre FROM coded GROUP BY dim, code),
enc AS (SELECT c.vec_id, c.dim, m.centre, row_number() OVER (PARTITION BY c.vec_id, c.dim ORDER BY round((x - centre) * (x - centre), 9), m.code) AS r FROM cells c JOIN means m ON c.dim = m.dim),
d AS (SELECT query_id, vec_id, round(sum((qe[dim + 1] - centre) * (qe[dim + 1] - centre)), 6) AS dist FROM enc, q WHERE r = 1 GROUP BY ALL) {ranked('d')}"""
PACKED = f"""WITH {BASE}, {THRESHOLDS}, {CODED}, v AS (SELECT vec_id, dim // 32 AS w, sum(code::HUGEINT * (1::HUGEINT << (62 - 2 * (dim % 32)))) AS v FROM coded GROUP BY ALL)
SELECT vec_id, string_agg((v - CASE WHEN v >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT::VARCHAR, ',' ORDER BY w) AS words FROM v GROUP BY vec_id"""

BOOK = "book AS (SELECT (s)::INTEGER AS subspace, vec_id::INTEGER AS code, e[8 * s + 1:8 * s + 8] AS centroid FROM base, range(8) r(s) WHERE vec_id < 16)"
CODES = f"""{BOOK}, enc AS (SELECT vec_id, subspace, code, centroid, row_number() OVER (PARTITION BY vec_id, subspace ORDER BY round({l2('e[8 * subspace + 1:8 * subspace + 8]', 'centroid')}, 9), code) AS r FROM base, book),
codes AS (SELECT vec_id, list(code ORDER BY subspace) AS codes, flatten(list(centroid ORDER BY subspace)) AS dec FROM enc WHERE r = 1 GROUP BY vec_id)"""
LUT = f"""cells_q AS (SELECT query_id, subspace, code, {l2('qe[8 * subspace + 1:8 * subspace + 8]', 'centroid')} AS dist FROM q, book),
tabs AS (SELECT query_id, subspace, list(dist ORDER BY code) AS t FROM cells_q GROUP BY ALL), luts AS (SELECT query_id, list(t ORDER BY subspace) AS lut FROM tabs GROUP BY query_id)"""
ADC_SUM = "list_sum(list_transform(range(1, 9), lambda s: lut[s][codes[s] + 1]))"
ADC_D = f"d AS (SELECT query_id, vec_id, round({ADC_SUM}, 6) AS dist FROM luts, codes)"
PQ_ENCODE = f"WITH {BASE}, {CODES} SELECT vec_id, array_to_string(codes, ',') AS codes FROM codes"
PQ_DECODE = f"WITH {BASE}, {CODES} SELECT vec_id, round({l2('e', 'dec')}, 6) AS error FROM codes JOIN base USING (vec_id)"
PQ_LUT = f"WITH {BASE}, {Q}, {BOOK}, {LUT} SELECT query_id, subspace, code, round(dist, 6) AS dist FROM cells_q"


def adc(root: bool) -> str:
    dist = f"round(sqrt({ADC_SUM}), 6)" if root else f"round({ADC_SUM}, 6)"
    return f"WITH {BASE}, {Q}, {CODES}, {LUT}, d AS (SELECT query_id, vec_id, {dist} AS dist FROM luts, codes) {ranked('d')}"


DECODED = f"""WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM raw WHERE vec_id % 100 = 0),
book AS (SELECT (s)::INTEGER AS subspace, vec_id::INTEGER AS code, e[8 * s + 1:8 * s + 8] AS centroid FROM raw, range(8) r(s) WHERE vec_id < 16),
enc AS (SELECT vec_id, subspace, centroid, row_number() OVER (PARTITION BY vec_id, subspace ORDER BY round({l2('e[8 * subspace + 1:8 * subspace + 8]', 'centroid')}, 9), code) AS r FROM raw, book),
base AS (SELECT vec_id, flatten(list(centroid ORDER BY subspace)) AS e FROM enc WHERE r = 1 GROUP BY vec_id), {CLUSTERS}"""
TI_INDEX = f"""{DECODED}, r AS (SELECT vec_id, cluster_id, round(sqrt(dist), 5) AS cc_dist FROM clusters)
SELECT vec_id, cluster_id, cc_dist, row_number() OVER (PARTITION BY cluster_id ORDER BY cc_dist DESC, vec_id)::BIGINT AS pos_in_cluster FROM r"""
VISIT = f"""{DECODED}, {probes(K, 4)}, d AS (SELECT query_id, vec_id, {DIST['l2']} AS dist FROM chosen JOIN clusters USING (cluster_id) JOIN base USING (vec_id) JOIN q USING (query_id)) {ranked('d')}"""
REFINE = f"""WITH {BASE}, {Q}, {CODES}, {LUT}, {ADC_D}, c AS ({ranked('d', 5 * K)}),
r AS (SELECT query_id, vec_id, {DIST['l2']} AS dist FROM c JOIN q USING (query_id) JOIN base USING (vec_id)) {ranked('r')}"""
ALL_CELLS = f"all_cells AS (SELECT vec_id, subspace, code, {l2('e[8 * subspace + 1:8 * subspace + 8]', 'centroid')} AS dist FROM base, book)"
MODEL = f"""{ALL_CELLS}, alphas AS (SELECT unnest([0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1]::DOUBLE[]) AS alpha),
lows AS (SELECT subspace, alpha, quantile_cont(dist, [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1]) AS ps FROM all_cells, alphas GROUP BY ALL),
los AS (SELECT subspace, alpha, ps[list_position([0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1]::DOUBLE[], alpha)] AS "offset" FROM lows),
ys AS (SELECT c.subspace, alpha, "offset", greatest(dist - "offset", 0) AS y FROM all_cells c JOIN los ON c.subspace = los.subspace),
srt AS (SELECT subspace, alpha, "offset", list(y ORDER BY y) AS l, (1 - alpha) * (count(*) - 1) AS pos FROM ys GROUP BY subspace, alpha, "offset"),
scales AS (SELECT subspace, alpha, "offset", 255 / (l[floor(pos)::INTEGER + 1] + (pos - floor(pos)) * (l[ceil(pos)::INTEGER + 1] - l[floor(pos)::INTEGER + 1])) AS scale FROM srt),
loss AS (SELECT ys.alpha, round(sum(pow(y * scale - least(floor(y * scale), 255), 2)), 3) AS loss FROM ys JOIN scales ON ys.subspace = scales.subspace AND ys.alpha = scales.alpha GROUP BY ys.alpha),
model AS (SELECT * FROM scales WHERE alpha = (SELECT alpha FROM loss ORDER BY loss, alpha DESC LIMIT 1))"""
LEARN = f'WITH {BASE}, {Q}, {BOOK}, {LUT}, {MODEL} SELECT subspace, alpha, round("offset", 6) AS "offset", round(scale, 4) AS scale FROM model'
QUANTIZED = f"""WITH {BASE}, {Q}, {CODES}, {LUT}, {MODEL},
bytes AS (SELECT query_id, c.subspace, list(least(floor(greatest(dist - "offset", 0) * scale), 255) ORDER BY code) AS t FROM cells_q c JOIN model m ON c.subspace = m.subspace GROUP BY ALL),
blut AS (SELECT query_id, list(t ORDER BY subspace) AS lut FROM bytes GROUP BY query_id),
d AS (SELECT query_id, vec_id, least({ADC_SUM}, 32767)::DOUBLE AS dist FROM blut, codes) {ranked('d')}"""

HYBRID = f"""WITH {BASE}, {Q}, {CODES}, {LUT}, {MODEL},
back AS (SELECT query_id, c.subspace, list(CASE WHEN c.subspace < 4 THEN dist ELSE least(floor(greatest(dist - "offset", 0) * scale), 255) / scale + "offset" END ORDER BY code) AS t FROM cells_q c JOIN model m ON c.subspace = m.subspace GROUP BY ALL),
hlut AS (SELECT query_id, list(t ORDER BY subspace) AS lut FROM back GROUP BY query_id), d AS (SELECT query_id, vec_id, round({ADC_SUM}, 6) AS dist FROM hlut, codes) {ranked('d')}"""


def lloyd(points: str, seeds: str, dims: int, rounds: int, tail: str) -> str:
    """Unrolled steps: c<i> are the centres after i steps, a<i> the assignments to them."""
    parts = [f"pts AS ({points})", f"c0 AS ({seeds})"]
    for i in range(rounds):
        parts.append(f"""a{i} AS (SELECT vec_id, e, cluster_id FROM (SELECT vec_id, e, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY round({l2('e', 'ce')}, 9), cluster_id) AS r FROM pts, c{i}) WHERE r = 1)""")
        parts.append(f"""c{i + 1} AS (SELECT cluster_id, coalesce(new, ce) AS ce FROM c{i} LEFT JOIN (SELECT cluster_id, list(x ORDER BY i) AS new FROM (SELECT cluster_id, i, avg(e[i]) AS x FROM a{i}, range(1, {dims + 1}) r(i) GROUP BY ALL) GROUP BY cluster_id) USING (cluster_id))""")
    return f"WITH {BASE}, {', '.join(parts)} {tail}"


LLOYD = lloyd("SELECT vec_id, e FROM base", "SELECT vec_id::INTEGER AS cluster_id, e AS ce FROM base WHERE vec_id < 8", 64, 3,
              "SELECT cluster_id, size, (d - 1)::INTEGER AS dim, round(ce[d], 6) AS x FROM c3 JOIN (SELECT cluster_id, count(*) AS size FROM a2 GROUP BY cluster_id) USING (cluster_id), range(1, 65) t(d)")
ONE_D = lloyd("SELECT vec_id, e[1:1] AS e FROM base", "SELECT (i - 1)::INTEGER AS cluster_id, [[-0.2, -0.05, 0.05, 0.2][i]::DOUBLE] AS ce FROM range(1, 5) r(i)", 1, 3,
              "SELECT cluster_id, count(*) AS size FROM a2 GROUP BY cluster_id")
FARTHEST = f"""WITH {BASE}, s1 AS (SELECT vec_id, e FROM base ORDER BY vec_id LIMIT 1),
""" + ",\n".join(f"s{i} AS (SELECT vec_id, e FROM (SELECT b.vec_id, b.e, " + (f"least({', '.join(f'round({l2('b.e', f's{j}.e')}, 9)' for j in range(1, i))})" if i > 2 else f"round({l2('b.e', 's1.e')}, 9)") + f" AS d FROM base b, {', '.join(f's{j}' for j in range(1, i))}) ORDER BY d DESC, vec_id LIMIT 1)" for i in range(2, 6)) + """
SELECT step, vec_id FROM (""" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS step, vec_id FROM s{i}" for i in range(1, 6)) + ")"


def patterns(least: int) -> str:
    return f"""it AS (SELECT vec_id, 's' || (s - 1) || '_c' || codes[s] AS item FROM codes, range(1, 9) r(s)),
ones AS (SELECT item AS items, count(*) AS freq FROM it GROUP BY item HAVING count(*) >= {least}),
twos AS (SELECT a.item || ',' || b.item AS items, count(*) AS freq FROM it a JOIN it b ON a.vec_id = b.vec_id AND a.item < b.item GROUP BY 1 HAVING count(*) >= {least})"""


PATTERNS = f"WITH {BASE}, {CODES}, {patterns(20)} SELECT * FROM ones UNION ALL SELECT * FROM twos"
ALL_PATTERNS = f"""WITH {BASE}, {CODES}, sets AS (SELECT array_to_string(list_transform(list_filter(range(1, 9), lambda s: (m >> (s - 1)) & 1 = 1), lambda s: 's' || (s - 1) || '_c' || codes[s]), ',') AS items FROM codes, range(1, 256) t(m))
SELECT items, count(*) AS freq FROM sets GROUP BY items HAVING count(*) >= 20"""
MINIMAL = f"WITH {BASE}, {CODES}, {patterns(10)} SELECT items, freq FROM twos ORDER BY freq DESC, items LIMIT 10"


def metric(name: str) -> str:
    head = f"""WITH {BASE}, {Q}, {CODES}, {LUT}, {ADC_D}, res AS ({ranked('d')}), x AS (SELECT query_id, vec_id, {DIST['l2']} AS dist FROM q, base), truth AS ({ranked('x')}),
hit AS (SELECT t.query_id, t.rank AS rb, r.rank AS ra FROM truth t LEFT JOIN res r ON r.query_id = t.query_id AND r.vec_id = t.vec_id)"""
    if name == "recall":
        return f"{head} SELECT 'recall' AS metric, round(avg(n / {K}.0), 6)::DOUBLE AS value FROM (SELECT query_id, count(ra) AS n FROM hit GROUP BY query_id)"
    if name == "recall_at_r":
        return f"{head} SELECT 'recall_at_r' AS metric, round(avg((ra IS NOT NULL)::INTEGER), 6)::DOUBLE AS value FROM hit WHERE rb = 1"
    return f"""{head}, c AS (SELECT a.query_id, a.ra, count(*) AS common FROM hit a JOIN hit b ON a.query_id = b.query_id AND greatest(b.ra, b.rb) <= a.ra WHERE a.ra IS NOT NULL AND b.ra IS NOT NULL GROUP BY ALL),
ap AS (SELECT q.query_id, coalesce(sum(common / ra::DOUBLE), 0) / {K} AS ap FROM q LEFT JOIN c ON q.query_id = c.query_id GROUP BY q.query_id)
SELECT 'map' AS metric, round(avg(ap), 6)::DOUBLE AS value FROM ap"""


CLASSIFY = f"""WITH {BASE}, {Q}, d AS (SELECT query_id, vec_id, {DIST['l2']} AS dist FROM q, base), r AS ({ranked('d')}),
v AS (SELECT nn, query_id, label, count(*) AS n FROM r JOIN base USING (vec_id), (VALUES (1), (5), (10)) t(nn) WHERE rank <= nn GROUP BY ALL),
w AS (SELECT nn, query_id, label, row_number() OVER (PARTITION BY nn, query_id ORDER BY n DESC, label) AS r FROM v)
SELECT nn, round(avg((w.label = base.label)::INTEGER), 6)::DOUBLE AS accuracy FROM w JOIN base ON base.vec_id = w.query_id WHERE r = 1 GROUP BY nn"""
SILHOUETTE = f"""WITH {BASE}, {CLUSTERS}, rows_ AS (SELECT vec_id, cluster_id, e FROM base JOIN clusters USING (vec_id)),
m AS (SELECT a.vec_id, a.cluster_id AS own, b.cluster_id AS other, sum({l2('a.e', 'b.e')}) AS s, count(*) AS n FROM rows_ a, rows_ b GROUP BY ALL),
ab AS (SELECT vec_id, max(n) FILTER (own = other) AS n, max(s / greatest(n - 1, 1)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS score FROM ab"""
APPEND_DELETE = "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM (SELECT vec_id FROM embeddings WHERE vec_id <> 1 UNION ALL VALUES (1000001), (1000002)) t(vec_id)"
RESULT_LINES = f"WITH r AS ({knn('l2')}) SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS ids FROM r GROUP BY query_id"
PAD = f"WITH {BASE} SELECT vec_id, len(list_concat(e, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]))::INTEGER AS n_dims, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM base"
def _word_of(w: int) -> str:
    u = f"('0x' || substr(md5('7:' || vec_id || ':{w}'), 1, 16))::UBIGINT::HUGEINT"
    return f"({u} - CASE WHEN {u} >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT::VARCHAR"


RANDOM_BITS = f"SELECT vec_id, concat_ws(',', {_word_of(0)}, {_word_of(1)}) AS bits FROM embeddings"
SAMPLE = "SELECT vec_id FROM embeddings ORDER BY ('0x' || substr(md5('17:' || vec_id), 1, 12))::BIGINT LIMIT 50"
DRAWN = """WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT id AS draw, id // 25 AS batch, ('0x' || substr(md5('17:' || (id // 25) || ':' || id), 1, 12))::BIGINT AS h FROM range(100) r(id)),
b AS (SELECT draw, h, floor(n * batch / 4.0)::BIGINT AS lo, floor(n * (batch + 1) / 4.0)::BIGINT AS hi FROM d, n)
SELECT draw, lo + h % greatest(hi - lo, 1) AS vec_id FROM b"""


def round_trip(scale: int) -> str:
    value = f"floor(abs(x) * {scale})" if scale else "x"
    return f"WITH {BASE} SELECT vec_id, (i - 1)::INTEGER AS dim, round(list_transform(e, lambda x: {value})[i], 6)::DOUBLE AS x FROM base, range(1, 65) r(i)"


CLUSTER_IDS = f"WITH {BASE}, {CLUSTERS} SELECT vec_id, cluster_id FROM clusters"
CENTROID_LINES = f"WITH {BASE}, {BOOK} SELECT subspace, code, (i - 1)::INTEGER AS dim, round(centroid[i], 6) AS x FROM book, range(1, 9) r(i)"
TEXT_VECTORS = f"WITH {BASE} SELECT vec_id, label::INTEGER AS label, (i - 1)::INTEGER AS dim, round(e[i], 6) AS x FROM base, range(1, 65) r(i)"
FIRST_ROWS = f"WITH {BASE} SELECT vec_id, (i - 1)::INTEGER AS dim, round(e[i], 6) AS x FROM base, range(1, 65) r(i) WHERE vec_id < 100"
DRAWN_RECORDS = f"""WITH {BASE}, n AS (SELECT count(*) AS n FROM base), d AS (SELECT id AS draw, CASE WHEN id < 30 THEN id // 15 ELSE 2 + (id - 30) // 14 END AS batch FROM range(100) r(id)),
h AS (SELECT draw, ('0x' || substr(md5('17:' || batch || ':' || draw), 1, 12))::BIGINT AS h, floor(n * batch / 7.0)::BIGINT AS lo, floor(n * (batch + 1) / 7.0)::BIGINT AS hi FROM d, n)
SELECT draw, vec_id, round(e[1], 6) AS "first", round(e[64], 6) AS "last" FROM h JOIN base ON vec_id = lo + h % greatest(hi - lo, 1)"""
#: Of every nine rows, four have no vector that is finite.
KNN_DIRTY = knn("l2").replace(BASE, BASE.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 9 NOT IN (1, 2, 3, 4)"))
PRUNING = f"SELECT vec_id AS query_id, {K}::BIGINT AS found, true AS spared FROM embeddings WHERE vec_id % 100 = 0"


def widths(bits: list[int]) -> str:
    """Cells with each dimension's quantiles by Hazen's rule, 2**bits - 1 of them."""
    return f"""{CELLS}, widths AS (SELECT unnest(range(64))::INTEGER AS dim, unnest({bits}) AS bits),
sorted AS (SELECT dim, bits, list(x ORDER BY x) AS xs, count(*) AS n FROM cells JOIN widths USING (dim) WHERE bits > 0 GROUP BY dim, bits),
pos AS (SELECT dim, xs, n, q::INTEGER AS q, least(greatest((1 - q / (1 << bits)::DOUBLE) * -0.5 + q / (1 << bits)::DOUBLE * (n - 0.5), 0.0), n - 1.0)::DOUBLE AS pos FROM sorted, range(1, 256) r(q) WHERE q < (1 << bits)),
thresholds AS (SELECT dim, q, xs[floor(pos)::INTEGER + 1] + (pos - floor(pos)) * (xs[least(floor(pos)::INTEGER + 2, n)] - xs[floor(pos)::INTEGER + 1]) AS value FROM pos),
bucketed AS (SELECT vec_id, c.dim, x, count(*) FILTER (value < x)::INTEGER AS code FROM cells c JOIN thresholds t ON c.dim = t.dim GROUP BY ALL)"""


WIDTHS = [3, 2, 1, 0] * 16
LEADING = [3, 2, 1, 2, 4, 1, 2, 3] * 3 + [0] * 40
BUDGET_THRESHOLDS = f"WITH {BASE}, {widths(WIDTHS)} SELECT dim, q, round(value, 6) AS value FROM thresholds"
#: A row's codes as one text of bits, cut into words of 64.
BUDGET_WORDS = f"""WITH {BASE}, {widths(WIDTHS)},
rows_ AS (SELECT vec_id, rpad(string_agg(right(to_binary(8 + code), bits::INTEGER), '' ORDER BY dim), 128, '0') AS s FROM bucketed JOIN widths USING (dim) GROUP BY vec_id),
w AS (SELECT vec_id, i, list_reduce(list_concat([0::HUGEINT], list_transform(range(64 * i + 1, 64 * i + 65), lambda j: (s[j])::HUGEINT)), lambda a, x: a * 2 + x) AS u FROM rows_, range(2) r(i))
SELECT vec_id, string_agg((u - CASE WHEN u >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT::VARCHAR, ',' ORDER BY i) AS words FROM w GROUP BY vec_id"""
BUDGET_NEAR = f"""{widths(LEADING)}, means AS (SELECT dim, code, avg(x) AS m FROM bucketed GROUP BY dim, code),
near AS (SELECT b.vec_id, b.dim, m.code, m.m, row_number() OVER (PARTITION BY b.vec_id, b.dim ORDER BY abs(x - m.m), abs(m.code - b.code), m.code) AS r FROM bucketed b JOIN means m ON b.dim = m.dim AND abs(m.code - b.code) <= 1),
coded AS (SELECT vec_id, dim, code, m FROM near WHERE r = 1)"""
BUDGET_CODES = f"WITH {BASE}, {BUDGET_NEAR} SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY dim) AS codes FROM coded GROUP BY vec_id"
BUDGET_SEARCH = f"WITH {BASE}, {Q}, {BUDGET_NEAR}, d AS (SELECT query_id, vec_id, round(sum((qe[dim + 1] - m) * (qe[dim + 1] - m)), 6) AS dist FROM coded, q GROUP BY ALL) {ranked('d')}"
KMEANS_SAMPLED = lloyd("SELECT vec_id, e FROM base ORDER BY ('0x' || substr(md5('17:' || vec_id), 1, 12))::BIGINT LIMIT 120",
                       "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS cluster_id, e AS ce FROM pts ORDER BY vec_id LIMIT 6", 64, 2,
                       f"SELECT cluster_id, count(*) AS size FROM (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY round({l2('e', 'ce')}, 9), cluster_id) AS r FROM base, c2) WHERE r = 1 GROUP BY cluster_id")
KMEANS_CODES = lloyd("SELECT vec_id, dec AS e FROM codes", "SELECT vec_id::INTEGER AS cluster_id, dec AS ce FROM codes WHERE vec_id < 8", 64, 2,
                     "SELECT cluster_id, count(*) AS size FROM a1 GROUP BY cluster_id").replace("pts AS (", f"{CODES}, pts AS (", 1)
GRID_LINES = "SELECT label::INTEGER AS m, 1::INTEGER AS minbits, 9::INTEGER AS maxbits, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS precision FROM embeddings GROUP BY label"
POWERS = f"WITH {BASE}, {CELLS} SELECT vec_id, dim, CASE WHEN abs(x * 100) >= 1 THEN pow(2, floor(log2(abs(x * 100))))::INTEGER ELSE 0 END AS power FROM cells"
