import itertools
import tempfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import expr
from vexel.operators import evaluation, pq, scalar, search, selection, training
from vexel.plans import catalog
from vexel.sources import formats
from vexel.streaming import search as streams

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, d", [(0, 0x1, 1), (0, 0xF, 4), (0, 0x3, 2), (0, 0x7, 3), (0, 0x1E, 4), (0, 0xFF, 8), (0, 0xFFFF, 16), (0, (1 << 64) - 1, 64), (5, 5, 0)])
def test_hamming(spark, a, b, d):
    x, y = (F.array(F.lit(signed(v)).cast("bigint")) for v in (a, b))
    assert value(spark, expr.hamming(x, y)) == value(spark, expr.hamming(y, x)) == d


@pytest.mark.parametrize("a, b, d", [(0, 0, 0), (0, 1, 1), (1, 3, 0.5), (1, 7, 2 / 3), (0x11, 0x03, 2 / 3), (0x11, 0xFF, 6 / 8)])
def test_jaccard(spark, a, b, d):
    assert value(spark, expr.jaccard(*(F.array(F.lit(x).cast("bigint")) for x in (a, b)))) == pytest.approx(d)


@pytest.mark.parametrize("x, p", [(0.0, 0), (0.7, 0), (1.0, 1), (3.9, 2), (-9.0, 8)])
def test_prev_pow2(spark, x, p):
    assert value(spark, expr.prev_pow2(F.lit(x))) == p


def bit_knn(spark, rows, query, k):
    base = spark.createDataFrame([(i, [signed(b)]) for i, b in enumerate(rows)], "vec_id bigint, bits array<bigint>")
    q = spark.createDataFrame([(0, [signed(query)])], "query_id bigint, qbits array<bigint>")
    return [r.vec_id for r in search.distance_join(q, base, expr.hamming(F.col("bits"), F.col("qbits")), k).orderBy("rank").collect()]


def test_known_bit_neighbours(spark):
    assert bit_knn(spark, [0x6B8B4567, 0x643C9869, 0xFFFFFFF0, 0xF0000000, 0x0000000F], 0x643C9869, 3) == [1, 3, 4]
    assert bit_knn(spark, [0x327B23C66B8B4567, 0x19495CFF74B0DC51, 0xFFFFFFF0FFFFFFFF, 0x00000000F0000000, 0xF], 0x19495CFF74B0DC51, 3) == [1, 3, 2]
    assert bit_knn(spark, [1, 1, 1, 0, 0], 1, 3) == [0, 1, 2]


def from_words(words):
    """A vector whose sign bits are these words, the first word's highest bit first."""
    return [1.0 if (w >> (63 - i)) & 1 else -1.0 for w in words for i in range(64)]


def vectors(spark, rows, name="vec_id", vector="e"):
    return spark.createDataFrame([(i, from_words(r)) for i, r in enumerate(rows)], f"{name} bigint, {vector} array<double>")


def test_bit_vectors_of_several_words(spark):
    rows, q = [(0, 1, 3, 7), (1, 1, 3, 7)], [(1, 1, 3, 7)]
    base, queries = vectors(spark, rows), vectors(spark, q, "query_id", "qe")
    assert [(r.vec_id, r.dist) for r in search.hamming(queries, base, 2).orderBy("rank").collect()] == [(1, 0), (0, 1)]
    assert [r.vec_id for r in search.progressive(queries, base, 1, 4).collect()] == [1]
    assert [(r.vec_id, r.h0) for r in search.lexicographic(queries, base, 2, 1).orderBy("rank").collect()] == [(1, 0), (0, 1)]
    rows = [(1, 1, 3, 7, w, 1, 3, 7) for w in (0, 1, 2, 1)]
    found = search.lexicographic(vectors(spark, [rows[1]], "query_id", "qe"), vectors(spark, rows), 4, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.h0, r.h1) for r in found] == [(1, 0, 0), (3, 0, 0), (0, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("dims", [1, 63, 64, 65, 128, 200])
def test_hamming_of_any_length(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(30, dims))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, e array<double>")
    queries = base.filter("vec_id < 3").selectExpr("vec_id AS query_id", "e AS qe")
    far = ((x[:3, None] > 0) != (x[None] > 0)).sum(axis=2)
    want = [(q, r + 1, i, int(far[q, i])) for q in range(3) for r, i in enumerate(np.lexsort((np.arange(30), far[q]))[:7].tolist())]
    assert sorted(tuple(r) for r in search.hamming(queries, base, 7).collect()) == want
    parts = min(dims, 5)
    edges = [dims * i // parts for i in range(parts + 1)]
    h = np.stack([((x[:3, None, a:b] > 0) != (x[None, :, a:b] > 0)).sum(axis=2) for a, b in zip(edges, edges[1:])], axis=2)
    want = [(q, r + 1, i) for q in range(3) for r, i in enumerate(sorted(range(30), key=lambda i: (*h[q, i].tolist(), i))[:7])]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in search.lexicographic(queries, base, 7, parts).collect()) == want


@pytest.mark.parametrize("share, kept", [(0.1, 1), (0.5, 1), (0.75, 2), (0.9, 3), (0.97, 4), (1.0, 5)])
def test_retained(share, kept):
    var, high = np.array([0.4, 0.3, 0.15, 0.1, 0.05]), 0
    for i, cum in enumerate(np.cumsum(var)):
        if cum <= share:
            high = i
    assert training.retained(var, share) == kept == (high + 1 if share < 1 else 5)


def test_budget_goes_to_kept_subspaces(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 20)) * np.repeat([8, 6, 4, 2, 1], 4)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, e array<double>")
    model = training.Vaq.fit(base, training.VaqParams.parse("VAQ9m5min1max5var0.9,HEAP"))
    assert len(model.bits) == len(model.centroids) < 5 and sum(model.bits) == 9


@pytest.mark.parametrize("accuracy", [10_000, 12])
def test_order_statistics(spark, monkeypatch, accuracy):
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    rng = np.random.default_rng(5)
    x = {0: rng.normal(size=4000), 1: np.r_[np.zeros(2000), rng.integers(-3, 4, 3000)], 2: np.array([5.0])}
    rows = spark.createDataFrame([(d, float(v)) for d, vs in x.items() for v in vs], "dim int, x double")
    ranks = [(d, int(r), len(vs)) for d, vs in x.items() for r in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1}]
    got = {(r.dim, r["rank"]): (r.value, r.upto) for r in selection.order_statistics(rows, spark.createDataFrame(ranks, "dim int, rank bigint, n bigint")).collect()}
    assert got == {(d, r): (np.sort(x[d])[r], (x[d] <= np.sort(x[d])[r]).sum()) for d, r, _ in ranks}


def test_samples(spark):
    rows = spark.range(5000).withColumnRenamed("id", "vec_id")
    few = [r.vec_id for r in training.sampled(rows, 700).collect()]
    assert len(few) == len(set(few)) == 700 and sorted(few) == sorted(r.vec_id for r in training.sampled(rows.repartition(5), 700).collect())
    assert training.sampled(rows.filter("vec_id < 10").unionByName(rows.filter("vec_id < 10")), 15).count() <= 15
    drawn = [r.vec_id for r in training.drawn(rows, 4000, 4).orderBy("draw").collect()]
    assert len(drawn) == 4000 and len(set(drawn)) < 4000 and all(1250 * (i // 1000) <= v < 1250 * (i // 1000 + 1) for i, v in enumerate(drawn))


@pytest.mark.parametrize("seed", range(30))
def test_allocation_is_optimal(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(3, 5))
    var = np.sort(rng.dirichlet(np.ones(m)))[::-1]
    budget, most = int(rng.integers(m, 4 * m)), 5
    step = [2 ** int(np.floor(np.log2(var[s] / var[s + 1]))) for s in range(m - 1)]
    fine = [x for x in itertools.product(range(1, most + 1), repeat=m) if sum(x) == budget and all(x[s] - x[s + 1] <= step[s] for s in range(m - 1))]
    if not fine:
        with pytest.raises(ValueError):
            training.allocate(var, budget, 1, most)
        return
    best = max(np.dot(var, x) for x in fine)
    got = training.allocate(var, budget, 1, most)
    assert tuple(got) in fine and np.dot(var, got) == pytest.approx(best)


def test_staircase_allocation():
    flat = np.linspace(1.01, 1.0, 8) / 8.04
    assert training.allocate(flat, 32, 2, 6) == [6, 6, 5, 4, 4, 3, 2, 2]


@pytest.mark.parametrize("text, strategy", [("VAQ32m8min2max6var1,HEAP", "HEAP"), ("VAQ32m8min2max6var0.9", "HEAP"), ("vaq64m16min1max8var1,ea_ti100m4", "TI"), ("VAQ32m8min2max6var1,SORT_FAST2", "FAST2"), ("VAQ32m8min2max6var1,EA_HEAP", "EA")])
def test_method_strings(text, strategy):
    assert training.VaqParams.parse(text).strategy == strategy


@pytest.mark.parametrize("text", ["", "PQ32", "VAQ32m8min2max6", "VAQ32m8min2max6var1,QUICK", "VAQ32m8min2max20var1"])
def test_bad_method_strings(text):
    with pytest.raises(ValueError):
        training.VaqParams.parse(text)


def test_balanced_is_a_descending_permutation():
    values = np.sort(np.random.default_rng(2).random(24))[::-1]
    order = training.balanced(values, 4)
    sums = values[order].reshape(4, 6).sum(axis=1)
    assert sorted(order) == list(range(24)) and (np.diff(sums) <= 1e-12).all()


def test_trained_quantizer(spark):
    queries, base = catalog.both(spark, SF)
    model = training.Vaq.fit(base, training.VaqParams.parse("VAQ32m8min2max6var1,HEAP"))
    assert sum(model.bits) == 32 and all(2 <= b <= 6 for b in model.bits)
    folder = "file://" + tempfile.mkdtemp()
    model.save(spark, folder)
    again = training.Vaq.load(spark, folder)
    assert again.bits == model.bits and np.allclose(again.axes, model.axes)
    codes = model.encode(base).cache()
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    luts = model.tables(queries).cache()
    heap = key(pq.search(luts, codes, 10))
    assert heap == key(pq.search(luts, codes, 10, "ea")) == key(pq.search(luts, codes, 10, "fast2")) == key(pq.search(luts, codes, 10, "sort"))
    ti = training.Vaq(replace(model.params, strategy="TI", clusters=8), model.axes, model.variances, model.bits, model.centroids)
    index = ti.index(codes, catalog._scratch(spark))
    assert heap == key(ti.search(queries, codes, 10, index=index)) and len(key(ti.search(queries, codes, 10, visit=0.25, index=index))) == len(heap)
    truth = search.exact(queries, base, 10).cache()
    n = base.count()
    assert key(search.reranked(pq.search(luts, codes, n), queries, base, 10)) == key(truth)
    found = [evaluation.recall(search.reranked(pq.search(luts, codes, r), queries, base, 10), truth, 10).first().value for r in (10, 50, 200)]
    assert found == sorted(found) and found[0] > 0.2
    decoded = pq.decode(codes, model.codebook(spark))
    assert pq.encode(decoded, model.codebook(spark)).join(codes.withColumnRenamed("codes", "c"), "vec_id").filter("codes <> c").count() == 0


def test_rotation_keeps_distances(spark):
    base = catalog.base_of(spark, SF).select("vec_id", "e")
    values, axes = training.principal_axes(base)
    x = np.array([r.e for r in base.orderBy("vec_id").collect()])
    y = np.array([r.e for r in training.projected(base, "e", axes).orderBy("vec_id").collect()])
    assert values.sum() == pytest.approx((x ** 2).sum()) and np.allclose(x[0] @ x[1], y[0] @ y[1]) and np.allclose((y ** 2).sum(axis=0), values)


def test_hazen_on_ties(spark):
    rows = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate([3, 1, 2, 2, 5])], "vec_id bigint, dim int, x double")
    got = {r.q: r.value for r in scalar.hazen_thresholds(rows, 3).collect()}
    assert got == {1: pytest.approx(1.75), 2: 2.0, 3: pytest.approx(3.5)}


def test_metrics_on_a_known_case(spark):
    rows = lambda ids: spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(ids)], "query_id bigint, rank bigint, vec_id bigint")
    a, b = rows([1, 9, 2]), rows([1, 2, 3])
    assert evaluation.recall(a, b, 3).first().value == pytest.approx(2 / 3, abs=1e-6)
    assert evaluation.recall_at_r(a, b, 3).first().value == 1.0
    assert evaluation.mean_average_precision(a, b, 3).first().value == pytest.approx((1 + 2 / 3) / 3, abs=1e-6)


def test_files(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/v.csv", "w") as f:
        f.write("2,1.5,2.5\n1,-1,0\n")
    got = formats.read_text_vectors(spark, f"file://{folder}/v.csv", 2, label_first=True).orderBy("vec_id").collect()
    assert [(r.vec_id, r.label, r.embedding) for r in got] == [(0, 2, [1.5, 2.5]), (1, 1, [-1.0, 0.0])]
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(7)], "vec_id bigint, embedding array<double>")
    assert formats.write_vectors(rows, f"file://{folder}/f", "fvecs") == 7
    back = formats.read_vectors(spark, f"file://{folder}/f", "fvecs", 3, limit=5).orderBy("vec_id").collect()
    assert [(r.vec_id, r.embedding[0]) for r in back] == [(i, float(i)) for i in range(5)]
    with pytest.raises(Exception, match="dimension|multiple"):
        formats.read_vectors(spark, f"file://{folder}/f", "fvecs", 4).count()


def test_grid_file(spark):
    folder = "file://" + tempfile.mkdtemp() + "/grid"
    rows = [(32, 1, 9, 0.5), (32, 2, 9, 0.75)]
    formats.write_grid(spark.createDataFrame(rows, "m int, minbits int, maxbits int, precision double"), folder)
    assert [tuple(r) for r in formats.read_grid(spark, folder).collect()] == rows[::-1]


def test_streams(spark):
    queries, base = catalog.both(spark, SF)
    model = training.Vaq.fit(base, training.VaqParams.parse("VAQ16m8min1max4var1,HEAP"))
    folder = "file://" + tempfile.mkdtemp()
    base.write.parquet(f"{folder}/base")
    queries.write.parquet(f"{folder}/queries")
    streams.append(spark.readStream.schema(base.schema).parquet(f"{folder}/base"), model, f"{folder}/codes", f"{folder}/c1").awaitTermination()
    codes = spark.read.parquet(f"{folder}/codes")
    streams.answer(spark.readStream.schema(queries.schema).parquet(f"{folder}/queries"), model, codes, 5, f"{folder}/out", f"{folder}/c2", base, 50).awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 5 * queries.count()
    by_ti = training.Vaq(replace(model.params, strategy="TI", clusters=4), model.axes, model.variances, model.bits, model.centroids)
    streams.answer(spark.readStream.schema(queries.schema).parquet(f"{folder}/queries"), by_ti, codes, 5, f"{folder}/out2", f"{folder}/c3", index=by_ti.index(codes, f"{folder}/index")).awaitTermination()
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    assert key(spark.read.parquet(f"{folder}/out2")) == key(pq.search(model.tables(queries), codes, 5))


def test_empty_base(spark):
    queries, base = catalog.both(spark, SF)
    assert search.exact(queries, base.limit(0), 5).count() == 0
    assert search.exact(queries.limit(0), base, 5).count() == 0


def test_tasks_keep_the_best_of_all_their_batches(spark):
    """Many queries over many batches: a task returns k rows a query, not k a batch, and the rows are those of brute force, ties included."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (5000, 6)) / 4
    base = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, e array<double>").coalesce(1).sortWithinPartitions("vec_id")
    queries = base.filter("vec_id % 16 = 0").selectExpr("vec_id as query_id", "e as qe")
    d = ((x[::16, None] - x[None]) ** 2).sum(axis=2)
    want = {(16 * q, int(i)) for q in range(len(d)) for i in np.lexsort((np.arange(5000), d[q]))[:7]}
    assert {(r.query_id, r.vec_id) for r in search.exact(queries, base, 7).collect()} == want
    best = search.Best(2, 3)
    for at in range(0, 90, 3):
        best.add(np.arange(2), np.array([[at + 1.0, at, at + 2], [-at, -at - 1.0, -at - 2]]), np.arange(at, at + 3))
    (out,) = best.batch(np.array([10, 20]))
    assert out.to_pydict() == {"query_id": [10] * 3 + [20] * 3, "vec_id": [1, 0, 2, 89, 88, 87], "dist": [0.0, 1.0, 2.0, -89.0, -88.0, -87.0]}


def test_probed_scans_equal_the_join(spark):
    """Scans of each query's clusters give the rows of the join by clusters; thresholds of vectors are those of their components."""
    base = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).filter("vec_id < 300")
    queries = base.filter("vec_id < 40").selectExpr("vec_id as query_id", "e as qe").unionByName(spark.createDataFrame([(1000, None)], "query_id bigint, qe array<double>"))
    centres = base.filter("vec_id < 9").selectExpr("cast(vec_id as int) as cluster_id", "e as ce")
    clusters = search.assigned(base, centres)
    chosen = search.probes(queries.filter("qe is not null"), centres, clusters, 5, 2)
    want = search.probed(queries, clusters, chosen, lambda: expr.hamming(expr.sign_bits(F.col("qe")), expr.sign_bits(F.col("e"))), 5)
    assert sorted(map(tuple, search.probed_hamming(queries, clusters, chosen, 5).collect())) == sorted(map(tuple, want.collect()))
    want = search.probed(queries, clusters, chosen, lambda: F.round(expr.l2sq(F.col("qe"), F.col("e")), 6), 5)
    assert sorted(map(tuple, search.probed_exact(queries, clusters, chosen, 5).collect())) == sorted(map(tuple, want.collect()))
    cut = lambda df: sorted((r.dim, r.q, round(r.value, 12)) for r in df.collect())
    assert cut(scalar.vector_thresholds(base, 64, 3)) == cut(scalar.hazen_thresholds(scalar.cells(base), 3))
