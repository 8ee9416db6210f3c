"""Bit budgets over dimensions, trees of centres, prefixes, grouped centres, grids and whole models, against plain loops."""

import itertools
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import expr
from vexel.operators import budget, pq, search, selection, training, trees
from vexel.plans import catalog

SF = "/root/testdata/sf0.001"


def frame(spark, x, name="vec_id", vector="e"):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], f"{name} bigint, {vector} array<double>")


def steps_of(v):
    power = 2.0 ** np.floor(np.log2(v[:-1] / v[1:]))
    return np.where(power > 10, 0, np.floor(power)).astype(int)


@pytest.mark.parametrize("seed", range(12))
def test_continuous_allocation_is_optimal(seed, monkeypatch):
    """Not below any mixture of two integer allocations that meets the budget, which the optimum is one of."""
    monkeypatch.setattr(budget, "MOST", 4)
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 5))
    v = np.sort(rng.dirichlet(np.ones(d)))[::-1]
    low, steps = (rng.random(d) < 0.4).astype(int), rng.integers(0, 3, d - 1)
    want = int(rng.integers(1, 4 * d + 1))
    fine = np.array([x for x in itertools.product(range(5), repeat=d) if all(a >= b for a, b in zip(x, low)) and all(x[i] - x[i + 1] <= steps[i] for i in range(d - 1))])
    less, more = fine[fine.sum(axis=1) <= want] if len(fine) else fine, fine[fine.sum(axis=1) >= want] if len(fine) else fine
    if not len(less) or not len(more):
        with pytest.raises(ValueError):
            budget.continuous(v, want, low, steps)
        return
    best = -np.inf
    for a in less:
        for b in more:
            t = 0.0 if b.sum() == a.sum() else (want - a.sum()) / (b.sum() - a.sum())
            best = max(best, v @ (a + t * (b - a)))
    x = budget.continuous(v, want, low, steps)
    assert x.sum() == pytest.approx(want) and (x >= low - 1e-9).all() and (x <= 4 + 1e-9).all() and all(x[i] - x[i + 1] <= steps[i] + 1e-9 for i in range(d - 1))
    assert v @ x == pytest.approx(best)


@pytest.mark.parametrize("bits", [1, 5, 64, 100, 128, 256, 511, 512])
def test_budget_is_met(spark, bits):
    values, _ = training.principal_axes(catalog.base_of(spark, SF))
    for v in (values, np.ones(64), 0.5 ** np.arange(64), np.r_[1.0, np.zeros(63)]):
        got = budget.allocate_dimensions(v, bits)
        assert sum(got) == bits and min(got) >= 0 and max(got) <= 8


@pytest.mark.parametrize("bits", [0, 513])
def test_budgets_that_cannot_be_met(bits):
    with pytest.raises(ValueError):
        budget.allocate_dimensions(np.ones(64), bits)


def test_codes_straddle_words():
    rng = np.random.default_rng(0)
    bits = [5, 0, 8, 7, 1, 8, 8, 8, 8, 8, 8, 3, 8, 8, 8, 8, 8, 8, 8, 6, 5]
    codes = np.stack([rng.integers(0, 1 << b, 50) for b in bits], axis=1)
    words = budget.packed_words(codes, bits)
    for row, got in zip(codes.tolist(), words.tolist()):
        text = "".join(f"{c:0{b}b}" for c, b in zip(row, bits) if b)
        text = text.ljust(-(-len(text) // 64) * 64, "0")
        assert [w % (1 << 64) for w in got] == [int(text[i:i + 64], 2) for i in range(0, len(text), 64)]
    assert budget.packed_words(codes, [0] * len(bits)).shape == (50, 0)


def hazen(x, shares):
    xs, n = np.sort(x), len(x)
    pos = np.clip((1 - np.array(shares)) * -0.5 + np.array(shares) * (n - 0.5), 0, n - 1)
    lo = np.floor(pos).astype(int)
    return xs[lo] + (pos - lo) * (xs[np.minimum(lo + 1, n - 1)] - xs[lo])


@pytest.mark.parametrize("accuracy", [10_000, 60])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=3000), np.zeros(3000), rng.integers(0, 4, 3000), np.exp(rng.normal(size=3000) * 5)], axis=1)
    rows = frame(spark, [*x, None, [np.nan] * 4]).repartition(5)
    shares = [[i / 256 for i in range(1, 256)], [0.25, 0.5], [i / 16 for i in range(1, 16)], []]
    got = selection.quantiles(rows, shares)
    assert all(np.allclose(g, hazen(x[:, d], s)) for d, (g, s) in enumerate(zip(got, shares)))
    assert [len(g) for g in selection.quantiles(rows.limit(0), shares)] == [0, 0, 0, 0]


def test_encoders_after_a_rotation(spark):
    """Base and queries are encoded by the same axes; codes as numpy has them; better than two bits everywhere where variances fall."""
    queries, base = (df.withColumn(c, F.transform(c, lambda v, i: v * F.pow(F.lit(0.9), i))) for df, c in zip(catalog.both(spark, SF), ("qe", "e")))
    x = np.array([r.e for r in base.orderBy("vec_id").collect()])
    values, axes = training.principal_axes(base)
    y = x @ axes
    model = budget.Thresholds.fit(base, 128)
    assert sum(model.bits) == 128
    found = {r.vec_id: r.words for r in model.encode(base).collect()}
    codes = np.stack([np.searchsorted(hazen(y[:, i], [(q + 1) / (1 << b) for q in range((1 << b) - 1)]), y[:, i]) for i, b in enumerate(model.bits)], axis=1)
    close = np.array([any(np.abs(t - y[r, i]).min() < 1e-9 for i, t in enumerate(model.thresholds) if len(t)) for r in range(len(y))])
    want = budget.packed_words(codes, model.bits).tolist()
    assert all(found[i] == want[i] for i in range(len(y)) if not close[i])
    asked = {r.query_id: r.bits for r in model.encode(queries, "qe", "bits").collect()}
    assert all(asked[q] == found[q] for q in asked)
    signs = budget.Signs.fit(base)
    mine = {r.vec_id: r.bits for r in signs.encode(base).collect()}
    assert {r.query_id: r.bits for r in signs.encode(queries, "qe").collect()} == {q: mine[q] for q in asked}

    lut = budget.BucketMeans.fit(base, 128)
    even = budget.BucketMeans.fit(base, bits=[2] * 64)

    def distortion(m):
        out = {r.vec_id: r.codes for r in m.encode(base).collect()}
        back = np.stack([np.array(m.means[d])[[out[i][d] for i in range(len(y))]] for d in range(len(m.means))], axis=1)
        return ((y[:, :back.shape[1]] - back) ** 2).sum() + (y[:, back.shape[1]:] ** 2).sum()

    assert sum(lut.bits) <= 128 and len(even.bits) == 64 and distortion(lut) < distortion(even)
    n = base.count()
    refined = search.reranked(lut.search(queries, lut.encode(base), n), queries, base, 5)
    assert [tuple(r)[:3] for r in refined.orderBy("query_id", "rank").collect()] == [tuple(r)[:3] for r in search.exact(queries, base, 5).orderBy("query_id", "rank").collect()]


def test_nearest_bucket_equals_a_loop():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=400), 2)
    t, m = np.sort(np.round(rng.normal(size=7), 2)), np.sort(np.round(rng.normal(size=8), 2))
    for v, got in zip(x, budget.nearest_bucket(x, t, m)):
        own = int(np.searchsorted(t, v))
        assert got == min((c for c in (own - 1, own, own + 1) if 0 <= c < 8), key=lambda c: (abs(v - m[c]), abs(c - own), c))


def test_means_of_empty_buckets(spark):
    rows = frame(spark, [[0.0], [10.0], [10.0]])
    assert budget.bucket_means(rows, [np.array([2.0, 4.0])])[0].tolist() == [0.0, 3.0, 10.0]


def loop_lloyd(x, k, rounds=25):
    c = x[:k].copy()
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        if np.array_equal(new, c):
            break
        c = new
    return c


def loop_halves(x, bits):
    if bits == 0 or len(x) <= 1:
        return [x.mean(axis=0)]
    two = loop_lloyd(x, 2)
    side = ((x[:, None] - two[None]) ** 2).sum(axis=2).argmin(axis=1)
    if min((side == 0).sum(), (side == 1).sum()) < 2 ** (bits - 1):
        return list(loop_lloyd(x, 2 ** bits))
    return loop_halves(x[side == 0], bits - 1) + loop_halves(x[side == 1], bits - 1)


@pytest.mark.parametrize("rows, bits", [(400, 4), (37, 5), (3, 3), (1, 2), (200, 0)])
def test_trees_equal_loops(spark, rows, bits):
    x = np.random.default_rng(rows).normal(size=(rows, 3))
    points = frame(spark, [*x, None, [np.nan] * 3]).repartition(4)
    assert np.allclose(trees.binary(points, bits), np.array(loop_halves(x, bits)), atol=1e-9)
    top = loop_lloyd(x, min(2 ** min(2, bits), rows))
    near = ((x[:, None] - top[None]) ** 2).sum(axis=2).argmin(axis=1)
    fine = max(1, 2 ** bits // len(top))
    want = np.concatenate([loop_lloyd(x[near == c], fine) if (near == c).any() else top[c:c + 1] for c in range(len(top))])
    assert np.allclose(trees.hierarchical(points, bits, 2), want, atol=1e-9)
    assert trees.binary(points.limit(0), bits).size == 0 == trees.hierarchical(points.limit(0), bits).size


def test_trees_have_a_bound(spark):
    with pytest.raises(ValueError):
        trees.binary(frame(spark, [[1.0]]), 16)


@pytest.mark.parametrize("dims, parts, k", [(16, 16, 3), (16, 4, 1), (70, 5, 4), (6, 2, 50), (130, 2, 2)])
def test_progressive_equals_a_loop(spark, dims, parts, k):
    rng = np.random.default_rng(dims + parts)
    x = rng.normal(size=(120, dims))
    x[40:80] = x[:40]  # rows with the same bits
    x[60:70, dims // 2:] *= -1
    base, queries = frame(spark, x), frame(spark, x[::15], "query_id", "qe")
    edges = [dims * i // parts for i in range(parts + 1)]
    want = []
    for q, v in enumerate(x[::15]):
        h = np.stack([((v[a:b] > 0) != (x[:, a:b] > 0)).sum(axis=1) for a, b in zip(edges, edges[1:])], axis=1)
        passed = np.array([next((s for s in range(parts) if r[s]), parts) for r in h])
        stop = next((s for s in range(parts - 1) if (passed > s).sum() <= k), parts - 1)
        some = sorted((int(h[i, stop]), i) for i in range(len(x)) if passed[i] >= stop)[:k]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(some)]
    found = search.progressive(queries, base, k, parts)
    assert sorted(map(tuple, found.collect())) == want
    # Queries meet rows by a prefix, or, if they stop at once, the values of the first part.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2


def test_reranking_does_not_shuffle_the_base(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        queries, base = catalog.both(spark, SF)
        near = base.filter("vec_id < 40").select("vec_id").crossJoin(queries.select("query_id"))
        found = search.reranked(near, queries, base, 5, 40)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.reranked(near, queries, base, 5).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("k", [1, 7, 300])
def test_grouped_centres_equal_brute_force(k):
    rng = np.random.default_rng(k)
    c, x = np.round(rng.normal(size=(k, 3)), 1), np.round(rng.normal(size=(500, 3)), 1)
    which, d, _ = search.CentreGroups.of(c).nearest(x, 6)
    far = np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 6)
    assert which.tolist() == far.argmin(axis=1).tolist() and np.array_equal(d, far.min(axis=1))


def test_grouped_centres_spare_distances():
    """Of 8,192 centres in clusters, a tenth of the distances, and the same result."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(90, 8)) * 30
    c = np.concatenate([m + rng.normal(size=(92, 8)) for m in middles])[:8192]
    x = c[rng.integers(0, len(c), 2000)] + rng.normal(size=(2000, 8)) * 0.3
    which, d, computed = search.CentreGroups.of(c).nearest(x, 6)
    far = np.concatenate([np.round(((x[a:a + 50, None] - c[None]) ** 2).sum(axis=2), 6) for a in range(0, len(x), 50)])
    assert which.tolist() == far.argmin(axis=1).tolist() and computed <= 0.1 * far.size


def test_farthest_first_over_many_steps(spark, monkeypatch):
    monkeypatch.setattr(training, "WRITTEN_EVERY", 3)
    x = np.round(np.random.default_rng(9).normal(size=(90, 3)), 1)
    found, d = [0], np.full(90, np.inf)
    for _ in range(10):
        d = np.minimum(d, np.round(((x - x[found[-1]]) ** 2).sum(axis=1), 9))
        found.append(int(np.argmax(d)))
    assert training.farthest_first(frame(spark, [*x, None]).repartition(4), 11) == found
    assert training.farthest_first(frame(spark, x).limit(0), 3) == []


def test_minibatch_draws_many_rounds_at_once(spark, monkeypatch):
    points = catalog.base_of(spark, SF).select("vec_id", "e")
    seeds = [r.e for r in points.filter("vec_id < 4").orderBy("vec_id").collect()]
    want = training.minibatch(points, seeds, 20, 6)
    monkeypatch.setattr(training, "HELD_ROWS", 40)
    assert training.minibatch(points, seeds, 20, 6) == want


@pytest.mark.parametrize("text, bits", [("7,7,6", (7, 7, 6)), ("0", (0,)), ("15, 1", (15, 1))])
def test_named_bits(text, bits):
    assert training.parse_bits(text) == bits


@pytest.mark.parametrize("text", ["", "a,1", "16", "-1,2"])
def test_bad_named_bits(text):
    with pytest.raises(ValueError):
        training.parse_bits(text)


@pytest.mark.parametrize("bits, budget_, most, want", [([3, 2, 0, 0], 7, 5, [3, 2, 1, 1]), ([3, 2, 0, 0], 9, 5, [4, 3, 1, 1]), ([5, 5, 5], 15, 5, [5, 5, 5]), ([2, 0, 1], 5, 3, [3, 1, 1]), ([1, 1], 8, 4, [4, 4])])
def test_fix_up(bits, budget_, most, want):
    assert training.filled_up(bits, budget_, most) == want


def test_named_bits_must_meet_the_budget(spark):
    base = catalog.base_of(spark, SF).select("vec_id", "e")
    model = training.Vaq.fit(base, training.VaqParams(20, 8, 1, 6, bits=(4, 4, 4, 2, 2, 2, 1, 1)))
    assert model.bits == [4, 4, 4, 2, 2, 2, 1, 1] and [len(c) for c in model.centroids] == [2 ** b for b in model.bits]
    for bits in ((1,) * 8, (4,) * 5):
        with pytest.raises(ValueError):
            training.Vaq.fit(base, training.VaqParams(20, 8, 1, 6, bits=bits))
    with pytest.raises(ValueError):
        training.filled_up([1, 1], 9, 4)


def test_whole_model_is_exchanged(spark):
    queries, base = catalog.both(spark, SF)
    path = "file://" + tempfile.mkdtemp() + "/m"
    model = training.Vaq.fit(base, training.VaqParams.parse("VAQ16m8min1max4var1,EA_TI8m3"))
    model.save(spark, path, model.encode(base), indexed=True)
    again = training.Vaq.load(spark, path)
    codes, index = again.stored(spark, path)
    assert again.params == model.params and again.bits == model.bits and all(np.array_equal(a, b) for a, b in zip(again.centroids, model.centroids))
    assert {r.vec_id: r.codes for r in codes.collect()} == {r.vec_id: r.codes for r in model.encode(base).collect()}
    rows = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.dist) for r in df.collect())
    want = rows(pq.search(model.tables(queries), codes, 5, "sort"))
    assert rows(again.search(queries, codes, 5, index=index)) == want
    old = training.current_model(path)
    other = training.Vaq.fit(base, training.VaqParams.parse("VAQ8m8min1max4var1,HEAP"))
    other.save(spark, path, other.encode(base))
    assert training.Vaq.load(spark, path).bits == other.bits and training.Vaq.load(spark, path).stored(spark, path)[1] is None
    import os

    assert old not in os.listdir(path.removeprefix("file://")) and len(os.listdir(path.removeprefix("file://"))) == 2


def test_grid_of_several_kinds_equals_single_trials(spark):
    queries, base = catalog.both(spark, SF)
    truth = search.exact(queries, base, 5).cache()
    choices = [training.VaqParams(b, m, 1, 5, clustering=kind) for b, m, kind in ((16, 8, "flat"), (20, 8, "flat"), (12, 4, "flat"), (16, 8, "binary"))] + [training.VaqParams(999, 8, 1, 5)]
    got = training.grid(base, queries, truth, 5, choices)
    assert len(got) == 4 and [r for _, r in got] == sorted((r for _, r in got), reverse=True)
    for p, recall in got:
        model = training.Vaq.fit(base, p)
        hits = pq.search(model.tables(queries), model.encode(base), 5).join(truth, ["query_id", "vec_id"], "left_semi").count()
        assert recall == pytest.approx(hits / truth.count())


def test_prefixes_of_words(spark):
    x = np.random.default_rng(0).normal(size=(1, 130))
    one = search.with_bits(frame(spark, x)).select(F.array(*search.prefixes(F.col("bits"), 130, 4)).alias("p")).first().p
    text = "".join("1" if v > 0 else "0" for v in x[0])
    for (first, n), got in zip(expr.parts_of(130, 4), one):
        s = text[:first + n].ljust(-(-(first + n) // 64) * 64, "0")
        assert [w % (1 << 64) for w in got] == [int(s[i:i + 64], 2) for i in range(0, len(s), 64)]


def test_clusters_of_projected_rows(spark):
    base = catalog.base_of(spark, SF).select("vec_id", "e")
    x = np.array([r.e for r in base.orderBy("vec_id").collect()])
    values, axes = training.principal_axes(base)
    y = x @ axes[:, :8]
    c = loop_lloyd(y, 6, 3)
    assert np.allclose(training.cluster(base, 6, 3, axes=axes[:, :8]), c)
    near = ((y[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert {r.cluster_id: r["size"] for r in catalog.QUERIES["kmeans_projected"](spark, SF).collect()} == {i: int((near == i).sum()) for i in range(6) if (near == i).any()}
    assert np.allclose(training.cluster(base, 4, 2, dims=(16, 8)), loop_lloyd(x[:, 16:24], 4, 2))


def test_grid_keeps_the_best_of_a_task(spark):
    """Each task returns k rows a query and choice, however many batches it reads."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    base = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, e array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        books = {(s, 2): rng.normal(size=(4, 2)) for s in range(2)}
        found = training._scored(base, base.limit(20).selectExpr("vec_id as query_id", "e as qe"), books, 2, [[2, 2]], 5)
        plan = found._jdf.queryExecution().executedPlan()
        assert found.count() == 100
        scans = [n for n in str(plan).splitlines() if "MapInArrow" in n]
        assert len(scans) == 1
        held = search.Best(1, 5)
        for at in range(0, 3000, 500):
            held.add(np.arange(1), rng.random((1, 500)), np.arange(at, at + 500))
        assert sum(b.num_rows for b in held.batch(np.zeros(1, np.int64))) == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
