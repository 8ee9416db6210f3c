"""Vector files in ranges, committed writes, positional samples, search by waves, and vectors that are null or not finite."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import matrices
from vexel.operators import pq, search, selection, ti, training
from vexel.sources import formats, vectors


def frame(spark, x, name="vec_id", vector="e", start=0):
    return spark.createDataFrame([(i + start, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(x)], f"{name} bigint, {vector} array<double>")


def folder():
    return "file://" + tempfile.mkdtemp()


def listed(path):
    return sorted(f for f in os.listdir(path.removeprefix("file://")) if f.startswith("part-"))


@pytest.mark.parametrize("kind", ["fvecs", "bvecs", "ivecs", "f32", "i32"])
def test_every_component_comes_back(spark, kind):
    x = np.random.default_rng(3).integers(0, 256, (500, 7))
    path = folder() + "/v"
    assert formats.write_vectors(frame(spark, x, vector="embedding").repartition(6), path, kind) == 500
    back = formats.read_vectors(spark, path, kind, 7, split_bytes=300)
    assert back.rdd.getNumPartitions() > 8
    rows = back.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(500)) and np.array_equal([r.embedding for r in rows], x)
    assert vectors.row_count(path, kind, 7) == 500


def spoiled_file(rows, good):
    """An fvecs file of ``rows`` records of 4, of which only those in ``good`` tell their dimension right."""
    record = np.zeros(rows, vectors.record_of("fvecs", 4))
    record["dim"], record["v"] = 9, np.arange(rows)[:, None]
    record["dim"][list(good)] = 4
    path = tempfile.mkdtemp() + "/f.fvecs"
    record.tofile(path)
    return "file://" + path


def test_only_what_is_asked_for_is_read(spark):
    path = spoiled_file(1000, range(100, 200))
    with pytest.raises(Exception, match="dimension"):
        formats.read_vectors(spark, path, "fvecs", 4).count()
    some = formats.read_vectors(spark, path, "fvecs", 4).filter("vec_id >= 100 AND vec_id < 200")
    assert sorted((r.vec_id, r.embedding[0]) for r in some.collect()) == [(i, float(i)) for i in range(100, 200)]
    assert formats.read_vectors(spark, path, "fvecs", 4).filter("vec_id = 150 AND embedding[0] > 0").count() == 1
    path = spoiled_file(1000, range(50))
    assert formats.read_vectors(spark, path, "fvecs", 4, limit=50).count() == 50
    assert formats.read_vectors(spark, path, "fvecs", 4, limit=0).count() == 0


def test_a_large_file_is_read_by_many_tasks(spark):
    path = tempfile.mkdtemp() + "/zeros.f32"
    with open(path, "wb") as f:
        f.truncate(400 << 20)  # a sparse file
    rows = formats.read_vectors(spark, "file://" + path, "f32", 1 << 12)
    assert rows.rdd.getNumPartitions() == 7 and rows.count() == (400 << 20) >> 14
    os.remove(path)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_writes_are_committed_at_once(spark, many_parts):
    path, rows = folder() + "/v", frame(spark, np.ones((300, 3)), vector="embedding")
    formats.write_vectors(rows.repartition(5), path, "fvecs")
    assert len(listed(path)) > 1
    before = listed(path)
    with pytest.raises(Exception, match="null"):
        formats.write_vectors(rows.withColumn("embedding", F.when(F.col("vec_id") < 299, F.col("embedding"))), path, "fvecs")
    assert listed(path) == before and formats.read_vectors(spark, path, "fvecs", 3).count() == 300
    assert not [f for f in os.listdir(path.removeprefix("file://")) if f.startswith("_temporary")]
    formats.write_vectors(rows.filter("vec_id < 20").coalesce(1), path, "fvecs")
    assert formats.read_vectors(spark, path, "fvecs", 3).count() == 20 and not set(listed(path)) & set(before)
    vectors.write(rows.limit(0), path, "fvecs", 3)
    assert listed(path) == [] and formats.read_vectors(spark, path, "fvecs", 3).count() == 0


@pytest.mark.parametrize("kind, x, message", [("bvecs", [[256.0]], "fit"), ("bvecs", [[-1.0]], "fit"), ("i32", [[float("nan")]], "fit"), ("fvecs", [[1.0], [1.0, 2.0]], "differ|dimensions")])
def test_what_a_format_cannot_hold(spark, kind, x, message):
    path = folder() + "/v"
    with pytest.raises(Exception, match=message):
        formats.write_vectors(frame(spark, x, vector="embedding").coalesce(1), path, kind)
    assert vectors.manifest(*vectors.located(path)) is None


def test_records_by_position(spark, monkeypatch):
    wanted = [3, 3, 17, 900, 999, 1000, -1]
    path = spoiled_file(1000, {3, 17, 900, 999})
    monkeypatch.setattr(vectors, "NEAR_BYTES", 0)
    positions = spark.createDataFrame([(i, p) for i, p in enumerate(wanted)], "draw bigint, vec_id bigint")
    got = sorted((r.draw, r.vec_id, r.embedding) for r in vectors.read_records(positions, path, "fvecs", 4).collect())
    assert got == [(i, p, [float(p)] * 4) for i, p in enumerate(wanted) if 0 <= p < 1000]


@pytest.mark.parametrize("size, batches", [(10, 4), (3, 4), (100, 7), (1, 1), (0, 3), (50, 50)])
def test_draws_share_out_exactly(spark, size, batches):
    n = 997
    got = [r.vec_id for r in selection.draws(spark, n, size, batches).orderBy("draw").collect()]
    want = [size // batches + (b < size % batches) for b in range(batches)]
    assert len(got) == size
    at = 0
    for b, k in enumerate(want):
        assert all(n * b // batches <= v < max(n * (b + 1) // batches, n * b // batches + 1) for v in got[at:at + k])
        at += k
    assert selection.draws(spark, 0, size, batches).count() == 0


def test_drawn_records_equal_drawn_rows(spark):
    x = np.random.default_rng(1).normal(size=(300, 5)).astype(np.float32)
    path, rows = folder() + "/v", frame(spark, x)
    formats.write_vectors(rows.withColumnRenamed("e", "embedding"), path, "f32")
    key = lambda df, v: sorted((r.draw, r.vec_id, r[v]) for r in df.collect())
    assert key(formats.drawn_records(spark, path, "f32", 5, 41, 6), "embedding") == key(training.drawn(rows, 41, 6), "e")


def brute(x, q, k, root):
    """k nearest of the finite rows, of each finite query."""
    out = []
    fine = [i for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for qi, v in enumerate(q):
        if v is None or not all(c is not None and np.isfinite(c) for c in v):
            continue
        d = [(round(float(np.sqrt(s) if root else s), 6), i) for i in fine for s in [float(((np.array(x[i]) - np.array(v)) ** 2).sum())]]
        out += [(qi, r + 1, i, pytest.approx(s, abs=2e-6)) for r, (s, i) in enumerate(sorted(d)[:k])]
    return out


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.dist) for r in df.collect())


def dirty(rng, n, d):
    x = [list(v) for v in np.round(rng.normal(size=(n, d)), 1)]  # ties
    for i in range(0, n, 7):
        x[i] = None
    for i, bad in ((1, float("nan")), (2, float("inf")), (3, None)):
        for j in range(i, n, 11):
            if x[j] is not None:
                x[j] = [bad, *x[j][1:]]
    return x


@pytest.mark.parametrize("k", [1, 5, 60])
@pytest.mark.parametrize("part", [None, 2])
def test_waves_equal_brute_force(spark, monkeypatch, k, part):
    monkeypatch.setattr(ti, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(k)
    x, q = dirty(rng, 230, 4), dirty(rng, 25, 4)
    centres = np.vstack([rng.normal(size=(9, part or 4)), np.full((1, part or 4), 50.0)])  # the last cluster is empty
    index = ti.index_vectors(frame(spark, x).repartition(3), centres, folder() + "/i", part)
    n = sum(v is not None and all(c is not None and np.isfinite(c) for c in v) for v in x)
    assert index.members.sum() == n and index.members[-1] == 0
    for root in (True, False):
        found, touched = ti.search(index, frame(spark, q, "query_id", "qe"), k, root=root)
        assert rows_of(found) == brute(x, q, k, root)
        assert all(0 < r.touched <= n for r in touched.collect())


def test_results_of_many_queries_leave_the_driver(spark, monkeypatch):
    monkeypatch.setattr(ti, "STATE", 20)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(60, 3)), rng.normal(size=(23, 3))
    index = ti.index_vectors(frame(spark, x), x[:4], folder() + "/i")
    found, touched = ti.search(index, frame(spark, q, "query_id", "qe"), 5)
    assert rows_of(found) == brute(x.tolist(), q.tolist(), 5, True) and touched.count() == 23


def test_waves_spare_rows_of_separate_clusters(spark, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 6)) * 20
    x = np.concatenate([c + rng.normal(size=(60, 6)) for c in centres])
    index = ti.index_vectors(frame(spark, x), centres, folder() + "/i")
    found, touched = ti.search(index, frame(spark, x[::60], "query_id", "qe"), 5)
    assert rows_of(found) == brute(x.tolist(), x[::60].tolist(), 5, True)
    assert max(r.touched for r in touched.collect()) <= 60


@pytest.mark.parametrize("segments", [None, 1])
@pytest.mark.parametrize("visit", [1.0, 0.4])
def test_waves_over_codes(spark, segments, visit):
    rng = np.random.default_rng(8)
    book = [rng.normal(size=(8, 3)), rng.normal(size=(16, 2)), rng.normal(size=(2, 2))]
    codes = np.stack([rng.integers(0, len(b), 200) for b in book], axis=1)
    x = np.concatenate([b[codes[:, s]] for s, b in enumerate(book)], axis=1)
    width = 7 if segments is None else 3
    centres = x[:6, :width]
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)] + [(999, None)], "vec_id bigint, codes array<int>")
    index = ti.index_codes(rows, book, centres, folder() + "/i", segments)
    q = rng.normal(size=(12, 7))
    found, touched = ti.search(index, frame(spark, q, "query_id", "qe"), 9, visit)
    own = np.round(((x[:, None, :width] - centres[None]) ** 2).sum(axis=2), 6).argmin(axis=1)
    want = []
    for i, v in enumerate(q):
        order = np.argsort(np.round(((v[None, :width] - centres) ** 2).sum(axis=1), 6), kind="stable")
        members = np.array([(own == c).sum() for c in order])
        kept = [c for p, c in enumerate(order) if members[:p].sum() < 9 or p < (6 if visit == 1 else 2)]
        some = [list(r) if o in kept else None for r, o in zip(x, own)]
        want += [(i, *r[1:]) for r in brute(some, [v], 9, True)]
    assert rows_of(found) == want and {r.vec_id: r.cluster_id for r in index.rows(spark).collect()} == dict(enumerate(own.tolist()))
    assert "decode" not in index.blocks(spark)._jdf.queryExecution().toString()


def test_waves_without_rows_or_queries(spark):
    base, q = frame(spark, [[1.0, 2.0]]), frame(spark, [[0.0, 0.0]], "query_id", "qe")
    index = ti.index_vectors(base, np.array([[0.0, 0.0]]), folder() + "/i")
    assert rows_of(ti.search(index, q, 3)[0]) == [(0, 1, 0, pytest.approx(5 ** 0.5, abs=1e-6))]
    assert ti.search(index, q.limit(0), 3)[0].count() == 0
    empty = ti.index_vectors(base.limit(0), np.array([[0.0, 0.0]]), folder() + "/i")
    assert ti.search(empty, q, 3)[0].count() == 0


@pytest.mark.parametrize("rows", [3, 200])
def test_exact_leaves_out_what_is_not_finite(spark, rows):
    rng = np.random.default_rng(rows)
    x = [[1.0, 2.0], [float("nan"), 1.0], None] if rows == 3 else dirty(rng, rows, 4)
    q = [[0.0] * len(x[0] or x[1]), None] if rows == 3 else dirty(rng, 20, 4)
    for parts in (1, 5):
        base, queries = frame(spark, x).repartition(parts), frame(spark, q, "query_id", "qe")
        assert rows_of(search.exact(queries, base, 3)) == brute(x, q, 3, False)
        if rows == 3:
            assert rows_of(search.distance_join(queries, base, F.expr("aggregate(zip_with(e, qe, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)"), 3)) == brute(x, q, 3, False)
    one = {r.query_id: r.vec_id for r in search.nearest_one(queries, base).collect()}
    assert one == {qi: i for qi, r, i, _ in brute(x, q, 1, False)}


@pytest.mark.parametrize("dims", [3, 64, 150])
def test_scans_equal_joins(spark, dims):
    """Over numpy and over Spark's columns, on finite vectors with ties; halves of the seventh digit are rounded up in both."""
    from vexel.functions import expr

    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(size=(90, dims)), 1)
    x[40:60] = x[:20]
    x[89] = -1
    base, queries = frame(spark, x).repartition(3), frame(spark, [*x[::10], x[89]], "query_id", "qe")
    a, b = search.with_bits(queries, "qe", "qbits"), search.with_bits(base)
    l2 = expr.l2sq(F.col("qe"), F.col("e"))
    for scan, left, right, dist in ((search.euclidean, queries, base, F.round(F.sqrt(l2), 6)), (search.manhattan, queries, base, F.round(expr.l1(F.col("qe"), F.col("e")), 6)),
                                    (search.hamming, a, b, expr.hamming(F.col("bits"), F.col("qbits"))), (search.jaccard, a, b, F.round(expr.jaccard(F.col("bits"), F.col("qbits")), 6))):
        assert rows_of(scan(queries, base, 7)) == rows_of(search.distance_join(left, right, dist, 7)), scan.__name__


def test_training_leaves_out_what_is_not_finite(spark):
    x = dirty(np.random.default_rng(2), 150, 4)
    fine = np.array([v for v in x if v is not None and all(c is not None and np.isfinite(c) for c in v)])
    base = frame(spark, x).repartition(4)
    g = np.zeros((4, 4))
    for r in training.gram(base).collect():
        g[r.i, r.j] = r.g
    assert np.allclose(g, fine.T @ fine)
    seeds = fine[:3].tolist()
    near = ((fine[:, None] - np.array(seeds)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(training.lloyd(base, seeds, 1), [fine[near == c].mean(axis=0) for c in range(3)])
    values, axes = training.principal_axes(base)
    turned = {r.vec_id: r.e for r in training.projected(base, "e", axes).collect()}
    assert all((turned[i] is None) == (v is None) for i, v in enumerate(x)) and all(np.isfinite(v).all() for v in turned.values() if v)
    assert search.assigned(base, frame(spark, seeds, "cluster_id", "ce").withColumn("cluster_id", F.col("cluster_id").cast("int"))).count() >= len(fine)
    book = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 1.0]), (1, 0, [0.0, 0.0])], "subspace int, code int, centroid array<double>")
    assert {r.vec_id for r in pq.encode(base, book).filter("codes is null").collect()} == {i for i, v in enumerate(x) if v is None}


def test_vectors_of_several_lengths_are_an_error(spark):
    base = frame(spark, [[1.0], [1.0, 2.0]]).coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        training.gram(base).collect()
    with pytest.raises(Exception, match="differ in length"):
        search.exact(frame(spark, [[1.0]], "query_id", "qe"), base, 1).collect()


def test_matrices_of_slices():
    import pyarrow as pa

    column = pa.array([[9.0, 9.0], [1.0, None], None, [3.0, 4.0]], pa.list_(pa.float64())).slice(1)
    x, known = matrices.matrix(column)
    assert known.tolist() == [True, False, True] and np.array_equal(x, [[1.0, np.nan], [0.0, 0.0], [3.0, 4.0]], equal_nan=True)
    x, at = matrices.finite(column)
    assert x.tolist() == [[3.0, 4.0]] and at.tolist() == [2]
    assert matrices.lists(np.zeros((2, 0))).to_pylist() == [[], []]
