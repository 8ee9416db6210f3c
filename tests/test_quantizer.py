"""The queries that SQL doesn't express, against numpy: each test fails if a value changes."""

import hashlib

import numpy as np
import pytest
from checks import SF

from vexel.operators import pq, search, ti, training
from vexel.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    found = catalog.base_of(spark, SF).orderBy("vec_id").collect()
    return np.array([r.vec_id for r in found]), np.array([r.e for r in found])


def key(seed, i):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16)


def least(ids, seed, size):
    return sorted(sorted(range(len(ids)), key=lambda i: key(seed, ids[i]))[:size])


def sizes(x, centres, digits=6):
    d = np.round(((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2), digits)
    return {c: n for c, n in enumerate(np.bincount(d.argmin(axis=1), minlength=len(centres)).tolist()) if n}


def loop_lloyd(x, k, rounds=25):
    centres = [v.copy() for v in x[:k]]
    for _ in range(rounds):
        near = [min(range(len(centres)), key=lambda c: (round(float(((v - centres[c]) ** 2).sum()), 12), c)) for v in x]
        new = [x[[n == c for n in near]].mean(axis=0) if c in near else centres[c] for c in range(len(centres))]
        if all(np.allclose(a, b, atol=1e-15) for a, b in zip(new, centres)):
            break
        centres = new
    return np.array(centres)


def test_minibatch(spark, rows):
    ids, x = rows
    centres, seen = x[:8].copy(), np.zeros(8)
    for r in range(5):
        before = centres.copy()
        for i in least(ids, r, 100):
            c = int(np.round(((x[i] - before) ** 2).sum(axis=1), 9).argmin())
            seen[c] += 1
            centres[c] += (x[i] - centres[c]) / seen[c]
    assert {r.cluster_id: r["size"] for r in catalog.QUERIES["kmeans_minibatch"](spark, SF).collect()} == sizes(x, centres)
    base = catalog.base_of(spark, SF)
    seeds = x[:8].tolist()
    assert training.minibatch(base, seeds, 100, 3, tolerance=1e9) == training.minibatch(base, seeds, 100, 1)


def test_trees(spark, rows):
    _, x = rows
    top = loop_lloyd(x, 8)
    near = ((x[:, None] - top[None]) ** 2).sum(axis=2).argmin(axis=1)
    want = np.concatenate([loop_lloyd(x[near == c], 4) if (near == c).any() else top[c:c + 1] for c in range(8)])
    assert np.allclose(training.hierarchical(x, 5, 3), want)
    assert {r.cluster_id: r["size"] for r in catalog.QUERIES["hierarchical_kmeans"](spark, SF).collect()} == sizes(x, want)

    def halves(part, bits):
        if bits == 0 or len(part) <= 1:
            return [part.mean(axis=0)]
        two = loop_lloyd(part, 2)
        side = ((part[:, None] - two[None]) ** 2).sum(axis=2).argmin(axis=1) if len(two) == 2 else np.zeros(len(part), int)
        if min((side == 0).sum(), (side == 1).sum()) < 2 ** (bits - 1):
            return list(loop_lloyd(part, 2 ** bits))
        return halves(part[side == 0], bits - 1) + halves(part[side == 1], bits - 1)

    want = np.array(halves(x, 5))
    assert np.allclose(training.binary(x, 5), want)
    assert {r.cluster_id: r["size"] for r in catalog.QUERIES["binary_kmeans"](spark, SF).collect()} == sizes(x, want)


def test_blocks_of_nearest(monkeypatch):
    x = np.random.default_rng(0).normal(size=(3_000, 4))
    c = np.random.default_rng(1).normal(size=(4_096, 4))
    assert np.array_equal(training.nearest(x, c), ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1))


def loop_balanced(v, m):
    size, order = len(v) // m, list(range(len(v)))
    sums = lambda o: [sum(v[i] for i in o[s * size:(s + 1) * size]) for s in range(m)]
    for i in range(1, min(size, m)):
        tried = order[:]
        a, b = i, i * size + size - 1
        tried[a], tried[b] = tried[b], tried[a]
        s = sums(tried)
        if any(s[j] < s[j + 1] - 1e-12 for j in range(m - 1)):
            break
        order = tried
    return order


def test_variance_balancing(spark, rows):
    _, x = rows
    values = np.linalg.eigvalsh(x.T @ x)[::-1]
    assert [r.component for r in catalog.QUERIES["variance_balancing"](spark, SF).orderBy("slot").collect()] == loop_balanced(values.tolist(), catalog.SUBSPACES)
    steep = np.array([9, 5, 4, 1, 1, 1, 0.5, 0.4, 0.3])
    assert training.balanced(steep, 3).tolist() == loop_balanced(steep.tolist(), 3)


def quantized(model, x):
    """(rotated rows, codes, rows of their centroids) by numpy alone."""
    y = x @ model.axes
    size = model.centroids[0].shape[1]
    codes = np.stack([np.round(((y[:, None, s * size:(s + 1) * size] - c[None]) ** 2).sum(axis=2), 9).argmin(axis=1) for s, c in enumerate(model.centroids)], axis=1)
    return y, codes, np.concatenate([c[codes[:, s]] for s, c in enumerate(model.centroids)], axis=1)


def ranked(dist, ids, k):
    dist = np.round(dist, 6)
    return [(int(ids[q]), r + 1, int(ids[i]), pytest.approx(dist[q, i], abs=2e-6)) for q in range(len(ids)) if ids[q] % 100 == 0 for r, i in enumerate(np.lexsort((ids, dist[q]))[:k])]


def test_quantizer_end_to_end(spark, rows):
    """Dictionaries, codes, ADC order, refinement and TI of the trained quantizer."""
    ids, x = rows
    model, queries, base = catalog.fitted(spark, SF, "VAQ32m8min2max6var1,EA")
    y, codes, back = quantized(model, x)
    assert np.allclose(y.T @ y, np.diag(model.variances), atol=1e-8) and sum(model.bits) == 32
    assert {r.vec_id: r.codes for r in model.encode(base).collect()} == dict(zip(ids.tolist(), codes.tolist()))
    size = model.centroids[0].shape[1]
    for s, c in enumerate(model.centroids):  # the dictionaries are those of Lloyd's steps over all rows
        part = y[least(ids, 17, len(ids))][:, s * size:(s + 1) * size]
        assert np.allclose(np.sort(c, axis=0), np.sort(loop_lloyd(part, len(c)), axis=0), atol=1e-9)
    error = ((y - back) ** 2).reshape(len(x), len(model.bits), size).sum(axis=(0, 2))
    got = {r.subspace: (r.n_centroids, r.distortion) for r in catalog.QUERIES["subspace_dictionaries"](spark, SF).collect()}
    assert got == {s: (2 ** b, pytest.approx(error[s], abs=1e-3)) for s, b in enumerate(model.bits)}
    adc = ((y[:, None] - back[None]) ** 2).sum(axis=2)
    found = lambda name: sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "dist")) for r in catalog.QUERIES[name](spark, SF).collect())
    assert found("vaq_search_ti") == ranked(np.sqrt(adc), ids, 10)
    exact = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = np.argsort(np.round(adc, 6) + 1e-12 * ids[None], axis=1)[:, :50]
    only = np.full_like(exact, np.inf)
    np.put_along_axis(only, near, np.take_along_axis(exact, near, axis=1), axis=1)
    assert found("vaq_search_end_to_end") == ranked(only, ids, 10)


@pytest.mark.parametrize("text", ["VAQ24m8min1max6var1,EA_TI8m2", "VAQ24m8min1max6var1,EA_TI8var0.6"])
def test_ti_segments(spark, rows, text):
    """Clusters of some subspaces give the same neighbours as a scan of all codes, and an index that is written once serves."""
    ids, x = rows
    model, queries, base = catalog.fitted(spark, SF, text)
    assert 0 < model.ti_segments() < 8
    index = model.index(model.encode(base), catalog._scratch(spark))
    assert index.centres.shape[1] == index.part == 8 * model.ti_segments()
    got = sorted((r.query_id, r.rank, r.vec_id, r.dist) for r in model.search(queries, model.encode(base), 10, index=index).collect())
    y, _, back = quantized(model, x)
    assert got == ranked(np.sqrt(((y[:, None] - back[None]) ** 2).sum(axis=2)), ids, 10)


def test_centres_in_blocks(spark, monkeypatch):
    queries, base = catalog.both(spark, SF)
    centres = catalog.centres_of(base)
    want = sorted((r.vec_id, r.cluster_id, r.dist) for r in search.assigned(base, centres).collect())
    monkeypatch.setattr(search, "BLOCK", 5)
    assert sorted((r.vec_id, r.cluster_id, r.dist) for r in search.assigned(base, centres).collect()) == want


def test_principal_bits(spark, rows):
    ids, x = rows
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(64)])
    y = x @ (axes * signs)
    sure = np.abs(y) > 1e-9
    for r in catalog.QUERIES["pca_sign_bits"](spark, SF).collect():
        bits = int(r.bits) % (1 << 64)
        i = int(np.flatnonzero(ids == r.vec_id)[0])
        assert all((bits >> (63 - d) & 1) == (y[i, d] > 0) for d in range(64) if sure[i, d])


def test_plain_quantizer(spark, rows):
    ids, x = rows
    order = least(ids, 17, len(ids))
    book = [loop_lloyd(x[order][:, 8 * s:8 * s + 8], 16) for s in range(8)]
    back = np.concatenate([c[np.round(((x[:, None, 8 * s:8 * s + 8] - c[None]) ** 2).sum(axis=2), 9).argmin(axis=1)] for s, c in enumerate(book)], axis=1)
    got = sorted((r.query_id, r.rank, r.vec_id, r.dist) for r in catalog.QUERIES["adc_search_plain_pq"](spark, SF).collect())
    assert got == ranked(((x[:, None] - back[None]) ** 2).sum(axis=2), ids, 10)


def test_param_grid(spark, rows):
    ids, x = rows
    exact = ranked(((x[:, None] - x[None]) ** 2).sum(axis=2), ids, 10)
    truth = {(q, i) for q, _, i, _ in exact}
    got = catalog.QUERIES["vaq_param_grid"](spark, SF).collect()
    assert got
    for r in got[:2]:
        model = training.Vaq.fit(catalog.both(spark, SF)[1], training.VaqParams(r.budget, 8, r.least, r.most))
        y, _, back = quantized(model, x)
        found = ranked(((y[:, None] - back[None]) ** 2).sum(axis=2), ids, 10)
        assert r.precision == pytest.approx(len({(q, i) for q, _, i, _ in found} & truth) / len(truth))
    assert [r.precision for r in got] == sorted((r.precision for r in got), reverse=True)


def test_tables_of_bytes_are_learned_from_rows(spark):
    queries, base = catalog.both(spark, SF)
    model = training.Vaq.fit(base, training.VaqParams.parse("VAQ24m8min1max4var1,FAST"))
    codes = model.encode(base)
    assert model.search(queries, codes, 5).count() == 5 * queries.count() and pq.decode(codes, model.codebook(spark)).count() == base.count()


def test_codes_go_to_the_nearer_of_close_centres(spark):
    """Centres whose distances differ in the seventh digit are told apart."""
    rows = spark.createDataFrame([(0, [0]), (1, [0]), (2, [1])], "vec_id bigint, codes array<int>")
    sizes = ti.lloyd_codes(rows, [np.array([[0.0], [9.0]])], np.array([[0.5], [-0.4999998], [9.0]]), 1)[1]
    assert sizes.tolist() == [0, 2, 1]
