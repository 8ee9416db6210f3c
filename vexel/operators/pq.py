"""Product quantization: encoding, look-up tables, asymmetric distance search (ADC) and quantized tables.

A codebook is (subspace, code, centroid); a row's codes are ARRAY<INT>, one per subspace. A codebook is bounded by the sum of
2**bits over the subspaces, at most 64 * 2**15 centroids, so it travels as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions import expr
from vexel.functions.matrices import matrix
from vexel.operators import selection
from vexel.operators.search import Best, blocks_of, query_blocks, searched, spread

#: Shares cut off at either end of a look-up table, from which learning chooses.
ALPHAS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)
#: Subspaces added up before rows beyond the bound are dropped.
STEP = 4
#: Differences that are worked out at once.
CELLS = 1 << 21


def packed(codebook: DataFrame) -> DataFrame:
    """One row: book ARRAY<ARRAY<ARRAY<DOUBLE>>> by subspace and code."""
    by_sub = codebook.groupBy("subspace").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("c"))
    one = by_sub.agg(F.sort_array(F.collect_list(F.struct("subspace", F.col("c.centroid").alias("centroids")))).alias("b"))
    return one.select(F.col("b.centroids").alias("book"))


def _distances(v: Column, book: Column) -> Column:
    """ARRAY<ARRAY<DOUBLE>>: squared distances of each subvector from the centroids of its subspace."""
    return F.transform(book, lambda cs, s: F.transform(cs, lambda c: expr.l2sq(expr.subspace(v, s, F.size(c)), c)))


def dictionaries_of(codebook: DataFrame) -> list[np.ndarray]:
    """The centroids of each subspace by code, on the driver; a codebook is small."""
    by_sub: dict[int, list[tuple[int, list[float]]]] = {}
    for r in codebook.collect():
        by_sub.setdefault(r.subspace, []).append((r.code, r.centroid))
    return [np.array([x for _, x in sorted(by_sub[s])]) for s in sorted(by_sub)]


def encode(base: DataFrame, codebook: DataFrame, digits: int = 9) -> DataFrame:
    """(vec_id, codes): the nearest centroid of each subspace, ties to the lower code. A narrow projection of the base; a null vector has null codes."""
    book = dictionaries_of(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, known = matrix(batch.column(1))
            codes, at = np.zeros((len(x), len(book)), np.int32), 0
            for s, c in enumerate(book):
                part = x[:, at:at + c.shape[1]]
                at += c.shape[1]
                step = max(1, CELLS // c.size)
                for lo in range(0, len(x) if known.any() else 0, step):
                    codes[lo:lo + step, s] = np.round(((part[lo:lo + step, None] - c[None]) ** 2).sum(axis=2), digits).argmin(axis=1)
            offsets = pa.array(np.arange(0, codes.size + 1, max(1, len(book)), dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()), mask=pa.array(~known) if not known.all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["vec_id", "codes"])

    return base.select("vec_id", "e").mapInArrow(run, "vec_id bigint, codes array<int>")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """(vec_id, e): the centroids of each row's codes, end to end."""
    vector = F.flatten(F.transform("codes", lambda c, s: F.get(F.get("book", s), c)))
    return codes.crossJoin(F.broadcast(packed(codebook))).select("vec_id", vector.alias("e"))


def tables(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """(query_id, lut): computed once a query, before any row is met."""
    return queries.crossJoin(F.broadcast(packed(codebook))).select("query_id", _distances(F.col("qe"), F.col("book")).alias("lut"))


def adc(lut: Column, codes: Column) -> Column:
    return F.aggregate(F.zip_with(lut, codes, lambda t, c: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)


def search(luts: DataFrame, codes: DataFrame, k: int, strategy: str = "heap", digits: int | None = 6, most: float = np.inf) -> DataFrame:
    """ADC neighbours; sums beyond ``most`` count as that. Rows or queries without codes or tables have none. All strategies return the same rows:

    heap, fast2: a task gathers table entries for some rows and queries at once and keeps the best k of each query; sort: the
    same with square roots; ea: pairs are dropped as soon as their partial distance exceeds the query's k-th best so far.
    """
    found = []
    blocks = query_blocks(luts)
    for block in blocks:
        ids, stacked = _stacked(block)
        if len(ids):
            found.append(spread(codes.select("vec_id", "codes"), len(ids)).mapInArrow(_scan(ids, stacked, k, strategy, digits, most), "query_id bigint, vec_id bigint, dist double"))
    if not found:
        return luts.sparkSession.createDataFrame([], "query_id bigint, rank bigint, vec_id bigint, dist double")
    return searched(found, k)


def _stacked(block: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, a matrix of queries by codes for each subspace) of a block of at most search.BLOCK queries; those whose tables hold nulls or what isn't finite are left out."""
    got = block.select("query_id", "lut").toArrow()
    ids, lut = got.column("query_id").to_numpy(), got.column("lut").combine_chunks()
    lut = lut.chunk(0) if isinstance(lut, pa.ChunkedArray) else lut
    fine = lut.is_valid().to_numpy(zero_copy_only=False)
    lut, ids = lut.filter(pa.array(fine)), ids[fine]
    if not len(ids):
        return ids, []
    inner = lut.flatten()
    sizes = np.diff(inner.offsets.to_numpy()).reshape(len(ids), -1)
    if (sizes != sizes[0]).any():
        raise ValueError("tables differ in length")
    values = inner.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    fine = np.isfinite(values).all(axis=1)
    edges = np.cumsum([0, *sizes[0]])
    return ids[fine], [np.ascontiguousarray(values[fine, a:b]) for a, b in zip(edges, edges[1:])]


def _scan(ids: np.ndarray, luts: list[np.ndarray], k: int, strategy: str, digits: int | None, most: float):
    def finished(d: np.ndarray) -> np.ndarray:
        d = np.minimum(d, most) if most < np.inf else d
        d = np.sqrt(d) if strategy == "sort" else d
        return d if digits is None else np.round(d, digits)

    def whole(some: slice, x: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
        d = np.zeros((len(luts[0][some]), len(x)))
        upto = STEP if bound is not None and np.isfinite(bound[some]).all() else len(luts)
        for s, t in enumerate(luts[:upto]):
            d += np.take(t[some], x[:, s], axis=1)
        if upto >= len(luts):
            return finished(d)
        limit = bound[some] + 10.0 ** -(digits or 9)
        i, j = np.nonzero(d <= limit[:, None])
        part, out = d[i, j], np.full(d.shape, np.inf)
        for s in range(upto, len(luts)):
            part = part + luts[s][some][i, x[j, s]]
            if s % STEP == STEP - 1:
                stay = part <= limit[i]
                i, j, part = i[stay], j[stay], part[stay]
        out[i, j] = finished(part)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            codes, known = matrix(batch.column(1))
            codes, names = codes[known].astype(np.intp), batch.column(0).to_numpy()[known]
            if len(codes):
                blocks_of(codes, names, best, len(ids), lambda: 1, lambda some, x: whole(some, x, best.bound if strategy == "ea" else None))
        yield from best.batch(ids)

    return run


def learned_quantization(luts: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(subspace, alpha, offset, scale): how a subspace's table entries become bytes, with one alpha for all subspaces.

    ``luts`` are the tables of rows taken as queries, of any number: percentiles are exact order statistics, of which neither
    all rows nor all entries meet in a task. Per alpha, offset is the alpha-percentile of the entries, and scale
    maps the (1 - alpha)-percentile of what lies above it to 255. The alpha of the least squared loss is taken, of equal
    ones the largest.
    """
    cells = luts.select(F.posexplode("lut").alias("dim", "t")).select("dim", F.explode("t").alias("x"))
    sizes = {r.dim: r.n for r in cells.groupBy("dim").agg(F.count("x").alias("n")).collect()}  # a row a subspace
    place = lambda n, share: (n - 1) * share
    ranks = {(d, r, n) for d, n in sizes.items() for a in alphas for share in (a, 1 - a) for r in (int(np.floor(place(n, share))), int(np.ceil(place(n, share))))}
    spark = luts.sparkSession
    found = selection.order_statistics(cells, spark.createDataFrame(sorted(ranks), "dim int, rank bigint, n bigint")).collect() if ranks else []
    at = {(r.dim, r["rank"]): r.value for r in found}

    def percentile(d: int, share: float, above: float = -np.inf) -> float:
        """Of the entries of a subspace, or of what lies above a value: both rise with the entry, so the same ranks serve."""
        p = place(sizes[d], share)
        lo, hi = (max(at[d, int(f(p))] - above, 0.0) if above > -np.inf else at[d, int(f(p))] for f in (np.floor, np.ceil))
        return float(lo + (hi - lo) * (p - np.floor(p)))

    rows = []
    for d in sorted(sizes):
        offsets = [percentile(d, a) for a in alphas]
        tops = [percentile(d, 1 - a, o) for a, o in zip(alphas, offsets)]
        rows.append((d, *offsets, *[255 / t if t > 0 else None for t in tops]))
    names = [*[f"o{i}" for i in range(len(alphas))], *[f"s{i}" for i in range(len(alphas))]]
    model = spark.createDataFrame(rows, "dim int, " + ", ".join(f"{n} double" for n in names))
    loss = []
    for i in range(len(alphas)):
        y = F.greatest(F.col("x") - F.col(f"o{i}"), F.lit(0.0)) * F.col(f"s{i}")
        loss.append(F.round(F.sum(F.pow(y - F.least(F.floor(y), F.lit(255)), 2)), 3).alias(f"l{i}"))
    losses = cells.join(F.broadcast(model), "dim").agg(*loss).first()
    best = min(range(len(alphas)), key=lambda i: (losses[i] if losses[i] is not None else 0.0, -alphas[i]))
    return model.select(F.col("dim").alias("subspace"), F.lit(alphas[best]).alias("alpha"), F.col(f"o{best}").alias("offset"), F.col(f"s{best}").alias("scale"))


def quantized(luts: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, lut): tables of bytes."""
    one = model.agg(F.sort_array(F.collect_list(F.struct("subspace", "offset", "scale"))).alias("m"))
    cell = F.transform("lut", lambda t, s: F.transform(t, lambda x: F.least(F.floor(F.greatest(x - F.get("m", s)["offset"], F.lit(0.0)) * F.get("m", s)["scale"]), F.lit(255)).cast("double")))
    return luts.crossJoin(F.broadcast(one)).select("query_id", cell.alias("lut"))


def search_quantized(luts: DataFrame, model: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """Neighbours by the sum of table bytes, which saturates at 32767."""
    return search(quantized(luts, model), codes, k, digits=None, most=32767.0)


def search_hybrid(luts: DataFrame, model: DataFrame, codes: DataFrame, k: int, split: int) -> DataFrame:
    """Exact table entries before subspace ``split``, bytes turned back (byte / scale + offset) from it on."""
    one = model.agg(F.sort_array(F.collect_list(F.struct("subspace", "offset", "scale"))).alias("m"))
    back = F.transform("lut", lambda t, s: F.when(s < split, t).otherwise(F.transform(t, lambda x: F.least(F.floor(F.greatest(x - F.get("m", s)["offset"], F.lit(0.0)) * F.get("m", s)["scale"]), F.lit(255)) / F.get("m", s)["scale"] + F.get("m", s)["offset"])))
    return search(luts.crossJoin(F.broadcast(one)).select("query_id", back.alias("lut")), codes, k)
