"""Search over clusters by waves: an index of codes or vectors stored far to near, and bounds that tighten from wave to wave.

An index holds each cluster's rows in blocks, from the farthest from the centre to the nearest, with their distances from it.
By the triangle inequality, a row whose distance from the centre differs from the query's by more than the query's k-th best
distance can't be among the best, so of a block only a run of rows can, which two binary searches cut out. Queries visit
their clusters from near to far in waves of growing length; what a wave finds lowers the bounds of the next. Distances of
codes come from tables (centres to dictionaries when the index is built, queries to dictionaries in a search): no row is decoded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions.matrices import finite, matrix
from vexel.operators.search import BLOCK, query_blocks
from vexel.sources.scratch import new_folder

#: Rows of a stored block, and how many times longer each wave is than the one before.
BLOCK_ROWS, GROWTH = 2048, 4
#: Roundings of distances must not prune a row that ties.
SLACK = 1e-5
#: Results that the driver keeps between waves, numbers of a table that a task makes at once, and tables of queries that it keeps.
STATE, TABLE, KEPT_TABLES = 1_000_000, 1 << 22, 1 << 23
LAYOUT = "cluster_id int, far double, near double, n int, dists binary, ids binary, payload binary"
#: Bytes of a row group, so that a wave can pass over the clusters that it doesn't visit.
GROUP_BYTES = 8 << 20


def binaries(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = x.dtype.itemsize * x.shape[1]
    offsets = np.arange(0, (len(x) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


@dataclass
class Index:
    """A stored index. ``part`` dimensions count for clusters (None: all); ``book`` holds the dictionaries if rows are codes."""

    path: str
    centres: np.ndarray
    part: int | None
    book: list[np.ndarray] | None
    members: np.ndarray
    reach: np.ndarray
    inner: np.ndarray

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(LAYOUT).parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(vec_id, cluster_id, dist) of every row, dist being that from the centre."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, dists, ids in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                    ids = np.frombuffer(ids, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), c, np.int32)), pa.array(np.frombuffer(dists, np.float64))], ["vec_id", "cluster_id", "dist"])

        return self.blocks(spark).select("cluster_id", "dists", "ids").mapInArrow(run, "vec_id bigint, cluster_id int, dist double")

    @classmethod
    def open(cls, spark: SparkSession, path: str, centres: np.ndarray, part: int | None, book: list[np.ndarray] | None) -> Index:
        """The index stored at ``path``; a row a cluster comes to the driver."""
        k = len(centres)
        found = spark.read.schema(LAYOUT).parquet(path).groupBy("cluster_id").agg(F.sum("n"), F.max("far"), F.min("near")).collect()
        members, reach, inner = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        for c, n, far, near in found:
            members[c], reach[c], inner[c] = n, far, near
        return cls(path, centres, part, book, members, reach, inner)


def _nearest(distances, n: int, k: int, width: int, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each of ``n`` rows; ``distances(a, b)`` gives those from centres a to b - 1, of which ``width`` numbers are made a centre. What is equal to ``digits`` goes to the first centre."""
    best, which = np.full(n, np.inf), np.zeros(n, np.int32)
    step = max(1, TABLE // max(1, width))
    for at in range(0, k, step):
        d = distances(at, min(at + step, k))
        near = np.round(d, digits).argmin(axis=1)
        own = d[np.arange(n), near]
        closer = np.round(own, digits) < np.round(best, digits)
        best[closer], which[closer] = own[closer], near[closer] + at
    return which, best


def code_distances(codes: np.ndarray, centres: np.ndarray, book: list[np.ndarray], segments: int, a: int, b: int) -> np.ndarray:
    """Squared distances of rows from centres a to b - 1 over the first subspaces, from the tables of centres to dictionaries."""
    out, at = np.zeros((len(codes), b - a)), 0
    for s in range(segments):
        size = book[s].shape[1]
        table = ((book[s][:, None] - centres[None, a:b, at:at + size]) ** 2).sum(axis=2)
        out += table[codes[:, s]]
        at += size
    return out


def lloyd_codes(codes: DataFrame, book: list[np.ndarray], centres: np.ndarray, rounds: int, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(centres, rows of each in the last round) after ``rounds`` of Lloyd's steps over (vec_id, codes), no row being decoded.

    Tasks count how often each cluster has each code of a subspace; a centre is then the mean of the centroids by these counts. An
    empty cluster keeps its centre. Null codes count for nothing. Distances are rounded to ``digits``, as in training.
    """
    k, starts = len(centres), np.cumsum([0, *[len(c) for c in book]])
    n = np.zeros(k, np.int64)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((k, starts[-1]), np.int64)
            for batch in batches:
                x, known = matrix(batch.column(0))
                x = x[known].astype(np.int64)
                width = max(len(x), sum(c.size for c in book))
                which, _ = _nearest(lambda a, b: code_distances(x, centres, book, len(book), a, b), len(x), k, width, digits)
                for s in range(len(book)):
                    np.add.at(counts, (which, starts[s] + x[:, s]), 1)
            c, i = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(counts[c, i])], ["c", "i", "n"])

        counts = np.zeros((k, starts[-1]), np.int64)
        for r in codes.select("codes").mapInArrow(run, "c bigint, i bigint, n bigint").groupBy("c", "i").agg(F.sum("n").alias("n")).collect():  # clusters by codes
            counts[r.c, r.i] = r.n
        n = counts[:, :len(book[0])].sum(axis=1)
        parts = [counts[:, a:a + len(c)] @ c for a, c in zip(starts, book)]
        centres = np.where(n[:, None] > 0, np.concatenate(parts, axis=1) / np.maximum(n, 1)[:, None], centres)
    return centres, n


def _stored(placed: DataFrame, path: str) -> None:
    """Writes rows (cluster_id, dist, vec_id, payload) in blocks: clusters in order, each far to near; a large cluster is dealt out by distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, dist, ids = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]]).tolist() if len(cluster) else []
            cuts = [(at, min(at + BLOCK_ROWS, hi)) for lo, hi in zip(edges, [*edges[1:], len(cluster)]) for at in range(lo, hi, BLOCK_ROWS)]
            if cuts:
                payload = batch.column(3)
                joined = [b"".join(payload.slice(a, b - a).to_pylist()) for a, b in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cluster[a] for a, _ in cuts], pa.int32()), pa.array([dist[a] for a, _ in cuts]), pa.array([dist[b - 1] for _, b in cuts]), pa.array([b - a for a, b in cuts], pa.int32()),
                     pa.array([dist[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array(joined, pa.binary())],
                    ["cluster_id", "far", "near", "n", "dists", "ids", "payload"])

    far = F.col("dist").desc()
    placed.repartitionByRange("cluster_id", far).sortWithinPartitions("cluster_id", far, "vec_id").mapInArrow(run, LAYOUT).write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def index_codes(codes: DataFrame, book: list[np.ndarray], centres: np.ndarray, path: str, segments: int | None = None) -> Index:
    """Writes an index of (vec_id, codes) to ``path``: the nearest of the decoded ``centres`` by the first subspaces, ties to the first. Null codes are left out."""
    segments = len(book) if segments is None else segments
    part = sum(c.shape[1] for c in book[:segments])
    width = sum(len(c) * c.shape[1] for c in book[:segments])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, known = matrix(batch.column(1))
            x = x[known].astype(np.int64)
            which, d = _nearest(lambda a, b: code_distances(x, centres, book, segments, a, b), len(x), len(centres), max(width, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.sqrt(d)), batch.column(0).filter(pa.array(known)), binaries(x.astype(np.uint16))], ["cluster_id", "dist", "vec_id", "payload"])

    _stored(codes.select("vec_id", "codes").mapInArrow(run, "cluster_id int, dist double, vec_id bigint, payload binary"), path)
    return Index.open(codes.sparkSession, path, centres, None if segments == len(book) else part, book)


def index_vectors(base: DataFrame, centres: np.ndarray, path: str, part: int | None = None) -> Index:
    """Writes an index of (vec_id, e) to ``path``, by the first ``part`` dimensions. Vectors that are null or not finite are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = finite(batch.column(1))
            y = x if part is None else x[:, :part]
            which, d = _nearest(lambda a, b: ((y[:, None] - centres[None, a:b]) ** 2).sum(axis=2), len(y), len(centres), y.size)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.sqrt(d)), batch.column(0).take(pa.array(at)), binaries(x)], ["cluster_id", "dist", "vec_id", "payload"])

    _stored(base.select("vec_id", "e").mapInArrow(run, "cluster_id int, dist double, vec_id bigint, payload binary"), path)
    return Index.open(base.sparkSession, path, centres, part, None)


def _scan(index_book: list[np.ndarray] | None, q: np.ndarray, jobs: dict[int, tuple[np.ndarray, np.ndarray]], bounds: np.ndarray, k: int, root: bool, digits: int):
    """What a task makes of blocks: the best k rows of each query, and one row (vec_id null) with how many rows it was met by.

    ``jobs``: for each cluster, the queries that visit it and their distances from its centre.
    """

    def score(tables: dict, i: int, payload: np.ndarray) -> np.ndarray:
        if index_book is None:
            return ((payload - q[i]) ** 2).sum(axis=1)
        if i not in tables:
            if sum(len(c) for c in index_book) * (len(tables) + 1) > KEPT_TABLES:
                tables.clear()
            ends = np.cumsum([c.shape[1] for c in index_book])
            tables[i] = [((c - q[i, e - c.shape[1]:e]) ** 2).sum(axis=1) for c, e in zip(index_book, ends)]
        return reduce(np.add, [t[payload[:, s]] for s, t in enumerate(tables[i])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        touched: dict[int, int] = {}
        tables: dict = {}
        own = bounds.copy()
        for batch in batches:
            for c, far, near, n, dists, ids, payload in zip(*[x.to_pylist() for x in batch.columns]):
                queries, away = jobs.get(c, ((), ()))
                if not len(queries):
                    continue
                rising, names = -np.frombuffer(dists, np.float64), np.frombuffer(ids, np.int64)
                rows = np.frombuffer(payload, np.float64 if index_book is None else np.uint16).reshape(n, -1)
                meets = np.flatnonzero((far >= away - own[queries] - SLACK) & (near <= away + own[queries] + SLACK))
                for i, d in zip(queries[meets].tolist(), away[meets].tolist()):
                    lo = int(np.searchsorted(rising, -(d + own[i] + SLACK)))
                    hi = int(np.searchsorted(rising, -(d - own[i] - SLACK), side="right"))
                    if lo >= hi:
                        continue
                    touched[i] = touched.get(i, 0) + hi - lo
                    x = score(tables, i, rows[lo:hi])
                    x = np.round(np.sqrt(x) if root else x, digits)
                    limit = own[i] if root else own[i] ** 2
                    keep = np.flatnonzero(x <= limit + SLACK)
                    best, names_of = found.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                    best, names_of = np.r_[best, x[keep]], np.r_[names_of, names[lo:hi][keep]]
                    order = np.lexsort((names_of, best))[:k]
                    found[i] = best[order], names_of[order]
                    if len(order) == k:
                        own[i] = min(own[i], best[order[-1]] if root else math.sqrt(best[order[-1]]))
        for i, (best, names_of) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(names_of), pa.array(best), pa.array(np.zeros(len(best), np.int64))], ["q", "vec_id", "dist", "n"])
        if touched:
            yield pa.RecordBatch.from_arrays([pa.array(list(touched)), pa.array([None] * len(touched), pa.int64()), pa.array([None] * len(touched), pa.float64()), pa.array(list(touched.values()))], ["q", "vec_id", "dist", "n"])

    return run


def search(index: Index, queries: DataFrame, k: int, visit: float = 1.0, root: bool = True, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, vec_id, dist), (query_id, touched)): the k nearest rows of each query, and how many rows it was compared with.

    Exact with respect to what the index holds; with ``visit`` below 1, among that share of the clusters nearest to the
    query, and of as many more as hold k rows. ``root``: distances, or else their squares. Ties go to the smaller vec_id. Queries
    that are null or not finite have no result. Between waves, k results a query of a bounded block are on the driver.
    """
    spark = queries.sparkSession
    held: list[tuple[pa.Table, pa.Table]] = []
    folder = None

    def frames() -> tuple[DataFrame, DataFrame]:
        tables = [pa.concat_tables(t) for t in zip(*held)]
        held.clear()
        return spark.createDataFrame(tables[0], "query_id bigint, rank bigint, vec_id bigint, dist double"), spark.createDataFrame(tables[1], "query_id bigint, touched bigint")

    step = max(1, min(BLOCK, STATE // k))
    for block in query_blocks(queries.select("query_id", "qe")):
        asked = block.toArrow()  # at most BLOCK
        q, at = finite(asked.column("qe").combine_chunks())
        ids = asked.column("query_id").to_numpy()[at]
        for lo in range(0, max(1, len(ids)), step):
            found, touched = _waves(spark, index, q[lo:lo + step], k, visit, root, digits)
            own = ids[lo:lo + step]
            sizes = np.array([len(x) for x, _ in found], np.int64)
            ranks = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            best, names = (np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in range(2))
            held.append((pa.table({"query_id": np.repeat(own, sizes), "rank": ranks, "vec_id": names.astype(np.int64), "dist": best}), pa.table({"query_id": own, "touched": touched})))
            if sum(t.num_rows for t, _ in held) > STATE:  # many queries: what is found leaves the driver
                folder = folder or new_folder(spark)
                for name, df in zip(("found", "touched"), frames()):
                    df.write.mode("append").parquet(f"{folder}/{name}")
    if folder is None:
        return frames()
    if held:
        for name, df in zip(("found", "touched"), frames()):
            df.write.mode("append").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/found"), spark.read.parquet(f"{folder}/touched")


def _waves(spark: SparkSession, index: Index, q: np.ndarray, k: int, visit: float, root: bool, digits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    m, clusters = len(q), len(index.centres)
    y = q if index.part is None else q[:, :index.part]
    square = np.concatenate([((y[a:a + 64, None] - index.centres[None]) ** 2).sum(axis=2) for a in range(0, m, 64)]) if m else np.zeros((0, clusters))
    away, order = np.sqrt(square), np.argsort(np.round(square, 6), axis=1, kind="stable")
    held = index.members[order]
    before = np.cumsum(held, axis=1) - held
    allowed = (before < k) | (np.arange(clusters)[None] < (clusters if visit >= 1 else int(clusters * visit)))
    found = [(np.zeros(0), np.zeros(0, np.int64))] * m
    touched, bounds = np.zeros(m, np.int64), np.full(m, np.inf)
    start, width = 0, 1
    while start < clusters:
        some = order[:, start:start + width]
        d = np.take_along_axis(away, some, axis=1)
        go = allowed[:, start:start + width] & (held[:, start:start + width] > 0) & (d - index.reach[some] <= bounds[:, None] + SLACK) & (index.inner[some] - d <= bounds[:, None] + SLACK)
        start, width = start + width, width * GROWTH
        i, j = np.nonzero(go)
        if not len(i):
            continue
        cluster = some[i, j]
        by = np.argsort(cluster, kind="stable")
        wanted, first = np.unique(cluster[by], return_index=True)
        jobs = {int(c): (i[p], d[i[p], j[p]]) for c, p in zip(wanted, np.split(by, first[1:]))}
        blocks = index.blocks(spark)
        blocks = blocks.filter(F.col("cluster_id").isin(wanted.tolist())) if len(wanted) < clusters else blocks
        rows = blocks.mapInArrow(_scan(index.book, q, jobs, bounds, k, root, digits), "q bigint, vec_id bigint, dist double, n bigint")
        best = F.slice(F.array_sort(F.collect_list(F.when(F.col("vec_id").isNotNull(), F.struct("dist", "vec_id")))), 1, k)  # a group is k rows a task
        for r in rows.groupBy("q").agg(best.alias("best"), F.sum("n").alias("n")).collect():
            a, b = found[r.q]
            a, b = np.r_[a, [x.dist for x in r.best]], np.r_[b, np.array([x.vec_id for x in r.best], np.int64)]
            by = np.lexsort((b, a))[:k]
            found[r.q] = a[by], b[by]
            touched[r.q] += r.n
            if len(by) == k:
                bounds[r.q] = found[r.q][0][-1] if root else math.sqrt(found[r.q][0][-1])
    return found, touched
