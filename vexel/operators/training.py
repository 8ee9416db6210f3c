"""Training: Gram matrix, principal axes, bit allocation, k-means and the variance-aware quantizer.

What is d by d or per subspace is small by construction and is worked out in numpy on the driver; whatever runs over rows is a
Spark job that returns sums.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions import expr
from vexel.functions.matrices import finite, lists, matrix
from vexel.operators import pq, search, selection, ti
from vexel.sources import scratch, vectors

MAX_BITS = 15


def gram(base: DataFrame) -> DataFrame:
    """(i, j, g): the uncentred sums of products; each task sends one matrix.

    Vectors that are null or hold what isn't finite are left out; vectors of several lengths are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, at = finite(batch.column(0))
            if len(at):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "g"])

    return base.select("e").mapInArrow(run, "i bigint, j bigint, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def principal_axes(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(variances, axes as columns) of (vec_id, e), descending; each axis has its largest loading positive."""
    return axes_of(gram_matrix(base))


def projected(rows: DataFrame, vector: str, axes: np.ndarray) -> DataFrame:
    """``rows`` with ``vector`` rotated; anything that is not finite becomes zero, and a null vector stays null. Shorter vectors count as filled up with zeros."""
    names = rows.columns
    place = names.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            x, known = matrix(columns[place])
            with np.errstate(invalid="ignore", over="ignore"):
                y = np.nan_to_num(np.pad(x, ((0, 0), (0, len(axes) - x.shape[1]))) @ axes, nan=0.0, posinf=0.0, neginf=0.0)
            offsets = pa.array(np.arange(0, y.size + 1, axes.shape[1], dtype=np.int32))
            columns[place] = pa.ListArray.from_arrays(offsets, pa.array(y.ravel()), mask=None if known.all() else pa.array(~known))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def balanced(variances: np.ndarray, subspaces: int) -> np.ndarray:
    """The order of the components after partial balancing.

    The second, third ... component of the first subspace trades places with the last one of the second, third ... as long as
    the subspaces' variances stay in descending order.
    """
    size = len(variances) // subspaces
    order = np.arange(len(variances))

    def descending(o: np.ndarray) -> bool:
        sums = variances[o].reshape(subspaces, size).sum(axis=1)
        return bool(np.all(sums[:-1] >= sums[1:] - 1e-12))

    for i in range(1, min(size, subspaces)):
        tried = order.copy()
        tried[[i, i * size + size - 1]] = tried[[i * size + size - 1, i]]
        if not descending(tried):
            break
        order = tried
    return order


def shares(variances: np.ndarray, subspaces: int) -> np.ndarray:
    """The share of the variance of each subspace."""
    v = np.maximum(variances / variances.sum(), 1e-12)
    return v.reshape(subspaces, -1).sum(axis=1)


def retained(var: np.ndarray, share: float) -> int:
    """How many subspaces are kept: those up to the last whose cumulative share is at most ``share``, and one at least."""
    if share >= 1:
        return len(var)
    inside = np.flatnonzero(np.cumsum(var) <= share + 1e-6)
    return int(inside[-1]) + 1 if len(inside) else 1


def allocate(var: list[float] | np.ndarray, budget: int, least: int, most: int, share: float = 1.0) -> list[int]:
    """Bits of each subspace: the largest sum of variance times bits that uses the budget.

    A subspace within ``share`` of the variance has at least ``least`` bits, none more than ``most``, and neighbours differ
    by at most the power of two below the ratio of their variances. Of equal optima, the lexicographically largest. Solved
    exactly by going through (subspace, bits, bits used) from the last subspace to the first.
    """
    m = len(var)
    cum = np.cumsum(var)
    low = [least if cum[s] <= share + 1e-6 else 0 for s in range(m)]
    step = [2 ** int(np.floor(np.log2(var[s] / var[s + 1]))) if var[s + 1] > 0 and var[s] >= var[s + 1] else 0 for s in range(m - 1)]
    best: list[dict[tuple[int, int], tuple[float, int]]] = [{} for _ in range(m)]
    for s in range(m - 1, -1, -1):
        for x in range(low[s], most + 1):
            gain = float(var[s]) * x
            if s == m - 1:
                best[s][x, x] = (gain, -1)
                continue
            for (y, used), (value, _) in best[s + 1].items():
                if x - y <= step[s] and used + x <= budget:
                    old = best[s].get((x, used + x))
                    new = (round(gain + value, 12), y)
                    if old is None or new > old:
                        best[s][x, used + x] = new
    ends = [(value, x) for (x, used), (value, _) in best[0].items() if used == budget]
    if not ends:
        raise ValueError("no allocation meets the constraints")
    out = [max(ends)[1]]
    left = budget
    for s in range(m - 1):
        y = best[s][out[-1], left][1]
        left -= out[-1]
        out.append(y)
    return out


def parse_bits(text: str) -> tuple[int, ...]:
    """Bits of each subspace as a list of numbers with commas between them."""
    try:
        bits = tuple(int(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"not a list of bits: {text}") from None
    if any(not 0 <= b <= MAX_BITS for b in bits):
        raise ValueError(f"bits must lie between 0 and {MAX_BITS}")
    return bits


def filled_up(bits: list[int], budget: int, most: int) -> list[int]:
    """An allocation short of the budget: a bit for each subspace of the first run without any, then from left to right up to ``most``.

    ValueError where the budget can't be met.
    """
    out = list(bits)
    if sum(out) < budget and 0 in out:
        at = out.index(0)
        while at < len(out) and out[at] == 0 and sum(out) < budget:
            out[at] += 1
            at += 1
    while sum(out) < budget and any(b < most for b in out):
        for i, b in enumerate(out):
            if b < most and sum(out) < budget:
                out[i] += 1
    if sum(out) < budget:
        raise ValueError(f"{sum(out)} bits are fewer than the budget of {budget}")
    return out


def sampled(rows: DataFrame, size: int, seed: int = 17) -> DataFrame:
    """At most ``size`` rows, those with the least hash of vec_id: the same on every run."""
    return selection.least_rows(rows, sample_key(seed), size)


def sample_key(seed: int) -> Column:
    """48 bits of the MD5 of seed:vec_id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("vec_id")).cast("binary")), 1, 12), 16, 10).cast("bigint")


def random_bits(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """(vec_id, bits): ``count`` random bits for each row, a word of 64 being the beginning of the MD5 of seed:vec_id:word."""
    halves = lambda w, at: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("vec_id"), w).cast("binary")), at, 8), 16, 10).cast("bigint")
    spare = -count % 64
    words = F.transform(F.sequence(F.lit(0), F.lit((count - 1) // 64)), lambda w: F.shiftleft(halves(w, 1), 32).bitwiseOR(halves(w, 9)).bitwiseAND(F.when(w == (count - 1) // 64, F.lit(-1 << spare).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))))
    return rows.select("vec_id", words.alias("bits"))


def drawn(rows: DataFrame, size: int, batches: int = 1, seed: int = 17) -> DataFrame:
    """A sample of ``size`` rows with replacement, an equal share from each of ``batches`` runs of vec_id, as ``selection.draws`` has it.

    Rows (vec_id, ...), vec_id being the position in a file from 0; each drawn row has the number of its ``draw``.
    """
    return selection.draws(rows.sparkSession, rows.count(), size, batches, seed).join(rows, "vec_id").select("draw", *rows.columns)


def nearest(x: np.ndarray, centres: np.ndarray, digits: int | None = None) -> np.ndarray:
    """The nearest centre of each row, ties to the first; in blocks, so that memory stays bounded. With ``digits``, distances are rounded."""
    out = np.empty(len(x), np.int64)
    step = max(1, (1 << 22) // (len(centres) * (x.shape[1] if digits is not None else 1)))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        if digits is None:
            d = (centres ** 2).sum(axis=1)[None] - 2 * part @ centres.T
        else:
            d = np.round(((part[:, None] - centres[None]) ** 2).sum(axis=2), digits)
        out[at:at + step] = d.argmin(axis=1)
    return out


def lloyd(points: DataFrame, seeds: list[list[float]], rounds: int) -> list[list[float]]:
    """Centres after ``rounds`` of Lloyd's steps over (vec_id, e); an empty cluster keeps its centre. Vectors that are null or not finite count for nothing.

    Each round is one job: a task sends the sum and the number of its rows in each cluster, and k * d numbers go to the driver.
    """
    centres = np.array(seeds, float)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], c=centres) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                x, at = finite(batch.column(0))
                if len(at):
                    near = nearest(x, c, 9)
                    np.add.at(sums, near, x)
                    n += np.bincount(near, minlength=len(c))
            k, i = np.divmod(np.arange(c.size), c.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(sums.ravel()), pa.array(n[k])], ["cluster_id", "i", "x", "n"])

        found = points.select("e").mapInArrow(run, "cluster_id bigint, i bigint, x double, n bigint").groupBy("cluster_id", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        new = centres.copy()
        for r in found:
            if r.n:
                new[r.cluster_id, r.i] = r.x / r.n
        if np.array_equal(new, centres):
            break
        centres = new
    return centres.tolist()


def cluster(points: DataFrame, k: int, rounds: int, sample: int | None = None, axes: np.ndarray | None = None, dims: tuple[int, int] | None = None) -> np.ndarray:
    """``k`` centres of (vec_id, e) by Lloyd's steps from the first rows by vec_id: of all rows or of a ``sample`` of so many.

    With ``axes`` (as columns), rows are projected first; with ``dims`` (first, count), only these dimensions of them count.
    """
    rows = points.select("vec_id", "e") if sample is None else sampled(points.select("vec_id", "e"), sample)
    rows = rows if axes is None else projected(rows, "e", axes)
    rows = rows if dims is None else rows.withColumn("e", F.slice("e", dims[0] + 1, dims[1]))
    fine = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x))
    seeds = [r.e for r in rows.filter(fine).orderBy("vec_id").limit(k).collect()]
    return np.array(lloyd(rows, seeds, rounds))


#: Steps of farthest-first seeding after which the rows' distances are written, and rows that mini-batches bring to the driver at once.
WRITTEN_EVERY, HELD_ROWS = 16, 200_000


def farthest_first(points: DataFrame, k: int) -> list[int]:
    """vec_ids of seeds: the least vec_id, then always the row farthest from all seeds so far (ties: the least vec_id).

    A task sends its farthest row. Rows carry their distance from the seeds up to the last time that it was written, so a
    step compares them with WRITTEN_EVERY seeds at most. Vectors that are null or not finite are no seeds; there may be fewer than
    ``k`` rows.
    """
    found, recent = [], np.zeros((0, 0))
    near = points.select("vec_id", "e", F.lit(float("inf")).alias("d"))
    last = None

    def distances(x: np.ndarray, d: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        for s in seeds:
            d = np.minimum(d, np.round(((x - s) ** 2).sum(axis=1), 9))
        return d

    for _ in range(k):

        def farthest(batches: Iterator[pa.RecordBatch], seeds=recent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, at = finite(batch.column(1))
                if len(at):
                    names = batch.column(0).to_numpy()[at]
                    d = distances(x, batch.column(2).to_numpy()[at], seeds)
                    best = np.lexsort((names, -d))[:1]
                    yield pa.RecordBatch.from_arrays([pa.array(d[best]), pa.array(names[best]), lists(x[best])], ["d", "vec_id", "e"])

        best = near.mapInArrow(farthest, "d double, vec_id bigint, e array<double>").agg(F.max(F.struct("d", (-F.col("vec_id")).alias("v"), "e")).alias("b")).first().b
        if best is None or -best.v in found:
            break
        found.append(-best.v)
        recent = np.vstack([recent, best.e]) if len(recent) else np.array([best.e])
        if len(recent) == WRITTEN_EVERY:

            def kept(batches: Iterator[pa.RecordBatch], seeds=recent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x, at = finite(batch.column(1))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists(x), pa.array(distances(x, batch.column(2).to_numpy()[at], seeds))], ["vec_id", "e", "d"])

            near, path = scratch.written(near.mapInArrow(kept, "vec_id bigint, e array<double>, d double"))
            if last:
                scratch.removed(last)
            last, recent = path, np.zeros((0, 0))
    if last:
        scratch.removed(last)
    return found


def batches_of(points: DataFrame, batch: int, rounds: int) -> Iterator[np.ndarray]:
    """The rows of each round of mini-batch k-means, in the order of vec_id: the ``batch`` rows of the least hash for that round.

    The rows of many rounds are drawn in one pass; each task keeps ``batch`` rows a round.
    """
    step = max(1, HELD_ROWS // max(1, batch))
    for at in range(0, rounds, step):
        some = list(range(at, min(at + step, rounds)))
        keys = F.array(*[sample_key(r) for r in some])
        by = Window.partitionBy("round").orderBy("key", "vec_id")
        drawn_rows = points.select("vec_id", "e", F.posexplode(keys).alias("round", "key")).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= batch)
        table = drawn_rows.select("round", "vec_id", "e").toArrow().combine_chunks().sort_by([("round", "ascending"), ("vec_id", "ascending")])  # HELD_ROWS, or one batch
        x, fine = finite(table.column("e").combine_chunks()) if table.num_rows else (np.zeros((0, 0)), np.zeros(0, np.int64))
        owner = table.column("round").to_numpy()[fine] if table.num_rows else np.zeros(0)
        for i in range(len(some)):
            yield x[owner == i]


def minibatch(points: DataFrame, seeds: list[list[float]], batch: int, rounds: int, tolerance: float = 0.0, norm: int = 2) -> list[list[float]]:
    """Mini-batch k-means: each round moves the centres towards ``batch`` rows by one over the rows they have seen.

    It ends after ``rounds``, or when the centres have moved by at most ``tolerance`` in a round, summed up by the norm 1 or 2 of their moves.
    """
    centres, seen = np.array(seeds, float), np.zeros(len(seeds))
    for rows in batches_of(points, batch, rounds):
        before = centres.copy()
        for x, c in zip(rows, nearest(rows, centres, 9) if len(rows) else []):
            seen[c] += 1
            centres[c] += (x - centres[c]) / seen[c]
        if np.linalg.norm(centres - before, norm, axis=1).sum() <= tolerance:
            break
    return centres.tolist()


def _numpy_lloyd(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    k = min(k, len(x))
    centres = x[:k].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def hierarchical(x: np.ndarray, bits: int, coarse: int = 7) -> np.ndarray:
    """2**bits centres: 2**coarse first, then the rest within each of their cells."""
    top = _numpy_lloyd(x, 1 << min(coarse, bits))
    near = nearest(x, top)
    fine = max(1, (1 << bits) // len(top))
    return np.concatenate([_numpy_lloyd(x[near == c], fine) if (near == c).any() else top[c:c + 1] for c in range(len(top))])


def binary(x: np.ndarray, bits: int) -> np.ndarray:
    """2**bits centres by repeated halving; where a side is too small for its subtree, that is clustered flat."""
    if bits == 0 or len(x) <= 1:
        return x.mean(axis=0, keepdims=True)
    two = _numpy_lloyd(x, 2)
    side = nearest(x, two) if len(two) == 2 else np.zeros(len(x), int)
    if min((side == 0).sum(), (side == 1).sum()) < (1 << (bits - 1)):
        return _numpy_lloyd(x, 1 << bits)
    return np.concatenate([binary(x[side == 0], bits - 1), binary(x[side == 1], bits - 1)])


#: Bits of a subspace beyond which its dictionary is learned in two levels, unless it is to be learned by halving.
FLAT_BITS = 8


@dataclass(frozen=True)
class VaqParams:
    """A quantizer and a search strategy, as in ``VAQ32m8min2max6var1,HEAP``."""

    budget: int = 32
    subspaces: int = 8
    least: int = 2
    most: int = 6
    share: float = 1.0
    strategy: str = "HEAP"
    clusters: int = 0
    #: Subspaces by which TI clusters: a number (0: all), or those up to a share of the variance where it is below 1.
    segments: int = 0
    segment_share: float = 1.0
    clustering: str = "flat"
    bits: tuple[int, ...] = ()
    #: Rows on which the dictionaries are learned, per centroid.
    rows_per_centroid: int = 256

    #: Which strategy counts where several are named.
    PRIORITY: ClassVar[tuple[str, ...]] = ("TI", "EA", "HEAP", "FAST", "FAST2", "FAST3", "SORT")

    @classmethod
    def parse(cls, text: str) -> VaqParams:
        """Of several strategies, the first of PRIORITY counts; without any, HEAP."""
        head, _, tail = text.partition(",")
        found = re.fullmatch(r"VAQ(\d+)m(\d+)min(\d+)max(\d+)var([\d.]+)", head.strip(), re.I)
        if not found:
            raise ValueError(f"not a quantizer: {head}")
        tokens = [t for t in tail.strip().upper().split("_") if t]
        clusters, segments, segment_share = 0, 0, 1.0
        for t in tokens:
            ti = re.fullmatch(r"TI(\d+)(?:M(\d+)|VAR([\d.]+))?", t)
            if ti:
                clusters, segments, segment_share = int(ti[1]), int(ti[2] or 0), float(ti[3] or 1)
            elif t not in cls.PRIORITY:
                raise ValueError(f"not a strategy: {t}")
        names = {"TI" if t.startswith("TI") else t for t in tokens}
        strategy = next((p for p in cls.PRIORITY if p in names), "HEAP")
        params = cls(int(found[1]), int(found[2]), int(found[3]), int(found[4]), float(found[5]), strategy, clusters, segments, segment_share)
        if params.most > MAX_BITS or params.least < 0:
            raise ValueError("bits must lie between 0 and 15")
        return params


def dictionaries(rows: DataFrame, size: int, bits: list[int], kind: str = "flat") -> list[np.ndarray]:
    """The centroids of each subspace of ``size`` dimensions, learned from (vec_id, e), a sample of bounded size. One subspace a task."""
    return learned(rows, [(s * size, size, b) for s, b in enumerate(bits)], kind)


def plain_codebook(base: DataFrame, subspaces: int, bits: int = 4, rows_per_centroid: int = 256) -> DataFrame:
    """(subspace, code, centroid): a product quantizer without rotation, with the same bits for all subspaces."""
    size = search.dimensions(base, "e") // subspaces
    found = dictionaries(sampled(base.select("vec_id", "e"), rows_per_centroid << bits), size, [bits] * subspaces)
    return base.sparkSession.createDataFrame([(s, c, x.tolist()) for s, cs in enumerate(found) for c, x in enumerate(cs)], "subspace int, code int, centroid array<double>")


def bits_of(share: np.ndarray, params: VaqParams) -> list[int]:
    """The bits of the kept subspaces: those that the parameters name, which must meet the budget, or the best allocation."""
    if params.bits:
        named = list(params.bits)[:len(share)]
        if len(named) < len(share) or sum(named) < params.budget:
            raise ValueError(f"{len(named)} subspaces with {sum(named)} bits are fewer than {len(share)} with {params.budget}")
        return named
    return filled_up(allocate(share, params.budget, params.least, params.most, params.share), params.budget, params.most)


def gram_matrix(base: DataFrame) -> np.ndarray:
    """The Gram matrix on the driver, d by d."""
    cells = gram(base).collect()
    d = 1 + max((r.i for r in cells), default=-1)
    g = np.zeros((d, d))
    for r in cells:
        g[r.i, r.j] = r.g
    return (g + g.T) / 2


def axes_of(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variances, axes as columns) of a Gram matrix, descending; each axis has its largest loading positive."""
    values, vectors = np.linalg.eigh(g)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(g))]) if len(g) else np.zeros(0)
    return values, vectors * np.where(signs == 0, 1, signs)


def rotation(g: np.ndarray, subspaces: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(axes, variances, dimensions of a subspace) of vectors filled up with zeros to a multiple of the subspaces, balanced between these."""
    size = -(-len(g) // subspaces)
    wide = np.zeros((size * subspaces,) * 2)
    wide[:len(g), :len(g)] = g
    values, axes = axes_of(wide)
    order = balanced(values, subspaces)
    return axes[:, order], values[order], size


def turned(rows: DataFrame, vector: str, axes: np.ndarray) -> DataFrame:
    """``rows`` with ``vector``, which comes last, filled up with zeros and rotated."""
    kept = rows.select(*[c for c in rows.columns if c != vector], expr.padded(F.col(vector), len(axes)).alias(vector))
    return projected(kept, vector, axes)


@dataclass
class Vaq:
    """A trained quantizer. ``axes`` rotates (padded) vectors and orders the components; ``bits`` and centroids are by subspace."""

    params: VaqParams
    axes: np.ndarray
    variances: np.ndarray
    bits: list[int]
    centroids: list[np.ndarray]

    @classmethod
    def fit(cls, base: DataFrame, params: VaqParams) -> Vaq:
        """Trained on (vec_id, e): the rotation on all rows, the dictionaries on a bounded sample of them."""
        axes, values, size = rotation(gram_matrix(base), params.subspaces)
        share = shares(values, params.subspaces)
        bits = bits_of(share[:retained(share, params.share)], params)
        rows = turned(sampled(base.select("vec_id", "e"), params.rows_per_centroid << max(bits)), "e", axes)
        return cls(params, axes, values, bits, dictionaries(rows, size, bits, params.clustering))

    def codebook(self, spark: SparkSession) -> DataFrame:
        rows = [(s, c, x.tolist()) for s, cs in enumerate(self.centroids) for c, x in enumerate(cs)]
        return spark.createDataFrame(rows, "subspace int, code int, centroid array<double>")

    def rotate(self, rows: DataFrame, vector: str) -> DataFrame:
        return turned(rows, vector, self.axes)

    def encode(self, base: DataFrame) -> DataFrame:
        return pq.encode(self.rotate(base.select("vec_id", "e"), "e"), self.codebook(base.sparkSession))

    def tables(self, queries: DataFrame) -> DataFrame:
        return pq.tables(self.rotate(queries.select("query_id", "qe"), "qe"), self.codebook(queries.sparkSession))

    def ti_segments(self) -> int:
        """The subspaces by which TI clusters."""
        n = self.params.segments or retained(shares(self.variances, self.params.subspaces), self.params.segment_share)
        return min(n, len(self.centroids))

    def index(self, codes: DataFrame, path: str) -> ti.Index:
        """An index of codes for TI, written to ``path``: its centres are learned on a bounded sample, decoded; all other rows stay codes."""
        n, count = self.ti_segments(), self.params.clusters or 16
        part = sum(c.shape[1] for c in self.centroids[:n])
        some = sampled(codes, self.params.rows_per_centroid * count)
        decoded = pq.decode(some, self.codebook(codes.sparkSession)).withColumn("e", F.slice("e", 1, part))
        seeds = [r.e for r in pq.decode(sampled(codes, count), self.codebook(codes.sparkSession)).select(F.slice("e", 1, part).alias("e")).collect()]
        return ti.index_codes(codes, self.centroids, np.array(lloyd(decoded, seeds, 5)).reshape(len(seeds), part), path, n)

    def search(self, queries: DataFrame, codes: DataFrame, k: int, visit: float = 1.0, index: ti.Index | None = None) -> DataFrame:
        """ADC neighbours by the strategy of the parameters.

        TI prunes by the triangle inequality, or, with ``visit`` below 1, looks at that share of the clusters alone, and needs
        the ``index`` that ``index`` gave. FAST learns from the tables of a sample of rows.
        """
        name = self.params.strategy
        if name == "TI":
            if index is None:
                raise ValueError("TI needs an index")
            turned = self.rotate(queries.select("query_id", "qe"), "qe").withColumn("qe", F.slice("qe", 1, sum(c.shape[1] for c in self.centroids)))
            return ti.search(index, turned, k, visit)[0]
        luts = self.tables(queries)
        if name in ("FAST", "FAST3"):
            decoded = sampled(pq.decode(codes, self.codebook(codes.sparkSession)), self.params.rows_per_centroid).select(F.col("vec_id").alias("query_id"), F.col("e").alias("qe"))
            model = pq.learned_quantization(pq.tables(decoded, self.codebook(codes.sparkSession)))
            split = max((s + 1 for s, b in enumerate(self.bits) if b > 4), default=0)
            return pq.search_quantized(luts, model, codes, k) if name == "FAST" else pq.search_hybrid(luts, model, codes, k, split)
        return pq.search(luts, codes, k, {"EA": "ea", "FAST2": "fast2", "SORT": "sort"}.get(name, "heap"))

    def save(self, spark: SparkSession, path: str, codes: DataFrame | None = None, indexed: bool = False) -> None:
        """Writes the model to ``path``, with the ``codes`` it is given and, if asked for, their TI index.

        All goes to a folder of its own; then the file that names the model's folder is exchanged, so a reader finds the old model
        or the new one, whole. The old one's folder is removed.
        """
        folder = f"{path}/model-{uuid.uuid4().hex}"
        index = None
        if codes is not None:
            codes.select("vec_id", "codes").write.parquet(f"{folder}/codes")
            if indexed:
                index = self.index(spark.read.parquet(f"{folder}/codes"), f"{folder}/index")
        p = self.params
        row = (p.budget, p.subspaces, p.least, p.most, p.share, p.strategy, p.clusters, p.segments, p.segment_share, p.clustering, list(p.bits), p.rows_per_centroid, self.axes.tolist(), self.variances.tolist(), self.bits, None if index is None else index.centres.tolist())
        names = "budget int, subspaces int, least int, most int, share double, strategy string, clusters int, segments int, segment_share double, clustering string, asked array<int>, rows_per_centroid int, axes array<array<double>>, variances array<double>, bits array<int>, centres array<array<double>>"
        spark.createDataFrame([row], names).write.parquet(f"{folder}/model")
        self.codebook(spark).write.parquet(f"{folder}/codebook")
        system, place = vectors.located(path)
        before = current_model(path)
        with system.open_output_stream(f"{place}/_next.json") as out:
            out.write(json.dumps({"folder": folder.rpartition("/")[2]}).encode())
        system.move(f"{place}/_next.json", f"{place}/{CURRENT}")
        if before:
            system.delete_dir(f"{place}/{before}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vaq:
        folder = f"{path}/{current_model(path)}"
        r = spark.read.parquet(f"{folder}/model").first()
        params = VaqParams(r.budget, r.subspaces, r.least, r.most, r.share, r.strategy, r.clusters, r.segments, r.segment_share, r.clustering, tuple(r.asked), r.rows_per_centroid)
        return cls(params, np.array(r.axes), np.array(r.variances), list(r.bits), pq.dictionaries_of(spark.read.parquet(f"{folder}/codebook")))

    def stored(self, spark: SparkSession, path: str) -> tuple[DataFrame, ti.Index | None]:
        """The codes that were saved with the model at ``path``, and their index if there is one."""
        folder = f"{path}/{current_model(path)}"
        centres = spark.read.parquet(f"{folder}/model").first().centres
        codes = spark.read.schema("vec_id bigint, codes array<int>").parquet(f"{folder}/codes")
        if centres is None:
            return codes, None
        part = None if self.ti_segments() == len(self.centroids) else len(centres[0])
        return codes, ti.Index.open(spark, f"{folder}/index", np.array(centres), part, self.centroids)


#: Names the folder of the model that counts.
CURRENT = "_current.json"


def current_model(path: str) -> str | None:
    system, place = vectors.located(path)
    if system.get_file_info(f"{place}/{CURRENT}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{place}/{CURRENT}") as f:
        return json.loads(f.read())["folder"]


def learned(rows: DataFrame, pieces: list[tuple[int, int, int]], clustering: str) -> list[np.ndarray]:
    """The dictionary of each piece (first dimension, dimensions, bits) of ``rows`` (vec_id, e), a sample of bounded size. One piece a task."""
    parts = rows.select("vec_id", F.posexplode(F.array(*[F.slice("e", a + 1, n) for a, n, _ in pieces])).alias("piece", "x"))

    def learn(group: pa.Table) -> pa.Table:
        i = group.column("piece")[0].as_py()
        group = group.sort_by("vec_id").combine_chunks()
        x, b = matrix(group.column("x").combine_chunks())[0], pieces[i][2]
        centres = binary(x, b) if clustering == "binary" else hierarchical(x, b) if clustering == "hierarchical" and b > 1 or b > FLAT_BITS else _numpy_lloyd(x, 1 << b)
        return pa.table({"piece": pa.array([i] * len(centres), pa.int32()), "code": pa.array(range(len(centres)), pa.int32()), "centroid": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    found = parts.groupBy("piece").applyInArrow(learn, "piece int, code int, centroid array<double>").orderBy("piece", "code").collect()  # the dictionaries
    by: dict[int, list[list[float]]] = {}
    for r in found:
        by.setdefault(r.piece, []).append(r.centroid)
    return [np.array(by[i]) for i in range(len(pieces))]


def grid(base: DataFrame, queries: DataFrame, truth: DataFrame, k: int, choices: list[VaqParams]) -> list[tuple[VaqParams, float]]:
    """The recall of each choice of parameters, best first; choices that can't be met are left out.

    Choices share what they can: the Gram matrix is computed once, rows are rotated once for each number of subspaces, a
    dictionary of a subspace and a number of bits is learned once, and one pass over the base encodes rows in all of these
    and scores every choice. The sample is as large as the most bits of any choice ask for.
    """
    g = gram_matrix(base)
    asked = truth.count()
    found: dict[int, int] = {}
    fits: list[tuple[int, VaqParams]] = []
    for count in sorted({p.subspaces for p in choices}):
        axes, values, size = rotation(g, count)
        share = shares(values, count)
        own: list[tuple[int, list[int]]] = []
        for i, p in enumerate(choices):
            try:
                if p.subspaces == count:
                    own.append((i, bits_of(share[:retained(share, p.share)], p)))
            except ValueError:
                continue
        if not own:
            continue
        for kind in sorted({choices[i].clustering for i, _ in own}):
            some = [(i, bits) for i, bits in own if choices[i].clustering == kind]
            pairs = sorted({(s, b) for _, bits in some for s, b in enumerate(bits)})
            rows = max(choices[i].rows_per_centroid for i, _ in some) << max(b for _, b in pairs)
            books = dict(zip(pairs, learned(turned(sampled(base.select("vec_id", "e"), rows), "e", axes), [(s * size, size, b) for s, b in pairs], kind)))
            for block in search.query_blocks(queries):
                scored = _scored(turned(base.select("vec_id", "e"), "e", axes), turned(block.select("query_id", "qe"), "qe", axes), books, size, [bits for _, bits in some], k)
                for r in scored.join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("choice").count().collect():
                    i = some[r.choice][0]
                    found[i] = found.get(i, 0) + r["count"]
        fits += [(i, choices[i]) for i, _ in own]
    return sorted(((p, found.get(i, 0) / max(1, asked)) for i, p in sorted(fits)), key=lambda x: -x[1])


def _scored(rows: DataFrame, queries: DataFrame, books: dict[tuple[int, int], np.ndarray], size: int, allocations: list[list[int]], k: int) -> DataFrame:
    """(choice, query_id, vec_id): the k nearest rows of each query by the codes of each allocation, from one pass over the rows."""
    asked = queries.toArrow()  # a block
    q, at = finite(asked.column("qe").combine_chunks())
    ids = asked.column("query_id").to_numpy()[at]
    tables = {(s, b): ((q[:, None, s * size:(s + 1) * size] - c[None]) ** 2).sum(axis=2) for (s, b), c in books.items()}
    column = {pair: c for c, pair in enumerate(books)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [search.Best(len(q), k) for _ in allocations]
        for batch in batches:
            x, at = finite(batch.column(1))
            if not len(at) or not len(q):
                continue
            names = batch.column(0).to_numpy()[at]
            codes = np.stack([nearest(x[:, s * size:(s + 1) * size], c, 9) for (s, _), c in books.items()], axis=1)
            for own, bits in zip(best, allocations):
                places = [(tables[s, b], column[s, b]) for s, b in enumerate(bits)]

                def distances(some: slice, x: np.ndarray, places=places) -> np.ndarray:
                    return np.round(reduce(np.add, (np.take(t[some], x[:, c], axis=1) for t, c in places)), 6)

                search.blocks_of(codes, names, own, len(q), lambda: 1, distances)
        for choice, own in enumerate(best):
            for rows in own.batch(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, choice, np.int32)), *rows.columns], ["choice", "query_id", "vec_id", "dist"])

    best = Window.partitionBy("choice", "query_id").orderBy("dist", "vec_id")
    return search.spread(rows, len(q)).mapInArrow(run, "choice int, query_id bigint, vec_id bigint, dist double").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("choice", "query_id", "vec_id")
