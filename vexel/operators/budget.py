"""Encoders with a budget of bits over dimensions: thresholds packed into words, and bucket means with look-up tables.

Principal components get bits by their variance, each dimension a width of its own. Quantiles are exact whatever the number of
rows; what is solved on the driver is of the size of the dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.functions.matrices import finite, matrix
from vexel.operators import pq, selection, training

#: Bits of a dimension, at most, and the share of an even allocation's variance up to which a dimension gets a bit.
MOST, SHARE = 8, 0.99
#: Ratios of variances beyond this power of two don't count.
STEEPEST = 10


def _staircase(weights: np.ndarray, low: np.ndarray, steps: np.ndarray, more: bool) -> np.ndarray | None:
    """The integers x with low <= x <= MOST and x[i] - x[i + 1] <= steps[i] of the largest weighted sum; of equal ones with the most (or fewest) bits. None if there are none."""
    d = len(weights)
    sign = 1 if more else -1
    best = np.full((d, MOST + 1, 2), -np.inf)
    follow = np.zeros((d, MOST + 1), np.int64)
    levels = np.arange(MOST + 1)
    for i in range(d - 1, -1, -1):
        for x in range(int(low[i]), MOST + 1):
            tail = np.zeros(2)
            if i < d - 1:
                fine = levels >= x - steps[i]
                value = np.where(fine, np.round(best[i + 1, :, 0], 12), -np.inf)
                if not np.isfinite(value).any():
                    continue
                tied = np.flatnonzero(value == value.max())
                y = int(tied[np.argmax(best[i + 1, tied, 1])])
                follow[i, x], tail = y, best[i + 1, y]
            best[i, x] = weights[i] * x + tail[0], sign * x + tail[1]
    if not np.isfinite(best[0, :, 0]).any():
        return None
    value = np.round(best[0, :, 0], 12)
    tied = np.flatnonzero(value == value.max())
    x = int(tied[np.argmax(best[0, tied, 1])])
    out = []
    for i in range(d):
        out.append(x)
        x = int(follow[i, x])
    return np.array(out)


def continuous(variances: np.ndarray, budget: int, low: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The real x with low <= x <= MOST, x[i] - x[i + 1] <= steps[i] and sum ``budget`` of the largest sum of variance times x.

    Without the budget the vertices are integers, so the optimum lies between two of these: those that are best at the price
    of a bit at which one takes up less than the budget and one more. ValueError if nothing meets the constraints.
    """
    a, b = _staircase(np.full(len(variances), -1.0), low, steps, False), _staircase(np.ones(len(variances)), low, steps, True)
    if a is None or a.sum() > budget or b.sum() < budget:
        raise ValueError("no allocation meets the constraints")
    while a.sum() < budget < b.sum():
        price = (variances @ b - variances @ a) / (b.sum() - a.sum())
        found = [_staircase(variances - price, low, steps, more) for more in (False, True)]
        line = (variances - price) @ a
        if (variances - price) @ found[0] <= line + 1e-10:
            break
        for x in found:
            if x.sum() <= budget:
                a = x
            if x.sum() >= budget:
                b = x
    if a.sum() == budget or b.sum() == budget:
        return (a if a.sum() == budget else b).astype(float)
    t = (budget - a.sum()) / (b.sum() - a.sum())
    return a + t * (b - a)


def allocate_dimensions(variances: np.ndarray, budget: int) -> list[int]:
    """Bits of each dimension, ``budget`` in all: the continuous optimum cut off, then a bit to each that had a fraction, then from left to right.

    ``variances`` are in descending order. A dimension has a bit at least while the variance up to it stays within SHARE of what
    one bit a dimension would explain, and MOST at most; neighbours differ by at most the power of two below the ratio of
    their variances.
    """
    if not 0 < budget <= MOST * len(variances):
        raise ValueError(f"between 1 and {MOST} bits a dimension")
    v = np.asarray(variances, float) / np.sum(variances)
    v = np.where(v < 1e-11, 1e-17, v)
    cum = np.cumsum(v)
    even = SHARE * cum[min(budget, len(v)) - 1]
    low = np.array([int(i < budget and even >= c) for i, c in enumerate(cum)])
    power = 2.0 ** np.floor(np.log2(v[:-1] / v[1:]))
    steps = np.where(power > STEEPEST, 0, np.floor(power)).astype(int)
    x = continuous(v, budget, low, steps)
    bits = np.floor(x + 1e-9).astype(int)
    for i in np.flatnonzero(x - bits > 1e-9):
        if bits.sum() < budget:
            bits[i] += 1
    while bits.sum() < budget:
        for i in range(len(bits)):
            if bits.sum() < budget and bits[i] < MOST:
                bits[i] += 1
    return bits.tolist()


def packed_words(codes: np.ndarray, bits: list[int]) -> np.ndarray:
    """The codes of each row end to end, the first highest, as words of 64 (int64); a code may straddle two words."""
    parts = [(codes[:, i, None] >> np.arange(n - 1, -1, -1)) & 1 for i, n in enumerate(bits) if n]
    single = np.concatenate(parts, axis=1).astype(np.uint8) if parts else np.zeros((len(codes), 0), np.uint8)
    wide = np.zeros((len(codes), -(-single.shape[1] // 64) * 64), np.uint8)
    wide[:, :single.shape[1]] = single
    return np.packbits(wide, axis=1).view(">u8").astype(np.int64) if wide.size else np.zeros((len(codes), 0), np.int64)


def _word_lists(words: np.ndarray, known: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(words.ravel()), mask=None if known.all() else pa.array(~known))


def hazen(rows: DataFrame, bits: list[int]) -> list[np.ndarray]:
    """The 2**bits - 1 thresholds of each dimension of ``e`` by Hazen's rule, exact at any size; none where a dimension has no bits.

    Vectors that are null or not finite count for nothing.
    """
    return selection.quantiles(rows, [[(i + 1) / (1 << n) for i in range((1 << n) - 1)] for n in bits])


@dataclass
class Signs:
    """Sign bits after a rotation to the principal axes, for base and queries alike."""

    axes: np.ndarray

    @classmethod
    def fit(cls, base: DataFrame) -> Signs:
        return cls(training.principal_axes(base)[1])

    def encode(self, rows: DataFrame, vector: str = "e", out: str = "bits") -> DataFrame:
        """``rows`` with the sign bits (ARRAY<BIGINT>) of ``vector`` in place of it, the component of the largest variance first; null for null vectors."""
        return _encoded(rows, vector, out, self.axes, lambda x: packed_words((x > 0).astype(np.int64), [1] * x.shape[1]))


def _encoded(rows: DataFrame, vector: str, out: str, axes: np.ndarray | None, words) -> DataFrame:
    turned = rows if axes is None else training.projected(rows, vector, axes)
    names = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, known = matrix(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _word_lists(words(x), known)], [*names, out])

    kept = turned.select(*names, vector)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, {out} array<bigint>")


@dataclass
class Thresholds:
    """A binary encoder of ``sum(bits)`` bits: each dimension's bucket between its quantiles, packed end to end."""

    axes: np.ndarray | None
    bits: list[int]
    thresholds: list[np.ndarray]

    @classmethod
    def fit(cls, base: DataFrame, budget: int | None = None, bits: list[int] | None = None, rotate: bool = True) -> Thresholds:
        """Learned from (vec_id, e), with the ``bits`` given or those that ``budget`` is allotted to by variance."""
        axes, bits = _axes_and_bits(base, budget, bits, rotate)
        rows = base.select("vec_id", "e")
        return cls(axes, bits, hazen(rows if axes is None else training.projected(rows, "e", axes), bits))

    def encode(self, rows: DataFrame, vector: str = "e", out: str = "words") -> DataFrame:
        """``rows`` with words (ARRAY<BIGINT>) in place of ``vector``: the code of a component is the first threshold that it doesn't exceed, else their number."""
        thresholds = self.thresholds
        bits = self.bits

        def words(x: np.ndarray) -> np.ndarray:
            codes = np.stack([np.searchsorted(t, x[:, i], side="left") for i, t in enumerate(thresholds)], axis=1) if x.size else np.zeros((len(x), len(bits)), np.int64)
            return packed_words(codes, bits)

        return _encoded(rows, vector, out, self.axes, words)


def _axes_and_bits(base: DataFrame, budget: int | None, bits: list[int] | None, rotate: bool) -> tuple[np.ndarray | None, list[int]]:
    if (bits is None) == (budget is None):
        raise ValueError("either a budget or the bits themselves")
    values, axes = training.principal_axes(base) if rotate or bits is None else (None, None)
    if bits is None:
        if not rotate:
            raise ValueError("a budget is allotted to principal components")
        bits = allocate_dimensions(np.maximum(values, 0), budget)
    return axes if rotate else None, list(bits)


@dataclass
class BucketMeans:
    """An encoder of the leading dimensions that have bits: codes are the nearest of a bucket's mean and its neighbours', searched by tables of ragged length."""

    axes: np.ndarray | None
    bits: list[int]
    thresholds: list[np.ndarray]
    means: list[np.ndarray]

    @classmethod
    def fit(cls, base: DataFrame, budget: int | None = None, bits: list[int] | None = None, rotate: bool = True) -> BucketMeans:
        """As ``Thresholds.fit``; dimensions from the first without bits on are left out."""
        axes, bits = _axes_and_bits(base, budget, bits, rotate)
        kept = bits[:bits.index(0)] if 0 in bits else bits
        rows = base.select("vec_id", "e")
        turned = rows if axes is None else training.projected(rows, "e", axes)
        thresholds = hazen(turned, kept)
        return cls(axes, kept, thresholds, bucket_means(turned, thresholds))

    def turned(self, rows: DataFrame, vector: str) -> DataFrame:
        return rows if self.axes is None else training.projected(rows, vector, self.axes)

    def codebook(self, base: DataFrame) -> DataFrame:
        """The means as a codebook of one dimension a subspace."""
        rows = [(i, c, [float(x)]) for i, m in enumerate(self.means) for c, x in enumerate(m)]
        return base.sparkSession.createDataFrame(rows, "subspace int, code int, centroid array<double>")

    def encode(self, base: DataFrame) -> DataFrame:
        """(vec_id, codes ARRAY<INT>), null for null vectors."""
        thresholds, means = self.thresholds, self.means

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, known = matrix(batch.column(1))
                codes = np.zeros((len(x), len(means)), np.int32)
                for i, (t, m) in enumerate(zip(thresholds, means)):
                    if x.size:
                        codes[:, i] = nearest_bucket(x[:, i], t, m)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(means))
                lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()), mask=None if known.all() else pa.array(~known))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["vec_id", "codes"])

        return self.turned(base.select("vec_id", "e"), "e").select("vec_id", "e").mapInArrow(run, "vec_id bigint, codes array<int>")

    def search(self, queries: DataFrame, codes: DataFrame, k: int, strategy: str = "ea") -> DataFrame:
        """Neighbours by the sums of a query's tables, one a dimension, each as long as the dimension has means."""
        rows = self.turned(queries.select("query_id", "qe"), "qe")
        book = self.codebook(queries)
        return pq.search(pq.tables(rows.withColumn("qe", F.slice("qe", 1, len(self.means))), book), codes, k, strategy)


def nearest_bucket(x: np.ndarray, thresholds: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nearest of the means of a component's bucket and of those beside it; of equals the bucket's own, then the lower."""
    own = np.searchsorted(thresholds, x, side="left")
    best, far = own.copy(), np.abs(x - means[own])
    for other in (own - 1, own + 1):
        inside = (other >= 0) & (other < len(means))
        away = np.where(inside, np.abs(x - means[np.clip(other, 0, len(means) - 1)]), np.inf)
        best = np.where(away < far, other, best)
        far = np.minimum(far, away)
    return best


def bucket_means(rows: DataFrame, thresholds: list[np.ndarray]) -> list[np.ndarray]:
    """The mean of the components in each bucket, or the middle of its ends where it is empty. A task sends one sum a bucket."""
    sizes = [len(t) + 1 for t in thresholds]
    starts = np.cumsum([0, *sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(starts[-1]), np.zeros(starts[-1], np.int64)
        low, high = np.full(len(sizes), np.inf), np.full(len(sizes), -np.inf)
        for batch in batches:
            x, at = finite(batch.column(0))
            for i, t in enumerate(thresholds):
                if len(at):
                    code = np.searchsorted(t, x[:, i], side="left") + starts[i]
                    sums += np.bincount(code, x[:, i], starts[-1])
                    n += np.bincount(code, minlength=starts[-1])
                    low[i], high[i] = min(low[i], x[:, i].min()), max(high[i], x[:, i].max())
        dim = np.repeat(np.arange(len(sizes)), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(starts[-1])), pa.array(sums), pa.array(n), pa.array(low[dim]), pa.array(high[dim])], ["bucket", "s", "n", "lo", "hi"])

    found = rows.select("e").mapInArrow(run, "bucket bigint, s double, n bigint, lo double, hi double").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by = {r.bucket: r for r in found.collect()}  # 2**MOST a dimension at most
    out = []
    for i, t in enumerate(thresholds):
        own = [by[int(b)] for b in range(starts[i], starts[i + 1])] if by else []
        edges = [own[0].lo, *t.tolist(), own[0].hi] if own else []
        out.append(np.array([r.s / r.n if r.n else (edges[c] + edges[c + 1]) / 2 for c, r in enumerate(own)]))
    return out
