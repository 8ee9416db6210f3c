"""Trees of k-means centres, trained level by level over all rows.

A row descends from the root to the nearest centre of each level; the nodes of a level are fitted together, each round
being one job in which tasks send the sum and the number of the rows of each centre. The driver holds the tree, which
is bounded by 2**MAX_BITS centres, and never a row but for the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions.matrices import finite, lists

MAX_BITS = 15
#: Differences that are worked out at once, and centres of a node up to which nodes are worked out together.
CELLS, FEW = 1 << 21, 4


@dataclass
class Node:
    """``want`` centres are fitted to the rows of a node; a row goes on to child ``first`` + i for centre i once the node is split."""

    want: int
    bits: int
    flat: bool = False
    centres: np.ndarray | None = None
    counts: np.ndarray | None = None
    first: int = -1
    #: Stands for a node without rows.
    spare: np.ndarray | None = None


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    step = max(1, CELLS // max(1, centres.size))
    for at in range(0, len(x), step):
        out[at:at + step] = np.round(((x[at:at + step, None] - centres[None]) ** 2).sum(axis=2), 9).argmin(axis=1)
    return out


def by_node(nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(nodes, kind="stable")
    found, first = np.unique(nodes[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


class Choices:
    """The nearest of a node's own centres for rows of many nodes at once. Nodes of few centres are worked out together, others one by one."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.large = {n: c for n, c in centres.items() if len(c) > FEW}
        few = {n: c for n, c in centres.items() if len(c) <= FEW}
        self.size = max(centres, default=-1) + 1
        self.kind = np.full(self.size + 1, -1)  # the last stands for all other nodes
        self.stack = np.full((len(few), FEW, next(iter(centres.values())).shape[1] if centres else 0), np.inf)
        for i, (n, c) in enumerate(few.items()):
            self.kind[n], self.stack[i, :len(c)] = i, c
        self.kind[list(self.large)] = -2

    def of(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The number of the nearest centre; -1 for rows whose node has none."""
        out = np.full(len(x), -1)
        kind = self.kind[np.minimum(nodes, self.size)]
        some = np.flatnonzero(kind >= 0)
        step = max(1, CELLS // max(1, FEW * x.shape[1]))
        for at in range(0, len(some), step):
            rows = some[at:at + step]
            out[rows] = np.round(((x[rows, None] - self.stack[kind[rows]]) ** 2).sum(axis=2), 9).argmin(axis=1)
        rest = np.flatnonzero(kind == -2)
        for n, rows in by_node(nodes[rest]) if len(rest) else ():
            out[rest[rows]] = closest(x[rest[rows]], self.large[n])
        return out


class Descent:
    """The node that each row comes to: from the root on, the child of the nearest centre while a node is split."""

    def __init__(self, splits: dict[int, tuple[np.ndarray, int]]):
        self.choices = Choices({n: c for n, (c, _) in splits.items()})
        self.first = np.zeros(self.choices.size + 1, np.int64)
        for n, (_, first) in splits.items():
            self.first[n] = first

    def of(self, x: np.ndarray) -> np.ndarray:
        nodes, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(open_):
            which = self.choices.of(x[open_], nodes[open_])
            on = which >= 0
            open_ = open_[on]
            nodes[open_] = self.first[nodes[open_]] + which[on]
        return nodes


def _seeds(points: DataFrame, splits: dict, wants: dict[int, int]) -> dict[int, np.ndarray]:
    """The first rows by vec_id of each node, as many as it wants."""
    most = max(wants.values())
    wanted = np.zeros(max(wants) + 2, np.int64)
    for n, k in wants.items():
        wanted[n] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent = Descent(splits)
        for batch in batches:
            x, at = finite(batch.column(1))
            if len(at):
                names, node = batch.column(0).to_numpy()[at], descent.of(x)
                order = np.lexsort((names, node))
                first = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0])
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
                rows = order[place < wanted[np.minimum(node[order], len(wanted) - 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(names[rows]), lists(x[rows])], ["node", "vec_id", "e"])

    found = points.select("vec_id", "e").mapInArrow(run, "node bigint, vec_id bigint, e array<double>")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("r") <= most)
    by: dict[int, list[tuple[int, list[float]]]] = {}
    for r in ranked.collect():  # as many rows as there are centres to fit
        by.setdefault(r.node, []).append((r.vec_id, r.e))
    return {n: np.array([e for _, e in sorted(rows)[:wants[n]]]) for n, rows in by.items()}


def _sums(points: DataFrame, splits: dict, fits: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sums, counts) of the rows of each centre of the nodes that are fitted."""
    starts, at = {}, 0
    for n, c in fits.items():
        starts[n], at = at, at + len(c)
    size, dims = at, next(iter(fits.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent, choices = Descent(splits), Choices(fits)
        start = np.zeros(choices.size + 1, np.int64)
        for n, a in starts.items():
            start[n] = a
        sums, counts = np.zeros((size, dims)), np.zeros(size, np.int64)
        for batch in batches:
            x, at = finite(batch.column(0))
            if len(at):
                node = descent.of(x)
                which = choices.of(x, node)
                rows = np.flatnonzero(which >= 0)
                place = start[node[rows]] + which[rows]
                np.add.at(sums, place, x[rows])
                counts += np.bincount(place, minlength=size)
        some = np.flatnonzero(counts)
        k, i = np.repeat(some, dims), np.tile(np.arange(dims), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(sums[some].ravel()), pa.array(counts[k])], ["k", "i", "s", "n"])

    found = points.select("e").mapInArrow(run, "k bigint, i bigint, s double, n bigint").groupBy("k", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums, counts = np.zeros((size, dims)), np.zeros(size, np.int64)
    for r in found:
        sums[r.k, r.i], counts[r.k] = r.s, r.n
    return {n: (sums[a:a + len(fits[n])], counts[a:a + len(fits[n])]) for n, a in starts.items()}


def _fitted(points: DataFrame, nodes: list[Node], some: list[int], rounds: int) -> None:
    """Lloyd's steps for the nodes ``some`` together: a node ends when its centres stay as they are, or after ``rounds``."""
    splits = {n: (x.centres, x.first) for n, x in enumerate(nodes) if x.first >= 0}
    seeds = _seeds(points, splits, {n: nodes[n].want for n in some})
    for n in some:
        nodes[n].centres, nodes[n].counts = seeds.get(n, nodes[n].spare), None
    open_ = [n for n in some if n in seeds]
    for _ in range(rounds + 1):
        if not open_:
            return
        found = _sums(points, splits, {n: nodes[n].centres for n in open_})
        on = []
        for n in open_:
            sums, counts = found[n]
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], nodes[n].centres)
            nodes[n].counts = counts
            if not np.allclose(new, nodes[n].centres, rtol=0, atol=1e-12) and _ < rounds:
                nodes[n].centres = new
                on.append(n)
        open_ = on


def _split(nodes: list[Node], n: int, kids: list[Node]) -> list[int]:
    nodes[n].first = len(nodes)
    nodes.extend(kids)
    return list(range(nodes[n].first, len(nodes)))


def _leaves(nodes: list[Node], n: int = 0) -> list[np.ndarray]:
    node = nodes[n]
    if node.first < 0:
        return [] if node.centres is None else [node.centres]
    return [c for i in range(len(node.centres)) for c in _leaves(nodes, node.first + i)]


def hierarchical(points: DataFrame, bits: int, coarse: int = 7, rounds: int = 25) -> np.ndarray:
    """2**bits centres of (vec_id, e): 2**coarse first, then the rest within each of their cells. A cell without rows keeps its centre.

    Vectors that are null or not finite count for nothing; without others there are no centres.
    """
    _checked(bits)
    nodes = [Node(1 << min(coarse, bits), bits)]
    _fitted(points, nodes, [0], rounds)
    top = nodes[0].centres
    if top is None:
        return np.zeros((0, 0))
    fine = max(1, (1 << bits) // len(top))
    _fitted(points, nodes, _split(nodes, 0, [Node(fine, 0, spare=c[None]) for c in top]), rounds)
    return np.concatenate(_leaves(nodes))


def binary(points: DataFrame, bits: int, rounds: int = 25) -> np.ndarray:
    """2**bits centres of (vec_id, e) by repeated halving; where a side has too few rows for its subtree, that is clustered flat.

    All nodes of a level are halved together. Nulls and empty tables as in ``hierarchical``.
    """
    _checked(bits)
    nodes, level = [Node(2 if bits else 1, bits)], [0]
    while level:
        _fitted(points, nodes, level, rounds)
        cut, on = [], []
        for n in level:
            node = nodes[n]
            if node.bits == 0 or node.flat or node.centres is None:
                continue
            counts = node.counts if len(node.centres) == 2 else np.r_[node.counts, 0]
            if counts.sum() <= 1:
                continue  # one row stands for itself
            if counts.min() < 1 << (node.bits - 1):
                node.flat, node.want = True, 1 << node.bits
                cut.append(n)
            else:
                on += _split(nodes, n, [Node(2 if node.bits > 1 else 1, node.bits - 1) for _ in range(2)])
        if cut:
            _fitted(points, nodes, cut, rounds)
        level = on
    found = _leaves(nodes)
    return np.concatenate(found) if found else np.zeros((0, 0))


def _checked(bits: int) -> None:
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"between 0 and {MAX_BITS} bits")
