"""Exact top-k inner products by MaxScore.

Each component is a term with a posting for every vector. Within a shard, a term's contribution to a query lies between
two bounds; a query's terms are split, by the spread between them, into essential ones and others that alone can't lift
a vector into the best k. Essential postings are added up for all vectors, the others are probed while a vector stays
competitive. A query starts from the k-th score among a sample of vectors, which is known to all shards. Blocks of
queries are broadcast, the vectors are scanned where they lie, and the best k of the shards are merged. Sums beyond what doubles hold
exactly only choose candidates, whose scores are then worked out in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.common import stored

SCALE = 256
#: Bytes of a shard's and of a query block's postings, vectors whose postings are added up at once, and vectors from which queries get their first threshold.
SHARD_BYTES, QUERY_BYTES, STEP, SAMPLED = 32 << 20, 16 << 20, 4_096, 4_096
#: Other terms probed before vectors are dropped again.
PROBED = 8
#: Whole numbers up to which sums of doubles are exact, and the most that a score can be; larger ones are cut off there.
EXACT, LONG = float(1 << 53), (1 << 63) - 1


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """floor(SCALE * x) of a column of lists; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def merge(ids: np.ndarray, scores: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The best k, and with a ``slack`` those that may be among them."""
    best = np.lexsort((ids, -scores))
    if len(best) > k and slack:
        best = best[:max(k, int(np.searchsorted(-scores[best], -(scores[best[k - 1]] - slack), side="right")))]
    else:
        best = best[:k]
    return ids[best], scores[best]


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: float, slack: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, multiplications): the best k of the shard ``x`` (vectors by term) for one query. Scores below ``floor`` can't be among the best of all; sums are off by ``slack`` / 2 at most."""
    found_ids, found, work = np.zeros(0, np.int64), np.zeros(0), 0
    for at in range(0, len(ids), STEP):
        part, names = x[at:at + STEP], ids[at:at + STEP]
        low, high = part.min(axis=0), part.max(axis=0)
        top, least = np.maximum(q * low, q * high), np.minimum(q * low, q * high)
        terms = np.argsort(-(top - least), kind="stable")
        rest = np.append(np.cumsum(top[terms][::-1])[::-1], 0)  # the most that terms from this one on can add
        bar = max(floor, found[k - 1] if len(found) >= k else -np.inf) - slack
        if rest[0] < bar:
            continue
        # Others: the terms whose spread, together, doesn't bridge the way from the least score to the bar.
        spread = np.append(np.cumsum((top - least)[terms][::-1])[::-1], 0)
        split = int(np.argmax(spread < bar - least.sum())) if bar > least.sum() else len(terms)
        essential = terms[:split]
        alive, score = np.arange(len(names)), part[:, essential] @ q[essential]
        work += len(names) * split
        while split < len(terms):
            stay = score + rest[split] >= bar
            alive, score = alive[stay], score[stay]
            if not len(alive):
                break
            probed = terms[split:split + PROBED]
            score = score + part[np.ix_(alive, probed)] @ q[probed]
            work += len(alive) * len(probed)
            split += len(probed)
        other = (names[alive] != own) & (score >= bar)
        found_ids, found = merge(np.append(found_ids, names[alive][other]), np.append(found, score[other]), k, slack)
    return found_ids, found, work


def whole(column: pa.Array, i: int) -> list[int]:
    """The components of vector i as whole numbers of any size."""
    return [math.floor(Fraction(v) * SCALE) for v in column[i].as_py()]


def best_of(column: pa.Array, names: np.ndarray, queries: pa.Table, k: int) -> tuple[list[np.ndarray], int]:
    """((query ids, vec_ids, scores), multiplications): the best k of a shard for every query of a block (vec_id, embedding, floor)."""
    asked = queries.column("embedding").combine_chunks()
    with np.errstate(over="ignore", invalid="ignore"):
        x, q = matrix(column), matrix(asked)
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    work, most = 0, np.abs(x).max(initial=0)
    for i, (own, floor) in enumerate(zip(queries.column("vec_id").to_pylist(), queries.column("floor").to_pylist())):
        bound = float(np.abs(q[i]).sum()) * float(most) if most else 0.0
        exact = bound < EXACT
        if exact:
            found, scores, n = search(x, names, q[i], own, k, floor, 0.0)
            scores = scores.astype(np.int64)
        elif np.isfinite(bound):
            # Each product and sum of doubles is off by one part in 2**53 of the bound, at most.
            found, _, n = search(x, names, q[i], own, k, floor, 4 * (width + 2) * bound / EXACT)
            found, scores = exact_best(column, names, found, whole(asked, i), k)
        else:
            found, scores = exact_best(column, names, names[names != own], whole(asked, i), k)
            n = len(names) * width
        work += n
        out.append((np.full(len(found), own), found, scores))
    return ([np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3), work


def exact_best(column: pa.Array, names: np.ndarray, some: np.ndarray, q: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of the rows whose vec_id is in ``some``, by whole numbers."""
    rows = np.flatnonzero(np.isin(names, some))
    scored = sorted(((-sum(a * b for a, b in zip(q, whole(column, i))), int(names[i])) for i in rows.tolist()))[:k]
    return np.array([v for _, v in scored], np.int64), np.array([max(-LONG - 1, min(LONG, -s)) for s, _ in scored], np.int64)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row whose vec_id is divisible by ``every``.

    Vectors that are null or hold a null, a NaN or an infinity, and rows without vec_id, take no part. Repeated rows count
    once; of a query's id with several vectors, the least vector is the query. Ties go to the smaller vec_id. Shorter
    vectors are filled up with zeros. Without other rows a query has no result. Scores are whole numbers, exact for components
    of any size; what a long can't hold is the largest or least long, and ties there too.
    """
    spark = vectors.sparkSession
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    rows = stored(rows.repartition(max(spark.sparkContext.defaultParallelism, 1)) if vectors.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else rows, "maxscore-vectors")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    sample = spark.sparkContext.broadcast(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED).toArrow().combine_chunks())

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th best score among the sampled vectors, a little less where it isn't exact."""
        few = sample.value
        names = few.column("vec_id").to_numpy()
        for batch in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                x, q = matrix(few.column("embedding")), matrix(batch.column(1))
                wide = max(q.shape[1], x.shape[1])
                q, x = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, x))
                out = np.full(len(q), -np.inf)
                for i, own in enumerate(batch.column(0).to_pylist()):
                    s = (x @ q[i])[names != own]
                    bound = np.abs(q[i]).sum() * np.abs(x).max(initial=0)
                    # Repeated ids would count twice.
                    if len(s) >= k and np.isfinite(bound) and len(np.unique(names)) == len(names):
                        out[i] = np.partition(s, len(s) - k)[len(s) - k] - (0 if bound < EXACT else 4 * (wide + 2) * bound / EXACT)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["vec_id", "embedding", "floor"])

    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(asked.mapInArrow(floors, "vec_id bigint, embedding array<double>, floor double"), "maxscore-queries")
    blocks = max(1, math.ceil(asked.count() * width * 8 / QUERY_BYTES))
    found = None
    for b in range(blocks):
        block = spark.sparkContext.broadcast(asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks())  # some QUERY_BYTES

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def shard() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                columns, _ = best_of(table.column("embedding").combine_chunks(), table.column("vec_id").to_numpy(), block.value, k)
                return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(x.nbytes for x in held) >= SHARD_BYTES:
                    yield shard()
            if held:
                yield shard()

        part = rows.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
