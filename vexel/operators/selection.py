"""Exact order statistics of any number of rows: a sketch brackets them, and only the bracket's distinct values are sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions.matrices import finite

#: The rank of a sketched percentile is off by at most one part in so many, and a bracket is so many such parts wide on either side.
ACCURACY, MARGIN = 10_000, 3


def order_statistics(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(dim, rank, value, upto): the value of each rank (from 0, at most MARGIN * 100 a dim) among the rows (dim, x), and how many rows are at most that value.

    ``ranks`` holds (dim, rank, n), n being the rows of the dim. Neither a dim's rows nor those of a common value meet in
    a task: below the bracket rows are counted, and within it the distinct values are.
    """
    wanted = ranks.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("rank")).alias("ranks"))
    margin = MARGIN / ACCURACY
    steps = 2 * ACCURACY // MARGIN
    shares = ", ".join(f"{i / steps!r}D" for i in range(steps + 1))
    grid = values.groupBy("dim").agg(F.expr(f"percentile_approx(x, array({shares}), {ACCURACY})").alias("grid"), F.min("x").alias("least"), F.max("x").alias("most"))
    place = lambda share, away: F.get("grid", (F.floor(share * steps) + away).cast("int"))
    share = lambda r: (r + 0.5) / F.col("n")
    bracket = lambda r: F.struct(r.alias("rank"), F.coalesce(F.when(share(r) > 2 * margin, place(share(r), -2)), F.col("least")).alias("lo"), F.coalesce(F.when(share(r) < 1 - 2 * margin, place(share(r), 3)), F.col("most")).alias("hi"))
    brackets = wanted.join(grid, "dim").select("dim", F.transform("ranks", bracket).alias("brackets"))
    one = values.join(F.broadcast(brackets), "dim").select("dim", "x", F.explode("brackets").alias("b")).select("dim", "x", "b.*").filter(F.col("x") <= F.col("hi"))
    # A null value stands for all that lie below the bracket.
    counts = one.groupBy("dim", "rank", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("dim", "rank").orderBy(F.col("x").asc_nulls_first()))
    found = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & F.col("x").isNotNull())
    return found.groupBy("dim", "rank").agg(F.min_by("x", "upto").alias("value"), F.min("upto").alias("upto"))


def least_rows(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """The rows of the ``size`` least keys, ties at the end left out where they would be too many; nothing is sorted on the driver."""
    n = rows.count()
    if n <= size:
        return rows
    keys = rows.select(F.lit(0).alias("dim"), key.alias("x"))
    one = rows.sparkSession.createDataFrame([(0, size - 1, n)], "dim int, rank bigint, n bigint")
    last = order_statistics(keys, one).first()
    return rows.filter(key <= last.value if last.upto <= size else key < last.value)


def draws(spark: SparkSession, n: int, size: int, batches: int = 1, seed: int = 17) -> DataFrame:
    """(draw, vec_id): ``size`` draws with replacement from the positions 0 to ``n`` - 1, an equal share from each of ``batches`` runs of them.

    Where the draws don't divide, the first runs give one more. Draw i of a run takes the position that the MD5 of
    seed:run:i gives.
    """
    if not n:
        return spark.range(0).select(F.col("id").alias("draw"), F.col("id").alias("vec_id"))
    per, more = divmod(size, batches)
    split = more * (per + 1)
    after = F.lit(more) + ((F.col("id") - split) / max(1, per)).cast("bigint")
    rows = spark.range(size).withColumn("batch", F.when(F.col("id") < split, (F.col("id") / (per + 1)).cast("bigint")).otherwise(after))
    first, last = (F.floor(F.lit(n) * (F.col("batch") + o) / batches).cast("bigint") for o in (0, 1))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("batch"), F.col("id")).cast("binary")), 1, 12), 16, 10).cast("bigint")
    return rows.select(F.col("id").alias("draw"), (first + number % F.greatest(last - first, F.lit(1))).alias("vec_id"))


def quantiles(rows: DataFrame, shares: list[list[float]]) -> list[np.ndarray]:
    """For each dimension of the vectors ``e``, the quantiles of the given rising shares by Hazen's rule, exact at any size.

    A sketch brackets the order statistics; one pass counts what lies below a bracket and the distinct values within. Only
    values within brackets leave a task. Vectors that are null or not finite count for nothing; without others there are none.
    """
    wanted = [d for d, s in enumerate(shares) if s]
    if not wanted:
        return [np.zeros(0) for _ in shares]
    steps = 2 * ACCURACY // MARGIN
    grid_of = ", ".join(f"{i / steps!r}D" for i in range(steps + 1))
    fine = rows.filter(F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    cells = fine.select(F.posexplode("e").alias("dim", "x")).filter(F.col("dim").isin(wanted))
    grids = cells.groupBy("dim").agg(F.expr(f"percentile_approx(x, array({grid_of}), {ACCURACY})").alias("grid"), F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("n")).collect()  # a row a dimension
    n = grids[0].n if grids else 0
    if not n:
        return [np.zeros(0) for _ in shares]
    places = {d: np.clip((1 - np.array(shares[d])) * -0.5 + np.array(shares[d]) * (n - 0.5), 0, n - 1) for d in wanted}
    ranks = {d: np.unique(np.r_[np.floor(p), np.minimum(np.floor(p) + 1, n - 1)]).astype(np.int64) for d, p in places.items()}
    brackets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    margin = MARGIN / ACCURACY
    for r in grids:
        share, grid = (ranks[r.dim] + 0.5) / n, np.array(r.grid)
        at = np.floor(share * steps).astype(int)
        brackets[r.dim] = (np.where(share > 2 * margin, grid[np.clip(at - 2, 0, steps)], r.least), np.where(share < 1 - 2 * margin, grid[np.clip(at + 3, 0, steps)], r.most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = {d: np.zeros(len(lo), np.int64) for d, (lo, _) in brackets.items()}
        for batch in batches:
            x, at = finite(batch.column(0))
            if not len(at):
                continue
            for d, (lo, hi) in brackets.items():
                column, times = np.unique(x[:, d], return_counts=True)
                first, stop = np.searchsorted(column, lo, side="left"), np.searchsorted(column, hi, side="right")
                below[d] += np.r_[0, np.cumsum(times)][first]
                size = np.maximum(stop - first, 0)
                which = np.repeat(np.arange(len(lo)), size)
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), d, np.int32)), pa.array(which.astype(np.int32)), pa.array(column[inside]), pa.array(times[inside])], ["dim", "i", "x", "c"])
        for d, c in below.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), d, np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array([None] * len(c), pa.float64()), pa.array(c)], ["dim", "i", "x", "c"])

    counts = rows.select("e").mapInArrow(run, "dim int, i int, x double, c bigint").groupBy("dim", "i", "x").agg(F.sum("c").alias("c"))
    table = rows.sparkSession.createDataFrame([(d, i, int(k)) for d, own in ranks.items() for i, k in enumerate(own)], "dim int, i int, rank bigint")
    upto = F.sum("c").over(Window.partitionBy("dim", "i").orderBy(F.col("x").asc_nulls_first()))
    found = counts.withColumn("upto", upto).join(F.broadcast(table), ["dim", "i"]).filter((F.col("upto") > F.col("rank")) & F.col("x").isNotNull())
    values = {(r.dim, r["rank"]): r.x for r in found.groupBy("dim", "rank").agg(F.min_by("x", "upto").alias("x")).collect()}  # two a quantile
    out = []
    for d in range(len(shares)):
        at = places.get(d, np.zeros(0))
        a = np.array([values[d, int(p)] for p in np.floor(at)])
        b = np.array([values[d, int(min(p + 1, n - 1))] for p in np.floor(at)])
        out.append(a + (at - np.floor(at)) * (b - a))
    return out
