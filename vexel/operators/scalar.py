"""Scalar quantization of each dimension by quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.functions import expr
from vexel.operators import selection

def cells(base: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, dim, x) of all dimensions, or of the first ``dims``."""
    return base.select("vec_id", F.posexplode("e" if dims is None else F.slice("e", 1, dims)).alias("dim", "x"))


def hazen_thresholds(values: DataFrame, count: int) -> DataFrame:
    """(dim, q, value): ``count`` thresholds at the shares q / (count + 1), by Hazen's rule.

    The position (1 - p) * -0.5 + p * (n - 0.5) lies between two order statistics and is interpolated; it is clamped at the
    ends. Order statistics are exact whatever the number of rows.
    """
    p = F.col("q") / (count + 1)
    pos = F.least(F.greatest((1 - p) * -0.5 + p * (F.col("n") - 0.5), F.lit(0.0)), F.col("n") - 1.0)
    at = values.groupBy("dim").agg(F.count("x").alias("n")).filter("n > 0").withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(count))))
    at = at.select("dim", "q", "n", pos.alias("pos")).withColumn("low", F.floor("pos").cast("bigint")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    ranks = at.select("dim", "n", F.explode(F.array("low", "high")).alias("rank")).distinct()
    stats = selection.order_statistics(values.filter("x is not null"), ranks).select("dim", "rank", "value")
    both = at.join(F.broadcast(stats.withColumnsRenamed({"rank": "low", "value": "a"})), ["dim", "low"]).join(F.broadcast(stats.withColumnsRenamed({"rank": "high", "value": "b"})), ["dim", "high"])
    return both.select("dim", "q", (F.col("a") + (F.col("pos") - F.col("low")) * (F.col("b") - F.col("a"))).alias("value"))


def vector_thresholds(base: DataFrame, dims: int, count: int) -> DataFrame:
    """(dim, q, value) as of ``hazen_thresholds``, of the first ``dims`` dimensions of the vectors ``e``, of which no rows of components are made."""
    found = selection.quantiles(base.select("e"), [[q / (count + 1) for q in range(1, count + 1)]] * dims)
    return base.sparkSession.createDataFrame([(d, q, float(x)) for d, own in enumerate(found) for q, x in enumerate(own, 1)], "dim int, q int, value double")


def bucket_codes(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(vec_id, dim, x, code): the first threshold that x doesn't exceed, else their count."""
    book = thresholds.groupBy("dim").agg(F.sort_array(F.collect_list("value")).alias("t"))
    code = F.size(F.filter("t", lambda t: t < F.col("x")))
    return values.join(F.broadcast(book), "dim").select("vec_id", "dim", "x", code.alias("code"))


def bucket_means(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(dim, code, centre): the mean of each bucket, or the middle of its ends where it is empty."""
    coded = bucket_codes(values, thresholds).groupBy("dim", "code").agg(F.avg("x").alias("centre"))
    ends = values.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    book = thresholds.groupBy("dim").agg(F.sort_array(F.collect_list("value")).alias("t")).join(ends, "dim")
    edges = F.concat(F.array("lo"), F.col("t"), F.array("hi"))
    cells_ = book.select("dim", edges.alias("e")).select("dim", F.posexplode(F.transform(F.slice("e", 1, F.size("e") - 1), lambda x, i: (x + F.get("e", i + 1)) / 2)).alias("code", "middle"))
    return cells_.join(coded, ["dim", "code"], "left").select("dim", "code", F.coalesce("centre", "middle").alias("centre"))


def codebook(means: DataFrame) -> DataFrame:
    """Bucket means as a codebook with one dimension a subspace, for encoding to the nearest mean and look-up search."""
    return means.select(F.col("dim").alias("subspace"), "code", F.array("centre").alias("centroid"))


def packed(coded: DataFrame, dims: int, bits: int) -> DataFrame:
    """(vec_id, words): the codes of each row's dimensions in one bit vector."""
    codes = F.transform(F.sort_array(F.collect_list(F.struct("dim", "code"))), lambda c: c["code"])
    return coded.groupBy("vec_id").agg(codes.alias("codes")).select("vec_id", expr.pack(F.col("codes"), [bits] * dims).alias("words"))
