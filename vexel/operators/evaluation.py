"""Evaluation of results (query_id, rank, vec_id) against the truth of the same shape, and frequent patterns of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.operators.training import sampled


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(metric, value): the mean share of the true k that are found; a short result counts against it."""
    hits = truth.filter(F.col("rank") <= k).select("query_id", "vec_id").join(result.filter(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    by_query = hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("r"))
    return by_query.agg(F.round(F.avg("r"), 6).alias("value")).select(F.lit("recall").alias("metric"), "value")


def recall_at_r(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """The share of queries whose true nearest neighbour is among the k found."""
    first = truth.filter(F.col("rank") == 1).select("query_id", "vec_id")
    found = first.join(result.filter(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("value")).select(F.lit("recall_at_r").alias("metric"), "value")


def mean_average_precision(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean over queries of (1/k) * sum over r of [result r is true] * (common members of both first r) / r."""
    a = result.filter(F.col("rank") <= k).select("query_id", "vec_id", F.col("rank").alias("ra"))
    b = truth.filter(F.col("rank") <= k).select("query_id", "vec_id", F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "vec_id"]).withColumn("both_at", F.greatest("ra", "rb"))
    # Two hits of a query meet; there are at most k of them.
    other = both.select("query_id", F.col("both_at").alias("o"))
    at = both.join(other, "query_id").groupBy("query_id", "vec_id", "ra").agg(F.sum((F.col("o") <= F.col("ra")).cast("int")).alias("common"))
    ap = at.groupBy("query_id").agg((F.sum(F.col("common") / F.col("ra")) / k).alias("ap"))
    every = truth.select("query_id").distinct().join(ap, "query_id", "left")
    return every.agg(F.round(F.avg(F.coalesce("ap", F.lit(0.0))), 6).alias("value")).select(F.lit("map").alias("metric"), "value")


def classification(result: DataFrame, labels: DataFrame, truth_labels: DataFrame, sizes: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(nn, accuracy): majority label of the first nn neighbours, ties to the smaller label. Labels are (vec_id, label)."""
    votes = result.join(labels, "vec_id").select("query_id", "rank", "label", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("nn")).filter(F.col("rank") <= F.col("nn"))
    counts = votes.groupBy("nn", "query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    won = counts.groupBy("nn", "query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("won"))
    right = won.join(truth_labels, "query_id")
    return right.groupBy("nn").agg(F.round(F.avg((F.col("won") == F.col("label")).cast("double")), 6).alias("accuracy"))


def silhouette(rows: DataFrame, digits: int = 6) -> DataFrame:
    """(score): the mean silhouette of rows (e, cluster_id) by squared distances, from sums per cluster alone: no pair of rows is formed.

    The mean squared distance of x from the members of a cluster is |x|^2 - 2 x.m + s, m being their mean vector and s
    their mean squared norm. A row alone in its cluster scores 0.
    """
    cells = rows.select("cluster_id", F.posexplode("e").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("m"))
    means = cells.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("m"))
    norm = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("s"))
    book = means.join(sizes, "cluster_id").agg(F.collect_list(F.struct("cluster_id", "m", "n", "s")).alias("book"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = rows.crossJoin(F.broadcast(book)).withColumn("d", F.transform("book", lambda c: F.struct(c["cluster_id"].alias("c"), c["n"].alias("n"), (norm - 2 * dot(F.col("e"), c["m"]) + c["s"]).alias("d"))))
    own = F.filter("d", lambda x: x["c"] == F.col("cluster_id"))[0]
    both = both.select(own["n"].alias("n"), (own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), F.array_min(F.transform(F.filter("d", lambda x: x["c"] != F.col("cluster_id")), lambda x: x["d"])).alias("b"))
    return both.agg(F.round(F.avg(F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)), digits).alias("score"))


def sample_with_truth(base: DataFrame, truth: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows of the base, chosen by hash, and all that the truth names: exact answers over it are those over the base."""
    chosen = sampled(base, size).select("vec_id").unionByName(truth.select("vec_id")).distinct()
    return base.join(chosen, "vec_id", "left_semi")


def items(codes: DataFrame) -> DataFrame:
    """(vec_id, item): one item per subspace and code, named s<subspace>_c<code>."""
    return codes.select("vec_id", F.posexplode("codes").alias("s", "c")).select("vec_id", F.concat(F.lit("s"), F.col("s"), F.lit("_c"), F.col("c")).alias("item"))


def frequent_patterns(codes: DataFrame, least: int, sizes: int = 2) -> DataFrame:
    """(items, freq): the sets of one and, for ``sizes`` 2, two codes that at least ``least`` rows have, items joined by a comma.

    A row has one item per subspace, so the pairs of a row are bounded by its subspaces; only frequent items are paired.
    """
    named = items(codes)
    ones = named.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least)
    out = ones.select(F.col("item").alias("items"), "freq")
    if sizes > 1:
        kept = named.join(ones.select("item"), "item").groupBy("vec_id").agg(F.array_sort(F.collect_list("item")).alias("l"))
        pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.concat_ws(",", a, b))))
        twos = kept.select(F.explode(pairs).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least)
        out = out.unionByName(twos)
    return out


def all_patterns(codes: DataFrame, least: int) -> DataFrame:
    """(items, freq) of every size, by the FP-growth of pyspark.ml."""
    from pyspark.ml.fpm import FPGrowth

    rows = items(codes).groupBy("vec_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=least / max(1, rows.count())).fit(rows).freqItemsets
    return found.select(F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


def minimal_patterns(patterns: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent patterns of two codes at least that hold no other such pattern of another size; ties by name."""
    split = patterns.select("items", "freq", F.split("items", ",").alias("l")).filter(F.size("l") >= 2)
    # Candidates for being held share an item.
    by_item = split.select("items", "l", F.explode("l").alias("i"))
    held = by_item.select("items", F.col("l").alias("big"), "i").join(by_item.select(F.col("items").alias("small_items"), F.col("l").alias("small"), "i"), "i")
    held = held.filter((F.size("small") < F.size("big")) & (F.size(F.array_except("small", "big")) == 0)).select("items").distinct()
    return split.join(held, "items", "left_anti").select("items", "freq", F.size("l").alias("n")).orderBy(F.col("freq").desc(), F.col("n").desc(), "items").limit(top).select("items", "freq")


def running_total(rows: DataFrame, value: str, order: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
