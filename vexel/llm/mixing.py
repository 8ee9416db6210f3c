"""Mixing sources to target weights by entropy balancing.

The dual of the entropy problem has one multiplier a source: documents get the rate min(3, exp(m * size / mean size)),
and Newton's method finds the m at which the source's tokens meet its target. The rates are then rounded into copies
so that neither a source nor a size band drifts from its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.common import BROADCAST_ROWS, ROWS_PER_BUCKET, hot_keys, key_join, removed, running_sum, spread_join, stored, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No document is taken more often, and no source's target exceeds so many times its size.
MOST = 3
#: Rates are rounded to this fraction, so that sums of them are exact and the same in any order.
UNIT = 1 << 20
#: Newton steps at most, the error relative to the target at which they stop, and passes that mend what rounding left.
STEPS, CLOSE, PASSES = 40, 1e-7, 4


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(skey, source_size, n_docs, target) from rows of (skey, size, n).

    The weights 5, 2, 1 repeat over the sources in order. A target is the source's weight times a level, but stops at MOST
    times the source's size; from one pass to the next the level rises by what the sources that have reached their stop
    leave over, until no other reaches it. There may be as many sources as web hosts: they are numbered range by range.
    """
    by_source = sizes.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    ranged = stored(by_source.repartitionByRange("skey").withColumn("part", F.spark_partition_id()), "mix-sources")
    # One row a partition.
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c")).withColumn("first", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = ranged.join(F.broadcast(before.select("part", "first")), "part").select("skey", "source_size", "n_docs", weight.alias("w"), (F.col("source_size") * MOST).cast("double").alias("stop"))
    ranked = stored(ranked, "mix-ranked")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("stop") <= F.lit(level) * F.col("w")
        state = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("stop")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if state[0] == stopped or not state[2]:
            break
        stopped, level = state[0], (total - state[1]) / state[2]
    return ranked.select("skey", "source_size", "n_docs", F.least("stop", F.lit(level) * F.col("w")).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * size / mean, F.lit(50.0))))


def solve(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(skey, m): the multipliers, by Newton's method with bisection where a step leaves the bracket.

    Each step is one job over the (source, size) counts; only its largest relative error comes to the driver. A source
    whose target is MOST times its size has no finite multiplier and gets one at which every rate is MOST.
    """
    sizes = sizes.filter("size > 0")
    state = targets.filter("source_size > 0").select(
        "skey", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), (F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)).alias("full"),
        F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size")).alias("m"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), F.lit(1.0).alias("error"))
    state = state.withColumn("m", F.when(F.col("full"), F.lit(1e9)).otherwise(F.col("m")))
    last = None
    for _ in range(STEPS):
        both = sizes.join(state, "skey")
        raw = F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(50.0)))
        tokens = F.col("n") * F.col("size")
        sums = both.groupBy("skey", "target", "mean", "full", "m", "lo", "hi").agg(
            F.sum(tokens * F.least(raw, F.lit(float(MOST)))).alias("got"),
            F.sum(F.when(raw < MOST, tokens * raw * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("m")).otherwise(F.col("lo")), F.when(gap > 0, F.col("m")).otherwise(F.col("hi"))
        error = F.when(F.col("full"), 0.0).otherwise(F.abs(gap) / F.greatest(F.col("target"), F.lit(1e-9)))
        newton = F.col("m") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        # Inside a half-open bracket the way out is a step that doubles the distance from zero.
        middle = F.when(F.col("l2") < -1e8, F.col("h2") - 1 - F.abs(F.col("h2"))).when(F.col("h2") > 1e8, F.col("l2") + 1 + F.abs(F.col("l2"))).otherwise((F.col("l2") + F.col("h2")) / 2)
        step = sums.withColumn("l2", lo).withColumn("h2", hi).withColumn("error", error).withColumn("n2", newton)
        inside = (F.col("n2") > F.col("l2")) & (F.col("n2") < F.col("h2"))
        new = F.when(F.col("full") | (F.col("error") <= CLOSE), F.col("m")).when(inside, F.col("n2")).otherwise(middle)
        state, path = written(step.select("skey", "target", "mean", "full", new.alias("m"), F.col("l2").alias("lo"), F.col("h2").alias("hi"), "error"), "mix-dual")
        if last:
            removed(last)
        last = path
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= CLOSE:
            break
    return state.select("skey", "mean", F.round("m", 9).alias("m"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, skey, size, text_hash, n): equal rows are one unit, and are all taken equally often."""
    rows = docs.select("doc_id", source_key(F.col("source")).alias("skey"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("text_hash"))
    return rows.groupBy("doc_id", "skey", "size", "text_hash").agg(F.count(F.lit(1)).alias("n"))


def copies(docs: DataFrame) -> DataFrame:
    """The units of ``docs`` with ``copies`` (0 to MOST), ``source_size`` and ``target``.

    Null texts and texts without words have size 0 and are taken 0 times; a null source is a source of its own, last in
    order; an empty table gives an empty result. Within a source, units go by size band and then by size; a unit gets a
    copy for each whole number that the running sum of rates passes, so that what is lost on one document is made up by
    the next of like size. Passes then add or remove a copy of the largest units that fit into what is left, each of
    which at least halves it.
    """
    rows = stored(units(docs), "mix-units")
    sizes = stored(rows.groupBy("skey", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_units")), "mix-sizes")
    targets = stored(source_targets(sizes), "mix-targets")
    dual = solve(sizes, targets)
    band = F.floor(F.log2("size") * 4).cast("bigint")
    in_band = Window.partitionBy("skey", "band")
    rates = (sizes.filter("size > 0").withColumn("band", band).withColumn("parts", F.ceil(F.sum("n_units").over(in_band) / ROWS_PER_BUCKET))
             .join(dual, "skey").select("skey", "size", "band", "parts", F.round(_rate(F.col("m"), F.col("size"), F.col("mean")) * UNIT).cast("bigint").alias("rate")))
    part = F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("parts"))
    # One source, or one size of it, may hold very many rows.
    by_rate = [F.struct("skey", "size").alias("kind"), "band", "parts", "rate"]
    kinds = key_join(rows.withColumn("kind", F.struct("skey", "size")), stored(rates.select(*by_rate), "mix-rates"), "kind", [F.col("doc_id"), F.col("text_hash")], "inner").drop("kind")
    placed = kinds.withColumn("up", F.col("band") * UNIT + part).withColumn("down", (1000 - F.col("band")) * UNIT + part)
    summed = running_sum(placed, "skey", "up", [F.col("size"), F.col("doc_id"), F.col("text_hash")], "rate", "upto")
    whole = lambda c: F.floor((c + UNIT // 2) / UNIT)
    now, last = written(summed.select("doc_id", "skey", "size", "text_hash", "n", "down", (whole(F.col("upto")) - whole(F.col("upto") - F.col("rate"))).alias("copies")), "mix-rounded")
    few = targets.count() <= BROADCAST_ROWS
    hot = stored(hot_keys(targets.select("skey", F.col("n_docs").alias("n")), "skey", rows.count()), "mix-hot")

    def by_source(some: DataFrame, results: DataFrame, by: list[Column]) -> DataFrame:
        """``some`` with the row of ``results`` of its source; the rows of a large source are dealt out where sources aren't few."""
        return some.join(F.broadcast(results), "skey") if few else spread_join(some, results, "skey", hot, by)

    for _ in range(PASSES):
        left = now.groupBy("skey").agg(F.sum(F.col("n") * F.col("size") * F.col("copies")).alias("got")).join(targets.select("skey", "target"), "skey")
        left = left.select("skey", (F.round("target").cast("bigint") - F.col("got")).alias("left"))
        # Sent to the buckets, not to the sources, so that a source's rows needn't meet.
        left = by_source(now.select("skey", "down").distinct(), left, [F.col("down")])
        open_ = now.join(left, ["skey", "down"]).withColumn("mass", F.col("n") * F.col("size"))
        fits = (F.col("mass") <= F.abs("left")) & (((F.col("left") > 0) & (F.col("copies") < MOST)) | ((F.col("left") < 0) & (F.col("copies") > 0)))
        summed = running_sum(open_.withColumn("fit", F.when(fits, F.col("mass")).otherwise(F.lit(0)).cast("bigint")), "skey", "down", [F.col("size").desc(), F.col("doc_id"), F.col("text_hash")], "fit", "upto")
        change = F.when((F.col("fit") > 0) & (F.col("upto") <= F.abs("left")), F.signum(F.col("left").cast("double"))).otherwise(0.0)
        now, path = written(summed.select("doc_id", "skey", "size", "text_hash", "n", "down", (F.col("copies") + change.cast("bigint")).alias("copies")), "mix-mended")
        removed(last)
        last = path
    with_size = rows.filter("size = 0").select("doc_id", "skey", "size", "text_hash", "n", F.lit(0).cast("bigint").alias("copies"))
    return by_source(now.drop("down").unionByName(with_size), targets.select("skey", "source_size", "target"), [F.col("doc_id"), F.col("text_hash")])


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words taken of it."""
    rows = copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_"))
    return rows.drop("_")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken; its columns are unchanged, whatever their names.

    Rows without words are not taken, and equal rows equally often; a null source or doc_id is a value like any other. An
    empty table gives an empty result.
    """
    taken = copies(docs).filter("copies > 0").select(F.col("doc_id").alias("taken_id"), F.col("skey").alias("taken_key"), F.col("text_hash").alias("taken_hash"), F.col("copies").alias("times"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(F.col("doc_id").alias("doc_id"), source_key(F.col("source")).alias("skey"), F.xxhash64("text").alias("text_hash"), whole)
    rows = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("skey") == F.col("taken_key")) & (F.col("text_hash") == F.col("taken_hash")))
    rows = rows.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
