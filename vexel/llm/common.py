"""Shared helpers of the training-data operators: tables, scratch space, running sums in three levels, joins with hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that a bucket of a running sum is meant to hold, and buckets that follow each other in one window.
ROWS_PER_BUCKET, BUCKETS = 100, 1_000
#: Rows of one key that a task of a join is meant to hold, and keys with more rows than that, at most.
HOT_ROWS, HOT_KEYS = 1_000, 100_000
#: Rows of a narrow table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    A temporary one where it is unset and driver and executors are one process; on a cluster it must be set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("vexel.scratch.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vexel-")
        spark.conf.set("vexel.scratch.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: What this process has written and not removed.
PATHS: list[str] = []


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and the path it lies at."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: cuts lineage and survives lost executors."""
    return written(df, label)[0]


def removed(path: str) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more. What a driver can't reach as files stays."""
    try:
        system, place = fs.FileSystem.from_uri(path)
        system.delete_dir(place)
        if path in PATHS:
            PATHS.remove(path)
    except (pa.ArrowInvalid, OSError):
        pass


def settled(make: Callable[[], DataFrame], label: str, last: str | None = None) -> tuple[DataFrame, str]:
    """What ``make`` gives, written and read back, and its path; the tables that it wrote on the way are removed, and so is ``last``, which it read."""
    before = len(PATHS)
    done, path = written(make(), label)
    for p in [p for p in PATHS[before:] if p != path] + ([last] if last else []):
        removed(p)
    return done, path


def released() -> None:
    """Gives freed memory of this process back to the system, where its allocator can: a worker or driver keeps it otherwise, whatever runs next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns of ``df``: those given, lengthened until they differ from all that it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names, with dots or repeated: ``run`` finds columns by place and gives those of ``schema`` in order."""
    names = [f"r{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    plain = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*schema.names)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. ASCII texts take the short way, on which lower() means the same."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def running_sum(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of ``group`` up to and including this one. Columns b_*, s_* are taken.

    Rows are ordered by ``bucket`` (a whole number; ``group`` and ``bucket`` hold no nulls) and then by ``order``. A window
    holds the rows of one bucket, BUCKETS bucket numbers that follow each other, or the sums of these of one group: so
    a group of n rows in well-filled buckets has n / (ROWS_PER_BUCKET * BUCKETS) rows in the last.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("b_sum")).withColumn("s_part", F.floor(F.col(bucket) / BUCKETS))
    parts = sums.groupBy(group, "s_part").agg(F.sum("b_sum").alias("s_sum"))

    def earlier(name: str, *keys: str, by: str) -> Column:
        return F.coalesce(F.sum(name).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = parts.select(group, "s_part", earlier("s_sum", group, by="s_part").alias("s_before"))
    sums = sums.withColumn("b_before", earlier("b_sum", group, "s_part", by=bucket)).join(parts, [group, "s_part"])
    sums = sums.select(group, bucket, (F.col("b_before") + F.col("s_before")).alias("b_before"))
    inside = F.sum(value).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("b_inside", inside).join(sums, [group, bucket])
    return rows.withColumn(out, F.col("b_inside") + F.col("b_before")).drop("b_inside", "b_before")


def hot_keys(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, salts) of the keys with more rows than a task is meant to hold; ``counts``: (key, n) of a table of ``rows`` rows. At most HOT_KEYS rows."""
    share = max(HOT_ROWS, -(-rows // HOT_KEYS))
    return counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("salts"))


def spread_join(rows: DataFrame, small: DataFrame, key: str, hot: DataFrame, by: list[Column], how: str = "inner") -> DataFrame:
    """Joins ``rows`` to ``small``, which has each ``key`` once; rows of the ``hot`` keys are dealt out by a hash of ``by`` to several tasks.

    Columns ``salt`` and ``salts`` are taken.
    """
    hot = F.broadcast(hot)
    salted = rows.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")), F.lit(0))).drop("salts")
    copies = small.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    return salted.join(copies, [key, "salt"], how).drop("salt")


def key_join(rows: DataFrame, results: DataFrame, key: str, by: list[Column], how: str = "left") -> DataFrame:
    """Joins ``rows`` to ``results``, which has each ``key`` once: results go to all tasks if they are few; else the rows of a frequent key are dealt out."""
    if results.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(results), key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return spread_join(rows, results, key, hot_keys(counts, key, rows.count()), by, how)
