"""Vector files: fvecs, bvecs, ivecs and headerless binary, comma-separated text and text bits.

Binary files are read and written by the source in ``vectors``; text by Spark's text source. Row numbers are positions
in a file, which these formats imply; a folder of part files is numbered in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions.matrices import lists
from vexel.operators import selection
from vexel.sources import vectors

def read_vectors(spark: SparkSession, path: str, kind: str, dim: int, limit: int | None = None, split_bytes: int = vectors.SPLIT_BYTES) -> DataFrame:
    """(vec_id, embedding ARRAY<DOUBLE>) of a file or a folder of files, read in ranges; a limit keeps the first rows and reads no others.

    A store that only Spark can open is read by its binaryFile source instead, one file a row.
    """
    try:
        vectors.located(path)
    except pa.ArrowInvalid:
        rows = _whole_files(spark, path, kind, dim)
        return rows if limit is None else rows.filter(F.col("vec_id") < limit)
    return vectors.read(spark, path, kind, dim, limit, split_bytes)


def _whole_files(spark: SparkSession, path: str, kind: str, dim: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    record = vectors.record_of(kind, dim)
    # One row a file.
    starts = files.select("path", "length").withColumn("start", F.coalesce(F.sum((F.col("length") / record.itemsize).cast("bigint")).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("path").alias("_p"), "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1)):
                x = vectors.unpacked(content.as_py(), record, dim)
                for at in range(0, len(x), 10_000):
                    part = x[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)) + at + start.as_py()), lists(part)], ["vec_id", "embedding"])

    return files.join(F.broadcast(starts), F.col("path") == F.col("_p")).select("content", "start").mapInArrow(run, "vec_id bigint, embedding array<double>")


def write_vectors(rows: DataFrame, path: str, kind: str) -> int:
    """Writes a folder of part files, each a run of records in the order of vec_id, in place of what was there; returns the number of rows."""
    one = rows.filter("embedding is not null").select(F.size("embedding")).first()
    dim = one[0] if one else 0
    vectors.write(rows, path, kind, dim)
    return vectors.row_count(path, kind, dim) if dim else 0


def drawn_records(spark: SparkSession, path: str, kind: str, dim: int, size: int, batches: int = 1, seed: int = 17) -> DataFrame:
    """(draw, vec_id, embedding): ``size`` records with replacement, an equal share from each of ``batches`` runs of the file; only these are read."""
    return vectors.read_records(selection.draws(spark, vectors.row_count(path, kind, dim), size, batches, seed), path, kind, dim)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, value): lines with their position; lines of a file keep their order within and between its splits."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("m"))
    part = F.shiftright("m", 33)
    sizes = lines.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_path", "file_block_start")).alias("at"))
    starts = sizes.select(F.col("p"), F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return lines.join(F.broadcast(starts), part == F.col("p")).select((F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("vec_id"), "value")


def read_text_vectors(spark: SparkSession, path: str, dim: int, delimiter: str = ",", label_first: bool = False) -> DataFrame:
    """(vec_id, label, embedding): comma-separated numbers; a leading class label is split off, otherwise the label is null."""
    parts = F.split("value", delimiter)
    first = 2 if label_first else 1
    rows = _numbered_lines(spark, path).filter("value <> ''")
    label = parts[0].cast("int") if label_first else F.lit(None).cast("int")
    return rows.select("vec_id", label.alias("label"), F.slice(parts, first, dim).cast("array<double>").alias("embedding"))


def read_bits(spark: SparkSession, path: str, count: int) -> DataFrame:
    """(vec_id, words ARRAY<BIGINT>): text bits, highest first, the last word filled up with zeros."""
    bits = F.split("value", ",")
    words = F.transform(F.sequence(F.lit(0), F.lit((count - 1) // 64)), lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(F.coalesce(F.when(w * 64 + i < count, F.get(bits, w * 64 + i).cast("bigint")), F.lit(0).cast("bigint")))))
    return _numbered_lines(spark, path).select("vec_id", words.alias("words"))


def write_bits(rows: DataFrame, path: str, count: int) -> None:
    """Text bits of (vec_id, words), in the order of vec_id."""
    bit = F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w, 63 - i).cast("string"))))
    rows.select("vec_id", F.array_join(F.slice(bit, 1, count), ",").alias("value")).repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("value").write.text(path)


def result_lines(result: DataFrame) -> DataFrame:
    """(query_id, ids): the ids of each query's neighbours, nearest first, joined by commas."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"].cast("string"))
    return result.groupBy("query_id").agg(F.array_join(ids, ",").alias("ids"))


def write_results(result: DataFrame, path: str) -> None:
    result_lines(result).repartitionByRange("query_id").sortWithinPartitions("query_id").select("ids").write.text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, vec_id): ground truth, one line of ids per query."""
    lines = _numbered_lines(spark, path)
    return lines.select(F.col("vec_id").alias("query_id"), F.posexplode(F.split("value", ",")).alias("rank", "id")).select("query_id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("id").cast("bigint").alias("vec_id"))


def write_cluster_ids(rows: DataFrame, path: str, offset: int = 0) -> None:
    """The cluster of each row of (vec_id, cluster_id) plus ``offset``, one a line in the order of vec_id."""
    lines = rows.select("vec_id", (F.col("cluster_id") + offset).cast("string").alias("value"))
    lines.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("value").write.text(path)


def read_cluster_ids(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """(vec_id, cluster_id): a line's position and its number minus ``offset``."""
    return _numbered_lines(spark, path).select("vec_id", (F.trim("value").cast("int") - offset).alias("cluster_id"))


def write_centroids(book: DataFrame, path: str) -> None:
    """The centroids of a codebook (subspace, code, centroid) as lines of numbers, one subspace after the other."""
    lines = book.select("subspace", "code", F.array_join(F.col("centroid").cast("array<string>"), ",").alias("value"))
    lines.repartitionByRange("subspace", "code").sortWithinPartitions("subspace", "code").select("value").write.text(path)


def read_centroids(spark: SparkSession, path: str, sizes: list[int]) -> DataFrame:
    """(subspace, code, centroid) of lines of numbers; ``sizes`` tells how many lines each subspace has."""
    starts = [sum(sizes[:s]) for s in range(len(sizes))]
    at = F.array(*[F.struct(F.lit(s).alias("subspace"), F.lit(a).alias("start"), F.lit(a + n).alias("stop")) for s, (a, n) in enumerate(zip(starts, sizes))])
    rows = _numbered_lines(spark, path).withColumn("p", F.filter(at, lambda p: (p["start"] <= F.col("vec_id")) & (F.col("vec_id") < p["stop"]))[0]).filter("p is not null")
    return rows.select("p.subspace", (F.col("vec_id") - F.col("p.start")).cast("int").alias("code"), F.split("value", ",").cast("array<double>").alias("centroid"))


def write_codes(codes: DataFrame, path: str) -> None:
    """Codes (vec_id, codes) as Parquet, in the order of vec_id."""
    codes.select("vec_id", "codes").repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id bigint, codes array<int>").parquet(path)


def write_grid(grid: DataFrame, path: str) -> None:
    """A parameter search (m, minbits, maxbits, precision) as CSV with these names in its first line, best first."""
    grid.select("m", "minbits", "maxbits", "precision").orderBy(F.col("precision").desc(), "m", "minbits", "maxbits").coalesce(1).write.option("header", True).csv(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("m int, minbits int, maxbits int, precision double").csv(path)
