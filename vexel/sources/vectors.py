"""Binary vector files as a Spark data source: read in ranges of bytes by many tasks, written by tasks and committed at once.

A file is a run of records of one size, so any range of records can be read alone. A file or a folder is planned as ranges of
at most ``split_bytes``; conditions on vec_id (a record's position) and a limit cut the ranges before anything is read. A
write leaves what was there untouched until all tasks are done; then a manifest, which readers follow, is exchanged for
the new one. Files are opened through pyarrow's file systems, by a URI or a path that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vexel.functions.matrices import lists, matrix

# Element type of each format, and whether a record begins with its dimension.
KINDS = {"fvecs": ("<f4", True), "bvecs": ("u1", True), "ivecs": ("<i4", True), "f32": ("<f4", False), "i32": ("<i4", False)}
NAME, MANIFEST = "vexel_vectors", "_parts.json"
#: Bytes of a split, and bytes that are unpacked at once.
SPLIT_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Records that lie closer than so many bytes are read by one read.
NEAR_BYTES = 1 << 16
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def record_of(kind: str, dim: int) -> np.dtype:
    dtype, headed = KINDS[kind]
    return np.dtype([("dim", "<i4"), ("v", dtype, (dim,))] if headed else [("v", dtype, (dim,))])


def unpacked(data: bytes, record: np.dtype, dim: int) -> np.ndarray:
    rows = np.frombuffer(data, record)
    if "dim" in record.names and not (rows["dim"] == dim).all():
        raise ValueError("a record has another dimension")
    return rows["v"].reshape(len(rows), dim).astype(np.float64)


def packed(x: np.ndarray, kind: str) -> bytes:
    """The records of the rows of ``x``. Fractions are cut off where the format holds integers; what doesn't fit is an error."""
    dtype, headed = KINDS[kind]
    if np.dtype(dtype).kind in "iu":
        limits = np.iinfo(dtype)
        x = np.trunc(x)
        if not ((x >= limits.min) & (x <= limits.max)).all():
            raise ValueError(f"a component does not fit the format {kind}")
    out = np.empty(len(x), record_of(kind, x.shape[1]))
    if headed:
        out["dim"] = x.shape[1]
    out["v"] = x.reshape(out["v"].shape)
    return out.tobytes()


def located(path: str) -> tuple[fs.FileSystem, str]:
    system, place = fs.FileSystem.from_uri(path)
    return system, place.rstrip("/")


def manifest(system: fs.FileSystem, place: str) -> list[str] | None:
    """The part files of a folder in order, as the last committed write left them; None where nothing was written by this source."""
    if system.get_file_info(f"{place}/{MANIFEST}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{place}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


def files_of(path: str, kind: str, dim: int) -> list[tuple[str, int, int]]:
    """(file, first vec_id, records) of a file, or of the files of a folder: those of its manifest, else all in the order of their names."""
    system, place = located(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        parts = manifest(system, place)
        if parts is not None:
            found = system.get_file_info([f"{place}/{p}" for p in parts])
        else:
            listed = system.get_file_info(fs.FileSelector(place, recursive=True))
            hidden = lambda p: any(x[:1] in "._" for x in p[len(place) + 1:].split("/"))
            found = sorted((f for f in listed if f.type == fs.FileType.File and not hidden(f.path)), key=lambda f: f.path)
    size, start, out = record_of(kind, dim).itemsize, 0, []
    for f in found:
        if f.type != fs.FileType.File:
            raise FileNotFoundError(f.path)
        if f.size % size:
            raise ValueError(f"the length of {f.path} is no multiple of a record of {size} bytes")
        out.append((f.path, start, f.size // size))
        start += f.size // size
    return out


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``stop`` - 1 of a file, the first of which has this vec_id."""

    file: str
    first: int
    stop: int
    vec_id: int


class VectorReader(DataSourceReader):
    def __init__(self, path: str, kind: str, dim: int, limit: int | None, split_bytes: int):
        self.path, self.kind, self.dim, self.split_bytes = path, kind, dim, split_bytes
        self.low, self.high = 0, limit

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of vec_id are met by the ranges that are read; all other conditions are left to Spark."""
        for f in filters:
            bounds = {LessThan: (None, 0), LessThanOrEqual: (None, 1), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), EqualTo: (0, 1)}.get(type(f))
            if bounds is None or f.attribute != ("vec_id",) or not isinstance(f.value, int):
                yield f
                continue
            low, high = bounds
            if low is not None:
                self.low = max(self.low, f.value + low)
            if high is not None:
                self.high = f.value + high if self.high is None else min(self.high, f.value + high)

    def partitions(self) -> Sequence[InputPartition]:
        step = max(1, self.split_bytes // record_of(self.kind, self.dim).itemsize)
        out: list[InputPartition] = []
        for file, start, count in files_of(self.path, self.kind, self.dim):
            low = max(0, self.low - start)
            high = count if self.high is None else min(count, self.high - start)
            out += [Range(file, at, min(at + step, high), start + at) for at in range(low, high, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.stop:
            return
        record = record_of(self.kind, self.dim)
        step = max(1, READ_BYTES // record.itemsize)
        with located(self.path)[0].open_input_file(partition.file) as f:
            f.seek(partition.first * record.itemsize)
            for at in range(partition.first, partition.stop, step):
                n = min(step, partition.stop - at)
                x = unpacked(f.read(n * record.itemsize), record, self.dim)
                if len(x) != n:
                    raise ValueError(f"{partition.file} has become shorter")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + at - partition.first + partition.vec_id), lists(x)], ["vec_id", "embedding"])


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written: its name, the partition it stands for, and its rows."""

    name: str
    partition: int
    rows: int


class VectorWriter(DataSourceArrowWriter):
    """Tasks write files of their own in a folder of the job. The commit moves them, exchanges the manifest and removes what it no longer names."""

    def __init__(self, path: str, kind: str, dim: int, overwrite: bool):
        self.path, self.kind, self.dim, self.overwrite = path, kind, dim, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        system, place = located(self.path)
        folder = f"{place}/_temporary-{self.job}"
        system.create_dir(folder, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.{self.kind}", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                x, known = matrix(batch.column(batch.schema.get_field_index("embedding")))
                if not known.all():
                    raise ValueError("a vector is null")
                if len(x) and x.shape[1] != self.dim:
                    raise ValueError(f"a vector has not {self.dim} dimensions")
                if len(x):
                    out.write(packed(x, self.kind))
                rows += len(x)
        return Part(name, TaskContext.get().partitionId(), rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, place = located(self.path)
        system.create_dir(place, recursive=True)
        before = manifest(system, place)
        old = before if before is not None else [f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name.startswith("part-")]
        kept = [] if self.overwrite else old
        names = []
        for i, part in enumerate(sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)):
            names.append(f"part-{self.job}-{i:05d}.{self.kind}")
            system.move(f"{place}/_temporary-{self.job}/{part.name}", f"{place}/{names[-1]}")
        with system.open_output_stream(f"{place}/_next-{self.job}.json") as out:
            out.write(json.dumps({"parts": kept + names}).encode())
        system.move(f"{place}/_next-{self.job}.json", f"{place}/{MANIFEST}")
        for name in old:
            if name not in kept:
                system.delete_file(f"{place}/{name}")
        self.tidy(system, place)

    def abort(self, messages: list[Part | None]) -> None:
        self.tidy(*located(self.path))

    def tidy(self, system: fs.FileSystem, place: str) -> None:
        if system.get_file_info(f"{place}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{place}/_temporary-{self.job}")


class VectorFiles(DataSource):
    """(vec_id BIGINT, embedding ARRAY<DOUBLE>). Options: path, kind, dim, and for reading limit and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "vec_id bigint, embedding array<double>"

    def reader(self, schema: StructType) -> VectorReader:
        limit = self.options.get("limit")
        return VectorReader(self.options["path"], self.options["kind"], int(self.options["dim"]), None if limit is None else int(limit), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], self.options["kind"], int(self.options["dim"]), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with this source. Conditions on vec_id reach it by Spark's switch for sources in Python, which is set."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(VectorFiles)
    return spark


def read(spark: SparkSession, path: str, kind: str, dim: int, limit: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(vec_id, embedding) of a file or a folder of files; with a limit, of the first rows, and no more than these are read."""
    reader = registered(spark).read.format(NAME).option("path", path).option("kind", kind).option("dim", dim).option("split_bytes", split_bytes)
    return (reader if limit is None else reader.option("limit", limit)).load()


def write(rows: DataFrame, path: str, kind: str, dim: int) -> None:
    """Writes (vec_id, embedding) as a folder of part files in the order of vec_id, in place of what the last write left there.

    A reader sees what the last committed write left, whole; a failed write leaves nothing. Null vectors, other lengths and
    components that the format can't hold are errors.
    """
    registered(rows.sparkSession)
    ordered = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    ordered.write.format(NAME).option("path", path).option("kind", kind).option("dim", dim).mode("overwrite").save()


def row_count(path: str, kind: str, dim: int) -> int:
    """The records of a file or folder, from the files' lengths alone."""
    return sum(n for *_, n in files_of(path, kind, dim))


def read_records(positions: DataFrame, path: str, kind: str, dim: int) -> DataFrame:
    """The rows (vec_id, ...) of ``positions``, a record's position being vec_id, with its ``embedding``; positions beyond the end are left out.

    Positions are dealt out in ranges and sorted, so that a task reads forward through few files; only the records
    asked for are read, and those between close ones.
    """
    files = files_of(path, kind, dim)
    record = record_of(kind, dim)
    names = positions.columns
    place = names.index("vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array([s for _, s, _ in files], np.int64)
        system = located(path)[0]
        for batch in batches:
            asked = batch.column(place).to_numpy()
            rows, which = np.unique(asked, return_inverse=True)
            x = np.zeros((len(rows), dim))
            found = np.zeros(len(rows), bool)
            owner = np.searchsorted(starts, rows, side="right") - 1
            for i in np.unique(owner[owner >= 0]).tolist():
                file, start, count = files[i]
                own = np.flatnonzero((owner == i) & (rows - start < count))
                if not len(own):
                    continue
                at = rows[own] - start
                cuts = np.flatnonzero((np.diff(at) - 1) * record.itemsize > NEAR_BYTES) + 1
                with system.open_input_file(file) as f:
                    for some in np.split(np.arange(len(own)), cuts):
                        first, last = int(at[some[0]]), int(at[some[-1]])
                        for lo in range(first, last + 1, max(1, READ_BYTES // record.itemsize)):
                            hi = min(last + 1, lo + max(1, READ_BYTES // record.itemsize))
                            inside = some[(at[some] >= lo) & (at[some] < hi)]
                            if len(inside):
                                f.seek(lo * record.itemsize)
                                x[own[inside]] = unpacked(f.read((hi - lo) * record.itemsize), record, dim)[at[inside] - lo]
                found[own] = True
            kept = np.flatnonzero(found[which])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, lists(x[which[kept]])], [*names, "embedding"])

    ranged = positions.filter("vec_id >= 0").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return ranged.mapInArrow(run, StructType([*positions.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))
