"""Folders for intermediate tables, in the one that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a temporary one only where driver and executors are one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="vexel-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written and read back, which cuts its lineage, and the path it lies at."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(path: str) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more. What a driver can't reach as files stays."""
    try:
        system, place = fs.FileSystem.from_uri(path)
        system.delete_dir(place)
    except (pa.ArrowInvalid, OSError):
        pass
