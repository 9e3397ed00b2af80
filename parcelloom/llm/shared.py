"""The folder all executors share, and tables and files in it."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Most bytes of rows that Spark hands to a Python worker at a time; a longer row goes alone.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault("root", tempfile.mkdtemp(prefix="parcelloom-"))
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/parcelloom-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by their numbers, so that no name of ours meets one of theirs; new names by old."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The columns of ``numbered`` under their old names, and some more in place of any of theirs with that name."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items() if c not in more), *more)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder, from the driver or an executor."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def _remove(uri: str) -> None:
    try:
        fs, path = filesystem(uri)
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)
    except (OSError, ValueError):
        pass  # the store is gone or was cleaned before


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as a thousand long texts are too much for one; a lower bound stays."""
    now = (spark.conf.get(_BATCH_CONF, None) or "").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def release() -> None:
    """Give back what a task's arrays have left in the allocators, as workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own ways


def parts_for(rows: int, each: int, least: int = 32, most: int = 65536) -> int:
    """A number of partitions that grows with the rows."""
    return max(least, min(most, -(-rows // each)))
