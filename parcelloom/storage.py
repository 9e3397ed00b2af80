"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault("root", tempfile.mkdtemp(prefix="parcelloom-"))
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/parcelloom-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_in_order(path: str) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet folder that Spark has written, without Spark, in the order of its tasks; no batch is empty."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    system, folder = pafs.FileSystem.from_uri(path)
    files = sorted(x.path for x in system.get_file_info(pafs.FileSelector(folder)) if x.base_name.startswith("part-"))
    for name in files:
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(1 << 18):
                if len(batch):
                    yield batch
