"""Shared folders, table reading and Arrow batch slicing for the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python task turns into numpy arrays at a time. A longer text goes alone.
SLICE_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new temporary one where that is unset and all runs on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Workspaces that the innermost ``scratch`` block of this thread has seen opened.
_opened: ContextVar[list[Workspace] | None] = ContextVar("opened", default=None)


class Workspace:
    """Tables that cut lineage, as Parquet in the shared folder: a lost executor costs the running stage only.

    An operator drops tables that nothing reads any more. Those that its result reads stay until the caller, who knows
    when the result is written, calls ``remove`` or leaves a ``scratch`` block.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if (opened := _opened.get()) is not None:
            opened.append(self)

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` and return what was written; the schema is known, so nothing is inferred."""
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def remove(self) -> None:
        """Delete all tables."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes, at its end, the workspaces that this thread opened inside; other threads' tables stay."""
    mine: list[Workspace] = []
    token = _opened.set(mine)
    try:
        yield
    finally:
        _opened.reset(token)
        for w in mine:
            w.remove()


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that none clashes with an operator's own; ``toDF`` names them back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of ``batch`` in runs of about ``limit`` text bytes, with the UTF-8 bytes and the offsets of the texts (null: empty)."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
