"""Where operators of this subpackage keep intermediate tables: the shared folder in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that a task is handed.
ARROW_BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only on a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cytoplan-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, and any executor can read it.

    The application removes the table when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cytoplan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, as documents can be very long; a user's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most))


#: What the tasks of one call share in this worker, by the call's name.
_SHARED: dict[str, Any] = {}


def in_worker(name: str, make: Callable[[], Any]) -> Any:
    """What tasks of the call `name` share in this worker; what another call left is dropped."""
    if name not in _SHARED:
        _SHARED.clear()
        _SHARED[name] = make()
    return _SHARED[name]


def forget() -> None:
    """Drop what an earlier call's tasks shared in this worker."""
    _SHARED.clear()


def trim() -> None:
    """Hand memory that this process no longer needs back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    own = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if own:
        own(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shares: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow map that hands what it no longer needs back to the system when a task ends: Python workers live as long as
    their executor, and memory that one stage leaves behind is missing in the next.  What earlier calls shared goes
    before the first batch, unless this one shares, too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shares:
            forget()
        yield from run(batches)
        trim()

    return whole


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str) -> str:
    """A column name that no caller's table has."""
    return f"{name}_{uuid.uuid4().hex}"


def plain(df: DataFrame) -> DataFrame:
    """The table with columns c0, c1 and so on: Arrow maps take no names with dots, and callers' names may hold any."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
