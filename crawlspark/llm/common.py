"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the line and word operators define it.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_local_dir: str | None = None


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or (single machine only) an own temporary one."""
    global _local_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="crawlspark-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return "file://" + _local_dir


class Workspace:
    """A folder of one operator call inside the shared folder; its tables cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.remove)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back."""
        at = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let go of the shuffle files of what wrote them."""
        self.delete(*names)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # the context's cleaner removes shuffles that no plan holds

    def delete(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def remove(self) -> None:
        """Delete the folder; results that still read from it are lost."""
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on, what goes to Python goes in batches of about 4 MB: by number of rows alone, a batch of long texts is tens of MB, several times over, in the executor and its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def lower_ascii(col):
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def text_slices(batches, index: int, most_bytes: int = 4 << 20, most_rows: int = 1 << 30):
    """Cut record batches so that the text column holds about most_bytes in each slice (one row at least) and no slice has more than most_rows.

    After the last, Arrow's unused memory goes back: a worker lives on through later stages.
    """
    for batch in batches:
        start, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            total += int(sizes[i])
            if total >= most_bytes or i + 1 - start == most_rows:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < n:
            yield batch.slice(start)
    batch = None
    pa.default_memory_pool().release_unused()


def to_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def views(column: pa.Array) -> list[memoryview]:
    """The values of a binary column without copies; they hold as long as the column is held."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    return [data[a:b] for a, b in zip(ends, ends[1:])]
