"""Shared scratch space for staged tables.

A multi-step operator cuts its lineage by writing a table where every executor and the driver can
read it. The place is the cluster's ``spark.checkpoint.dir``; only a session that names none (a
local test) gets a folder of its own.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash; an error on a cluster that names none."""
    root = spark.conf.get(_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_CONF} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(_CONF, root)
    return root.rstrip("/")


class Workspace:
    """A private folder below the shared one that holds the staged tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/skein-{name}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df``, then return it as read back: later steps never recompute it."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete staged tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps.

        The cleaner acts on plans that the driver has garbage-collected, so an idle driver can keep
        the shuffles of a long job on every executor's disk until the job ends.
        """
        gc.collect()
        self.spark._jvm.System.gc()


#: Settings of a session that reads whole texts: bytes of an Arrow batch, rows of a column batch, and column
#: batches outside the heap. A batch is held several times by every task, on both sides, and a long text
#: makes its column's buffer as large for all of the file.
BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.columnVector.offheap.enabled": "true",
}


def small_batches(spark: SparkSession) -> None:
    """Keep the batches of whole texts small from now on, in all of this session."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` that gives free memory back when its partition is done.

    Python workers are reused by later stages; what the allocators keep would count against the
    executor's memory for as long.
    """

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped
