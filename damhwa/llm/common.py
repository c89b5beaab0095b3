"""Helpers shared by the operators: input tables, the shared work folder, Arrow batches, the tables of Python workers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by this driver and not yet removed: path -> session.
_FOLDERS: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares (spark.checkpoint.dir); removed when the driver ends.

    Only on one machine (a local master) may that setting be absent; a temporary folder takes its place there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "damhwa-checkpoints")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_FOLDERS.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: what is left is the shared folder's to expire
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` returned, once all that was made of them is stored."""
    for table in tables:
        _delete(table.sparkSession, table.stored_in)
        _FOLDERS.pop(table.stored_in, None)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished jobs, which it keeps until the driver happens to collect its garbage;
    for where large ones have just become a stored table."""
    spark.range(1).collect()  # the scheduler holds the last job until it has another
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_TENANT: list = [None, None]


#: Bytes of an Arrow batch between the JVM and a Python worker, which both hold it.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's limit on Arrow batches, which a few thousand long texts fill, to `most` bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = str(spark.conf.get(name)).strip().rstrip("b")
    if not set_to.isdigit() or not 0 < int(set_to) <= most:
        spark.conf.set(name, most)


def bound_reads(spark: SparkSession, rows: int) -> None:
    """Lower the session's limit on the rows of a Parquet batch, which an executor holds whole, long texts and all."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def _trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def claim(name: str, release: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins: a Python worker serves many operators in turn, and what the one before
    keeps between its tasks is released, so only one operator's tables are in memory."""
    if _TENANT[0] != name:
        if _TENANT[1] is not None:
            _TENANT[1]()
            gc.collect()
        _TENANT[:] = name, None
    _trim()
    if release is not None:
        _TENANT[1] = release


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow where `start()` runs once per task and returns batch -> dict of columns (in schema order)."""
    owner = start.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        step = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            step = step or start()
            yield to_batch(step(batch), target)

    target = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bound_batches(spark)
    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) and columns[f.name].type == f.type else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
