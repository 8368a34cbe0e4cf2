"""Intermediate tables in shared storage, and broadcasts behind a check of size."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side may be broadcast while it holds at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Tasks a core where rows are spread: uneven ones fill each other's gaps.
SPREAD = 3

_written: set[str] = set()
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a single machine without one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A folder of its own in the shared folder.

    It goes at the end of the ``scratch`` around the call, with ``keep`` at that of the next
    one around, else when the driver's program ends.
    """
    path = f"{shared_dir(spark)}/larder-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    return path


def durable(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, gives the optimiser the true size, and lets a join that follows
    an aggregation on the same keys be split where a key is hot. A lost executor costs a
    re-read. How long the table stays is told at ``new_path``.
    """
    spark = df.sparkSession
    path = new_path(spark, name, keep)
    # Not zstd: its native contexts are freed only by the garbage collector, outside the heap.
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores by ``keys``, for work that is much beside the bytes of its rows.

    A narrow table of millions of rows is a few row groups, so few tasks would do all of it.
    The number is given, since adaptive execution joins partitions by their bytes again.
    """
    return df.repartition(SPREAD * df.sparkSession.sparkContext.defaultParallelism, *keys)


def delete(path: str) -> None:
    """Delete a folder through the file system that Spark reads it by."""
    jvm = SparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    sc = SparkContext._active_spark_context
    conf = sc._jsc.hadoopConfiguration() if sc else jvm.org.apache.hadoop.conf.Configuration()
    target.getFileSystem(conf).delete(target, True)
    _written.discard(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that ``durable`` writes within; for a job that ends with a write."""
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield
    finally:
        paths = _scopes.get()[-1]
        _scopes.reset(token)
        for path in paths:
            if path in _written:
                delete(path)


@atexit.register
def _delete_rest() -> None:
    try:
        for path in list(_written):
            delete(path)
    except Exception:  # noqa: BLE001 - the JVM may be gone
        _written.clear()


def _bytes_of(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven to hold at most so many rows and bytes; stops reading beyond."""
    width = sum((_bytes_of(f) for f in df.schema.fields), F.lit(16))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return n <= rows and (total or 0) <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small.

    Beyond that the frame comes back unhinted and joins shuffle both sides.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df
