"""Shared storage for intermediate tables, so that lost executors never cost a rerun of the whole job."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir.

    The setting is read from the session, else from the context. Only where both are unset (unit tests, a laptop) a local temporary
    folder is created and recorded in the session, since then driver and executors are one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"


_scratch: ContextVar[list[list[str]]] = ContextVar("scratch", default=[])


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write the rows to shared storage as Parquet and read them back: lineage ends there. Within ``scratch`` the table is
    deleted at the end, or, if ``keep``, belongs to what is around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    scopes = _scratch.get()
    at = len(scopes) - 1 - keep
    if at >= 0:
        scopes[at].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end. Whatever still reads them must be written with ``keep``."""
    own: list[str] = []
    token = _scratch.set([*_scratch.get(), own])
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that Spark hands to a Python worker at once: texts are long, and several copies exist on the way.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def release_memory() -> None:
    """Give what a task has freed back to the system: a reused Python worker would hold on to the most it ever had."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ``BATCH_ROWS`` and ``BATCH_BYTES`` where they are higher. They hold when a
    plan runs, which is after the operator has returned, so they stay lowered."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def fields(df: DataFrame, **names: str) -> DataFrame:
    """Keep only the named columns under fixed internal names, so that no other column clashes; bounds batches too."""
    from pyspark.sql import functions as F

    bound_batches(df.sparkSession)
    for column in names.values():
        if column not in df.columns:
            raise ValueError(f"no column {column!r}")
    return df.select(*[F.col(f"`{column}`").alias(alias) for alias, column in names.items()])


#: Bytes of rows that are broadcast at most; larger tables are joined by shuffle. In memory they take about three times that.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether the rows of a written table (text, binary and plain columns) fit a broadcast, by their bytes, not by their number."""
    from pyspark.sql import functions as F

    width = F.lit(16)
    for f in df.schema.fields:
        width = width + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if f.dataType.typeName() in ("string", "binary") else F.lit(8))
    return (df.agg(F.sum(width)).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key isn't among the distinct keys of the one-column table ``gone``; null equals null."""
    from pyspark.sql import functions as F

    gone = written(gone.toDF("__gone").distinct(), "gone")
    side = F.broadcast(gone) if small(gone) else gone
    return df.join(side, df[key].eqNullSafe(side["__gone"]), "left_anti")
