"""What several operators share: checkpoints, text columns and document splits."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the cluster names; where it names none, a folder in the warehouse, if that is shared.

    A folder of this machine's own is taken only by a session that runs in this machine's one process (tests); a
    cluster whose warehouse is on the driver's machine (Spark's default) has to name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        local = sc.master == "local" or sc.master.startswith("local[")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not local and warehouse.split(":")[0] in ("file", warehouse):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="countloom-checkpoints-") if local else f"{warehouse}/countloom-checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


#: Removes a query's shuffle files at its end, where the session knows it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder; losing executors loses nothing.

    The shuffles that led there are not needed any more and give their disk back at once.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a query takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text, remainder 0 of 5."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_list(column) -> list[bytes | None]:
    """A string column of a record batch as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


#: Rows and bytes of one batch between the JVM and Python, set where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches of long texts small in both processes; settings of the session's own stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size, "67108864b") == "67108864b":
        spark.conf.set(size, str(BATCH_BYTES))


def give_back() -> None:
    """At a task's end: return freed memory to the system, since the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
