"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import WRITTEN, drop_stored, drop_written, reachable, scratch, stored  # noqa: F401

#: UTF-8 bytes (of a text column) that a Python worker handles at once.
CHUNK_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the folder."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sent(df: DataFrame, value):
    """``value`` as a broadcast variable for the Python workers that handle ``df``."""
    return reachable(df.sparkSession).sparkContext.broadcast(value)


def cleaned(spark: SparkSession) -> None:
    """Lets the driver delete the shuffle files of plans that nobody holds any more. It does so when its heap is collected, which
    otherwise happens when memory gets short, however full the executors' disks are by then. What the driver's processes have freed goes
    back to the system too: their C library keeps it, and it stands beside the heap, which grows with the tasks that Spark has seen."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trimmed_jvm(spark)
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def _trimmed_jvm(spark: SparkSession) -> None:
    """Has the driver's JVM return freed native memory, if it knows how to (OpenJDK 17.0.9 and later, on Linux)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        # By the interface's method: the server's own class isn't open to callers.
        types = gateway.new_array(jvm.java.lang.Class, len(kinds))
        for i, kind in enumerate(kinds):
            types[i] = jvm.java.lang.Class.forName(kind)
        values = gateway.new_array(jvm.java.lang.Object, len(kinds))
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)
    except Py4JError:  # another JVM
        pass


def _libc():
    """The C library, if it is one that can return freed memory."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        return libc if libc.malloc_trim else None
    except (OSError, AttributeError):
        return None


def tidy(run):
    """A task's function that gives memory back when the task ends: workers are used again, and what one stage leaves behind would
    stand beside the next one's. ``run.clear`` (if there is one) empties caches."""

    def whole(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 1 << 20)  # arrays of a megabyte and more go back to the system when they are freed
        except (OSError, AttributeError):  # not this C library
            libc = None
        try:
            yield from run(batches)
        finally:
            if (clear := getattr(run, "clear", None)) is not None:
                clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return whole


def unused(name: str, taken) -> str:
    """``name``, with underscores in front until it isn't one of ``taken`` (in any case of letters)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def chunks(batches: Iterator, column: str, most: int = CHUNK_BYTES) -> Iterator:
    """Record batches cut so that ``column`` holds about ``most`` bytes in each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def crc_of_id(doc_id="doc_id"):
    """Unsigned CRC-32 of the id as decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))
