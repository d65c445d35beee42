"""Session helpers: what workers need, and intermediate tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and Python: what is in flight must fit beside the heap of a small executor.
BATCH, DEFAULT = "8m", "67108864b"
#: Tables that :func:`stored` has written in this process.
WRITTEN: list[str] = []
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Bounds the batches sent to Python workers, if the session doesn't, and lets the workers import this package where it lies in the same place as for the driver (local mode, or a package
    folder on every machine); elsewhere it has to be installed or sent with ``--py-files``."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", BATCH) == DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, known] if known else [ROOT])
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        folder = sc._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tabulon-")
            sc.setCheckpointDir(folder)
            folder = sc._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def stored(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The same rows, written as a table to the shared folder and read again: cuts the lineage, so that
    a lost executor costs a read and not a recomputation."""
    spark = reachable(spark or df.sparkSession)
    path = f"{scratch(spark)}/stored-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes a table made by :func:`stored` that no later plan reads."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("stored-"):
            _delete(df.sparkSession, path)


def drop_written(spark: SparkSession, since: int) -> None:
    """Deletes the tables written after the first ``since`` ones but the last, which was made from them."""
    for path in WRITTEN[since:-1]:
        _delete(spark, path)
        WRITTEN.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
