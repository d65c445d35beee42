"""Intermediate tables in the shared folder."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabulon import session


def test_stored(spark):
    df = spark.range(5).withColumn("x", F.lit("a"))
    since = len(session.WRITTEN)
    first, second = session.stored(df), session.stored(df.filter("id > 2"))
    assert first.schema.simpleString() == df.schema.simpleString() and first.count() == 5 and second.count() == 2
    assert all(p.startswith(session.scratch(spark)) for p in session.WRITTEN[since:])
    session.drop_written(spark, since)
    assert second.count() == 2 and len(session.WRITTEN) == since + 1
    assert session.stored(df.filter(F.lit(False))).count() == 0
    session.drop_stored(second)


def test_workers_can_import(spark):
    session.reachable(spark)
    session.reachable(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(session.ROOT) == 1


def test_cleaned_returns_what_the_driver_has_freed(spark):
    """Native memory that the JVM has freed between blocks still held goes back to the system, not only heap."""
    common = pytest.importorskip("tabulon.llm.common")
    memory = Path(f"/proc/{spark.sparkContext._gateway.proc.pid}/smaps_rollup")
    if not os.access(memory, os.R_OK):
        pytest.skip("memory can't be read here")
    megabytes = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", memory.read_text()))) / 1024
    jvm = spark.sparkContext._jvm
    common.cleaned(spark)
    jvm.System.gc()
    before = megabytes()
    held = [jvm.java.util.zip.Deflater() for _ in range(600)]
    full = megabytes()
    for i, x in enumerate(held):
        if i % 50:
            x.end()
    common.cleaned(spark)
    assert full > before + 30 and full - megabytes() > 0.6 * (full - before)
    for x in held[::50]:
        x.end()
