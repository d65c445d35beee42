"""Review exports as they arrive: a file stream of review rows, and running counts by queue and workbook.

This is an addition: a folder that exports are dropped into becomes a stream, and each file is counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "queue string, workbook string, row bigint, name string, specification string, unit string, price string, message string"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Review rows of the CSV files in a folder, blank rows left out."""
    rows = spark.readStream.schema(SCHEMA).option("header", True).option("multiLine", True).csv(folder).fillna("")
    return rows.filter("name <> '' or message <> ''")


def running_counts(rows: DataFrame) -> DataFrame:
    """Rows and distinct messages (estimated) by queue and workbook; the state is bounded by those."""
    return rows.groupBy("queue", "workbook").agg(F.count("*").alias("n"), F.approx_count_distinct("message").alias("messages"))
