"""Text sources and sinks: review CSV, recognition JSON, and summaries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

WORD = S.StructType([S.StructField("text", S.StringType()), *(S.StructField(c, S.DoubleType()) for c in ("x", "y", "width", "height"))])
OCR = S.StructType([S.StructField("file", S.StringType()), S.StructField("text", S.StringType()), S.StructField("lines", S.ArrayType(S.StructType([S.StructField("text", S.StringType()), S.StructField("words", S.ArrayType(WORD))]))), S.StructField("error", S.StringType())])
#: Columns of the review CSV, in order.
REVIEW = [
    "source_format", "extractor", "source_sheet", "source_page", "source_row", "extraction_status", "extraction_confidence", "extraction_warnings", "section", "work_type", "category", "item_name",
    "specification", "unit", "quantity", "standard", "daily_output", "setting", "remarks", "notes", "source_reference", "output_item_name", "output_code", "output_condition", "match_status", "confidence",
    "matched_rule", "output_level1", "output_level2", "output_level3", "output_level4", "output_subcategory", "output_specification_group", "output_item_column", "catalog_status", "catalog_score",
    "catalog_name_score", "catalog_specification_score", "catalog_candidate_count", "catalog_path_safe", "catalog_code_safe", "catalog_source_row", "catalog_reference_type", "catalog_reference_text", "warnings",
]


def source_review(spark: SparkSession, path: str) -> DataFrame:
    """A review CSV as text columns, unknown ones included; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\u0000")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns)).fillna("")


def recognised(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results (OCR), one or a list for each file of JSON. Results that are all errors are an error."""
    df = spark.read.schema(OCR).json(path, multiLine=True)
    seen = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("bad")).first()
    if seen.n and seen.n == seen.bad:
        raise ValueError("recognition failed for every image")
    return df


def review(df: DataFrame) -> DataFrame:
    """Classified items as the text columns of REVIEW."""
    renamed = {"catalog_score": "score", "catalog_name_score": "name_score", "catalog_specification_score": "specification_score", "catalog_candidate_count": "candidate_count", "catalog_path_safe": "path_safe", "catalog_code_safe": "code_safe", "catalog_source_row": "c_source_row", "catalog_reference_type": "c_reference_type", "catalog_reference_text": "c_reference_text", "output_item_name": "output_level4"}

    def column(c: str):
        name = renamed.get(c, c)
        value = F.col(name)
        kind = df.schema[name].dataType
        if isinstance(kind, S.ArrayType):
            value = F.array_join(value, "; ")
        elif isinstance(kind, S.BooleanType):
            value = F.when(value, "True").otherwise("False")
        elif c == "quantity":
            value = F.when(value == value.cast("bigint"), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
        return F.coalesce(value.cast("string"), F.lit("")).alias(c)

    return df.select("doc_id", *(column(c) for c in REVIEW))


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV file for people: one file with a byte order mark, for results of the size of a review."""
    import csv

    names = df.columns
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(names)
        for row in df.toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if v is None else v for v in row])


def write_csv_folder(df: DataFrame, path: str) -> None:
    """A CSV folder, written in parallel."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False)


def available_path(folder: str, stem: str, suffix: str, stamp: str) -> str:
    """``stem + suffix`` in the folder, with the stamp behind the stem if that file exists."""
    plain = os.path.join(folder, stem + suffix)
    return plain if not os.path.exists(plain) else os.path.join(folder, f"{stem}_{stamp}{suffix}")
