"""The library's flows: extract, convert, build a catalog, reconcile. Each is lazy up to its sink."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import classify, grids, layout, matching, reconcile, scans, sheets
from ..sources import files, workbooks


def source_cells(spark: SparkSession, path: str) -> DataFrame:
    """Prepared cells of workbooks; other kinds of files are an error."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in ("", ".xlsx", ".xlsm"):
        raise ValueError(f"{suffix} files are read as table matrices, not as workbooks")
    return sheets.prepared(workbooks.workbook_cells(spark, path))


def matrix_records(vector: DataFrame, scanned: DataFrame) -> DataFrame:
    """Records of embedded tables, and of scanned tables for documents that have none of those."""
    first = grids.records(vector)
    rest = scanned.join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    return first.unionByName(scans.records(rest))


def items(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """Classified items of prepared cells."""
    return classify.classify(matching.apply_catalog(classify.items(sheets.records(cells)), catalog))


def matrix_items(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Classified items of matrix records."""
    blank = {c: F.lit("") for c in ("standard", "daily_output", "setting", "notes")}
    full = records.withColumns(blank | {"sheet_idx": F.lit(0), "source_format": F.lit("pdf"), "extractor": F.when(F.col("extraction_status").startswith("OCR"), "pdf_grid_ocr").otherwise("pdf_vector_tables"), "source_file": F.col("doc_id")})
    return classify.classify(matching.apply_catalog(classify.items(full), catalog))


def covers(cells: DataFrame, done: DataFrame, location: str = "", district: str = "", month: datetime.date | None = None) -> DataFrame:
    """(doc_id, project, location, work_category, district, month, month_source)."""
    tables = sheets.select_tables(sheets.detect_tables(cells))
    projects = sheets.project_names(cells, tables)
    months = sheets.estimate_months(cells)
    if month:
        months = months.withColumns({"month": F.lit(month), "month_source": F.lit("USER")})
    kinds = classify.work_categories(done, projects)
    return projects.join(months, "doc_id").join(kinds, "doc_id").withColumns({"location": F.lit(location), "district": F.lit(district)})


def write_workbook(template: bytes, done: DataFrame, cover: DataFrame, path: str) -> int:
    """One document's workbook; the number of its blocks. What a workbook holds fits in the driver by the template's capacity."""
    found = layout.item_blocks(done)
    writes = layout.cell_writes(found).unionByName(layout.cover_writes(cover)).drop("doc_id")
    most = lambda max_row: layout.capacity(max_row) // layout.SLOTS * layout.PAGE_ROWS
    rows = [(r.sheet, r.row, r.col, r.text, r.number) for r in writes.collect()]
    with open(path, "wb") as f:
        f.write(workbooks.filled_template(template, rows, layout.SHEETS, layout.COVER, layout.MAIN, most))
    return found.count()


def build_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(merged catalog, sources) of accepted workbooks."""
    cells = sheets.prepared(workbooks.workbook_cells(spark, path, {C.SHEET}))
    found = C.entries(cells).withColumn("source_file", F.regexp_extract("source_file", r"[^/\\]*$", 0))
    sizes = found.groupBy(F.col("source_file").alias("file_name")).agg(F.count("*").alias("entries"))
    sources = workbooks.file_digests(spark, path).join(sizes, "file_name", "left").fillna(0, ["entries"])
    return C.merged(found), sources


def write_catalog(catalog: DataFrame, sources: DataFrame, path: str) -> None:
    """The catalog's JSON file, a dimension of bounded size."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(C.as_json(catalog, sources).first().value)


def reconciliation(source: DataFrame, reviews: DataFrame, path: str) -> dict[str, int]:
    """Writes the reconciled rows as CSV and their status counts as JSON; an error if there is nothing to write."""
    rows = reconcile.reconcile(source, reviews)
    counts = {r[0]: r[1] for r in classify.counts(rows, reconcile.PREFIX + "status").collect()}
    if not counts:
        raise ValueError("nothing to reconcile")
    files.write_csv(rows, path)
    with open(os.path.splitext(path)[0] + ".json", "w", encoding="utf-8") as f:
        json.dump({"output": os.path.abspath(path), "status_counts": counts}, f, ensure_ascii=False, indent=2)
    return counts


def write_extraction(records: DataFrame, path: str) -> dict:
    """Writes records as CSV (warnings joined) with a JSON file of their status counts beside it; returns those."""
    from ..operators.sheets import RECORD

    kept = [c for c in RECORD if c in records.columns]
    shown = records.orderBy("doc_id", "source_page", "source_row").select(*(F.array_join(c, "; ").alias(c) if c == "extraction_warnings" else F.col(c) for c in kept))
    files.write_csv(shown, path)
    counts = {r[0]: r[1] for r in classify.counts(records, "extraction_status").collect()}
    found = {"records": sum(counts.values()), "status_counts": counts}
    with open(os.path.splitext(path)[0] + ".json", "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False, indent=2)
    return found


def batch_summary(done: DataFrame, path: str) -> list[dict]:
    """Writes the counts of every document of a batch as JSON, one entry for each."""
    found = [r.asDict() for r in classify.summary(done).orderBy("doc_id").collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"documents": found}, f, ensure_ascii=False, indent=2)
    return found
