"""Items from records, their status, and the counts of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Keywords of each category of work, in order of preference.
WORK_TERMS = {
    "橋梁工事": ["橋", "橋梁", "支承", "伸縮装置", "地覆", "胸壁", "床版", "主桁"],
    "下水道工事（２）": ["下水", "管渠", "マンホール", "汚水", "雨水", "推進工"],
    "道路工事": ["道路", "舗装", "路盤", "区画線", "側溝"],
}
PROJECT_HIT, LEAST_HITS = 3, 2
BAD_QUANTITY = "数量を取得できない、または数量が0以下です"
UNCHECKED_SOURCE = "原本照合が完了するまでコードを確定しません"


def items(records: DataFrame) -> DataFrame:
    """Records as items: numbering is taken off the hierarchy, and every item of a document gets its order ``ord`` (unique over documents)."""
    levels = {c: T.hierarchy_label(T.clean(F.col(c))) for c in ("section", "work_type", "category")}
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_idx", F.coalesce("source_page", F.lit(0)), "source_row", "source_reference"))
    return records.withColumns(levels).withColumn("place", place).withColumn("ord", F.concat_ws("#", "doc_id", "place"))


def status() -> tuple[Column, Column]:
    """(match_status, confidence) of filled items; the first case that applies."""
    cases = [
        (F.col("quantity").isNull() | (F.col("quantity") <= 0), "INVALID_QUANTITY", F.lit(0.0)),
        (F.col("extraction_status") != "READY", "SOURCE_REVIEW_REQUIRED", F.least(F.lit(0.5), F.col("extraction_confidence"))),
        ((F.col("output_code") != "") & F.col("code_safe"), "CATALOG_EXACT_CODE", F.lit(0.98)),
        (F.col("catalog_status").isin("EXACT_PATH", "EXACT_CODE"), "NAME_SEARCH", F.lit(0.9)),
        (F.col("catalog_status") == "FUZZY_PATH", "NAME_SEARCH_REVIEW", F.lit(0.65)),
        (F.col("catalog_status").endswith("_GROUP_PATH"), "NAME_SEARCH_GROUP", F.lit(0.55)),
    ]
    name, sure = F.lit("NAME_SEARCH_REQUIRED"), F.lit(0.35)
    for case, n, c in reversed(cases):
        name, sure = F.when(case, n).otherwise(name), F.when(case, c).otherwise(sure)
    return name, sure


def classify(df: DataFrame) -> DataFrame:
    name, sure = status()
    df = df.withColumns({"match_status": name, "confidence": sure})
    warnings = T.add_warning(F.col("extraction_warnings"), BAD_QUANTITY, F.col("match_status") == "INVALID_QUANTITY")
    return df.withColumn("warnings", T.add_warning(warnings, UNCHECKED_SOURCE, F.col("match_status") == "SOURCE_REVIEW_REQUIRED"))


def work_categories(df: DataFrame, projects: DataFrame, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, work_category): the category with most keyword hits, a hit in the project's name counting threefold; blank below two."""
    terms = terms or WORK_TERMS
    context = T.combine_unique(*(T.clean(F.col(c)) for c in ("work_type", "category", "item_name", "specification")))
    holds = lambda c, words: reduce(lambda a, b: a | b, (c.contains(w) for w in words))
    df = df.withColumn("_context", context)
    hits = df.groupBy("doc_id").agg(*(F.sum(holds(F.col("_context"), w).cast("int")).alias(f"_h{i}") for i, w in enumerate(terms.values())))
    both = projects.withColumn("_p", T.clean(F.col("project"))).join(hits, "doc_id", "left")
    total = [F.coalesce(f"_h{i}", F.lit(0)) + F.when(holds(F.col("_p"), w), PROJECT_HIT).otherwise(0) for i, w in enumerate(terms.values())]
    best, out = F.greatest(*total), F.lit("")
    for n, name in reversed(list(zip(total, terms))):
        out = F.when(n == best, name).otherwise(out)
    return both.select("doc_id", F.when(best >= LEAST_HITS, out).otherwise("").alias("work_category"))


def summary(df: DataFrame) -> DataFrame:
    """(doc_id, source_items, review_required, matched, codes) of classified items."""
    return df.groupBy("doc_id").agg(
        F.count("*").alias("source_items"), F.count_if(F.col("match_status").isin("INVALID_QUANTITY", "SOURCE_REVIEW_REQUIRED")).alias("review_required"),
        F.count_if(F.col("catalog_status").isin("EXACT_CODE", "EXACT_PATH", "FUZZY_PATH")).alias("matched"), F.count_if(F.col("output_code") != "").alias("codes"),
    )


def counts(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), column).agg(F.count("*").alias("n"))
