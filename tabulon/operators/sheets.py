"""From spreadsheet cells to quantity records.

Input is a long table of cells: doc_id, source_file, sheet_idx, sheet, state, max_row, max_col, row, col, vtype (``s`` text,
``n`` number, ``b`` boolean, ``d`` date), str_val, num_val, ts_val. Everything is keyed by (doc_id, sheet_idx), so that one
shuffle by document carries detection, carry-down and look-ahead; the window specifications share partitioning and order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROLES = list(T.HEADER_ALIASES)
KEY = ["doc_id", "sheet_idx"]
#: Rows and columns that are searched for headers, titles and dates; rows that a quantity may stand below.
HEADER_AREA, TITLE_AREA, DATE_AREA, LOOK_AHEAD = (120, 40), (15, 15), (150, 40), 4
#: Pages that are searched for the estimate's month.
PAGES = 15
#: Columns of the roles in sheets of the legacy layout.
LEGACY_COLUMNS = {"work_type": 1, "category": 2, "item_name": 3, "specification": 4, "unit": 5, "quantity": 6, "remarks": 7, "standard": 8, "daily_output": 9, "setting": 10, "notes": 11}
NO_SUMMARY = "数量総括表という名前のシートが無いため、見出し構成が最も近い表を選択しました: "
NO_QUANTITY = "数量を読み取れませんでした。"
RECORD = [
    "source_format", "extractor", "source_sheet", "source_page", "source_row", "section", "work_type", "category", "item_name", "specification", "unit", "quantity",
    "remarks", "standard", "daily_output", "setting", "notes", "source_reference", "extraction_status", "extraction_confidence", "extraction_warnings",
]


def prepared(cells: DataFrame) -> DataFrame:
    """Cells with ``text``: what their value reads as, cleaned."""
    number = F.when(F.col("num_val") == F.col("num_val").cast("bigint"), F.col("num_val").cast("bigint").cast("string")).otherwise(F.col("num_val").cast("string"))
    shown = F.when(F.col("vtype") == "n", number).when(F.col("vtype") == "b", F.when(F.col("num_val") != 0, "True").otherwise("False")).when(F.col("vtype") == "d", F.date_format("ts_val", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("str_val"))
    return cells.withColumn("text", T.clean(shown))


def detect_tables(cells: DataFrame) -> DataFrame:
    """The best header row of each visible sheet: (doc_id, sheet_idx, sheet, header_row, c_<role>..., level, score).

    A header names item, unit and quantity and a level of hierarchy. The score prefers many roles, hierarchy and
    summary sheets; the first row wins ties."""
    area = (F.col("state") == "visible") & (F.col("row") <= HEADER_AREA[0]) & (F.col("col") <= HEADER_AREA[1])
    named = cells.filter(area).withColumn("role", T.header_role(F.col("text"))).filter("role <> ''")
    rows = named.groupBy(*KEY, "sheet", "row").agg(*(F.min(F.when(F.col("role") == r, F.col("col"))).alias(f"c_{r}") for r in ROLES))
    count = lambda roles: sum((F.col(f"c_{r}").isNotNull().cast("int") for r in roles), F.lit(0))
    level, ranks = T.summary_level(T.clean(F.col("sheet"))), count(["section", "work_type", "category"])
    rows = rows.withColumns({"level": level, "ranks": ranks}).filter("c_item_name is not null and c_unit is not null and c_quantity is not null and ranks > 0")
    rows = rows.withColumn("score", 10 * count(ROLES) + 5 * F.col("ranks") + 30 * F.col("level"))
    best = F.max_by(F.struct(F.col("row").alias("header_row"), "sheet", "level", "score", *(f"c_{r}" for r in ROLES)), F.struct("score", -F.col("row")))
    return rows.groupBy(*KEY).agg(best.alias("b")).select(*KEY, "b.*")


def select_tables(tables: DataFrame) -> DataFrame:
    """All summary tables of a document, or else its single best table with a warning (the first of equals)."""
    doc = Window.partitionBy("doc_id")
    rank = F.row_number().over(doc.orderBy(F.desc("score"), "sheet_idx"))
    found = tables.withColumns({"_top": F.max("level").over(doc), "_rank": rank})
    found = found.filter(F.when(F.col("_top") >= 3, F.col("level") == F.col("_top")).otherwise(F.col("_rank") == 1))
    warning = F.when(F.col("_top") < 3, F.array(F.concat(F.lit(NO_SUMMARY), "sheet"))).otherwise(F.array().cast("array<string>"))
    return found.withColumn("warnings", warning).drop("_top", "_rank")


def with_legacy_columns(tables: DataFrame) -> DataFrame:
    """Sheets of the legacy layout get its columns for roles that the header doesn't name."""
    legacy = F.col("sheet").rlike(T.LEGACY_SUMMARY)
    return tables.withColumns({f"c_{r}": F.when(legacy, F.coalesce(f"c_{r}", F.lit(c))).otherwise(F.col(f"c_{r}")) for r, c in LEGACY_COLUMNS.items()})


def role_rows(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """One row for each sheet row below a header, blank rows included: the cell of each role, whether the row repeats a
    header, and the table's level and section."""
    lists = tables.join(cells.groupBy(*KEY).agg(F.max("max_row").alias("last_row")), KEY)
    carried = ["sheet", "level", "header_row", "last_row", "source_file", *(f"c_{r}" for r in ROLES)]
    both = cells.drop("sheet").join(lists, KEY).filter("row > header_row and row <= last_row").select(*KEY, *carried, "row", "col", "vtype", "num_val", "text", (T.header_role(F.col("text")) != "").alias("head"))
    dense = lists.join(cells.groupBy(*KEY).agg(F.first("source_file").alias("source_file")), KEY).filter("last_row > header_row").withColumn("row", F.explode(F.sequence(F.col("header_row") + 1, F.col("last_row"))))
    blanks = dense.select(*KEY, *carried, "row", F.lit(0).alias("col"), F.lit(None).cast("string").alias("vtype"), F.lit(None).cast("double").alias("num_val"), F.lit("").alias("text"), F.lit(False).alias("head"))
    cell = F.struct("vtype", "num_val", "text", "head")
    rows = both.unionByName(blanks).groupBy(*KEY, "row").agg(
        *(F.first(c).alias(c) for c in carried),
        *(F.max(F.when(F.col("col") == F.col(f"c_{r}"), cell)).alias(f"v_{r}") for r in ROLES),
        F.coalesce(F.max(F.when(F.col("col") == 1, F.col("text"))), F.lit("")).alias("title"),
    )
    shown = [F.coalesce(F.col(f"v_{r}.text"), F.lit("")) for r in ROLES]
    checked = sum(((s != "").cast("int") for s in shown), F.lit(0))
    matched = sum((F.coalesce(F.col(f"v_{r}.head"), F.lit(False)).cast("int") for r in ROLES), F.lit(0))
    title = F.col("title").rlike("総括表|数量計算書") | F.col("title").rlike("(?U)" + T.PROJECT_LABEL)
    texts = {f"t_{r}": T.cell_text(F.col(f"v_{r}.vtype"), F.col(f"v_{r}.num_val"), s) for r, s in zip(ROLES, shown) if r != "quantity"}
    own = T.cell_quantity(F.col("v_quantity.vtype"), F.col("v_quantity.num_val"), F.coalesce("v_quantity.text", F.lit("")))
    rows = rows.withColumns(texts | {"own_quantity": own, "repeats_header": title | ((checked >= 2) & (matched >= 0.6 * checked))})
    return rows.drop("title", *(f"v_{r}" for r in ROLES))


def look_ahead(rows: DataFrame, order: list[str | Column], by: list[str], quantity: str, stops: Column, extra: str | None = None) -> DataFrame:
    """Adds ``found`` (the own quantity, or the first one up to LOOK_AHEAD rows below before a row where ``stops`` holds) and
    ``distance``, and ``found_extra``, the value of column ``extra`` where the quantity stands."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_stop", stops)
    found, distance, beyond = F.col(quantity), F.when(F.col(quantity).isNotNull(), 0), F.lit(False)
    there = F.lit(None).cast("string")
    for k in range(1, LOOK_AHEAD + 1):
        beyond = beyond | F.coalesce(F.lead("_stop", k).over(w), F.lit(True))
        below = F.lead(quantity, k).over(w)
        take = found.isNull() & ~beyond & below.isNotNull()
        if extra:
            there = F.when(take, F.lead(extra, k).over(w)).otherwise(there)
        distance = F.when(take, k).otherwise(distance)
        found = F.coalesce(found, F.when(~beyond, below))
    return rows.withColumns({"found": found, "distance": F.coalesce(distance, F.lit(0)), "found_extra": there}).drop("_stop")


def consumed(rows: DataFrame, order: list[str | Column], by: list[str], live: Column) -> DataFrame:
    """Adds ``consumed``: whether a live row above has taken this row's quantity. Such a row has a quantity of its own and never
    takes another, so that this needs no recursion."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_live", live)
    taken = [F.coalesce((F.lag("distance", k).over(w) == k) & F.lag("_live", k).over(w), F.lit(False)) for k in range(1, LOOK_AHEAD + 1)]
    return rows.withColumn("consumed", reduce(lambda a, b: a | b, taken)).drop("_live")


def carry_down(rows: DataFrame, order: list[str | Column], by: list[str], levels: list[str], resets: bool = True) -> DataFrame:
    """Adds ``f_<level>``: the last non-blank value so far; a value of a higher level resets the lower ones (not with ``resets`` off).

    A level's reset count travels with its value, so that all levels use one window and one sort."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    given = {c: F.coalesce(F.col(c), F.lit("")) != "" for c in levels}
    counts, higher = {}, F.lit(False)
    for c in levels:
        counts[f"_g_{c}"] = F.sum(higher.cast("int")).over(w) if resets else F.lit(0)
        higher = higher | given[c]
    rows = rows.withColumns(counts)
    last = {f"_l_{c}": F.last(F.when(given[c], F.struct(F.col(f"_g_{c}").alias("g"), F.col(c).alias("v"))), ignorenulls=True).over(w) for c in levels}
    rows = rows.withColumns(last)
    filled = {f"f_{c}": F.when(F.col(f"_l_{c}.g") == F.col(f"_g_{c}"), F.col(f"_l_{c}.v")).otherwise("") for c in levels}
    return rows.withColumns(filled).drop(*counts, *last)


def records(cells: DataFrame) -> DataFrame:
    """Quantity records (RECORD columns, with doc_id and sheet_idx) of prepared cells; documents without a table have none."""
    tables = with_legacy_columns(select_tables(detect_tables(cells)))
    rows = role_rows(cells, tables)
    stops = reduce(lambda a, b: a | b, (F.col(f"t_{r}") != "" for r in ("section", "work_type", "category", "item_name", "unit")))
    rows = look_ahead(rows, ["row"], KEY, "own_quantity", stops, "t_standard")
    total = T.is_total(*(F.col(f"t_{r}") for r in ("section", "work_type", "category", "item_name", "specification")))
    rows = rows.withColumn("_live", ~F.col("repeats_header") & ~total)
    rows = consumed(rows, ["row"], KEY, F.col("_live")).filter("_live and not consumed")
    rows = carry_down(rows, ["row"], KEY, ["t_section", "t_work_type", "t_category", "t_item_name"])
    rows = carry_down(rows, ["row"], KEY, ["t_unit"])
    explicit = reduce(lambda a, b: a | b, (F.col(f"t_{r}") != "" for r in ROLES if r != "quantity"))
    own = T.section_of_sheet(T.clean(F.col("sheet")))
    nonblank = lambda a, b: F.when(a != "", a).otherwise(b)
    inherits = (F.col("t_specification") != "") | F.col("found").isNotNull()
    rows = rows.filter(explicit | F.col("found").isNotNull()).withColumns({
        "section": nonblank(F.col("f_t_section"), own), "work_type": F.col("f_t_work_type"), "category": F.col("f_t_category"),
        "item_name": nonblank(F.col("t_item_name"), F.col("f_t_item_name")), "unit": nonblank(F.col("t_unit"), F.when(inherits, F.col("f_t_unit")).otherwise("")),
    })
    # Zeros below an inherited label are cached formulas, not work.
    artefact = (F.col("found") == 0) & (F.col("t_item_name") == "") & (F.col("t_specification") == "") & (F.col("t_remarks") == "")
    rows = rows.filter((F.col("item_name") != "") & (F.col("unit") != "") & ~F.coalesce(artefact, F.lit(False)))
    missing = F.col("found").isNull()
    sure = F.when(F.col("level") >= 3, 0.98).otherwise(0.9)
    below = F.when(F.col("distance") > 0, F.coalesce("found_extra", F.lit(""))).otherwise("")
    done = rows.withColumns({
        "source_format": F.lit("excel"), "extractor": F.lit("excel_header_table"), "source_sheet": F.col("sheet"), "source_page": F.lit(None).cast("int"), "source_row": F.col("row"), "quantity": F.col("found"),
        **{r: F.col(f"t_{r}") for r in ("specification", "remarks", "standard", "daily_output", "setting", "notes")}, "source_reference": nonblank(F.col("t_source_reference"), below),
        "extraction_status": F.when(missing, "SOURCE_REVIEW_REQUIRED").otherwise("READY"), "extraction_confidence": F.when(missing, F.least(sure, F.lit(0.65))).otherwise(sure),
        "extraction_warnings": F.when(missing, F.array(F.lit(NO_QUANTITY))).otherwise(F.array().cast("array<string>")),
    })
    return done.select(*KEY, "source_file", *RECORD)


def project_names(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, project): the first title above a selected table that names one, else the file name's."""
    near = cells.join(tables.select(*KEY, "header_row"), KEY).filter((F.col("row") <= F.least("header_row", F.lit(TITLE_AREA[0]))) & (F.col("col") <= TITLE_AREA[1]))
    found = near.withColumn("name", T.project_of_title(T.label(F.col("text")))).filter("name <> ''").groupBy("doc_id").agg(F.min_by("name", F.struct("sheet_idx", "row", "col")).alias("name"))
    stem = F.regexp_replace(F.regexp_extract("source_file", r"[^/\\]*$", 0), r"\.[^.]*$", "")
    files = cells.groupBy("doc_id").agg(F.first("source_file").alias("source_file"))
    return files.join(found, "doc_id", "left").select("doc_id", F.coalesce("name", T.project_of_file(stem)).alias("project"))


def estimate_months(cells: DataFrame, today: Column | None = None) -> DataFrame:
    """(doc_id, month, month_source): the first month in a cell with one of the labels or the four cells to its right, on any sheet, hidden
    ones included; else today's date."""
    area = cells.filter((F.col("row") <= DATE_AREA[0]) & (F.col("col") <= DATE_AREA[1]))
    w = Window.partitionBy(*KEY, "row").orderBy("col").rangeBetween(0, 4)
    month = F.when(F.col("vtype") == "d", F.trunc(F.to_date("ts_val"), "month")).otherwise(T.year_month(F.col("text")))
    near = F.collect_list(F.struct("col", "month")).over(w)
    labelled = reduce(lambda a, b: a | b, (F.col("text").contains(x) for x in T.MONTH_LABELS))
    first = F.get(F.filter(F.array_sort("near"), lambda x: x["month"].isNotNull()), F.lit(0))["month"]
    found = area.withColumn("month", month).withColumn("near", near).filter(labelled).withColumn("month", first).filter("month is not null")
    found = found.groupBy("doc_id").agg(F.min_by("month", F.struct("sheet_idx", "row", "col")).alias("month"))
    docs = cells.select("doc_id").distinct().join(found, "doc_id", "left")
    source = F.when(F.col("month").isNull(), "PC_DATE").otherwise("SOURCE")
    return docs.select("doc_id", F.coalesce("month", today if today is not None else F.current_date()).alias("month"), source.alias("month_source"))


def estimate_months_of_pages(pages: DataFrame, today: Column | None = None) -> DataFrame:
    """(doc_id, month, month_source) from page texts (doc_id, page, page_text): the first labelled line of the first PAGES pages that names a month."""
    lines = pages.filter(F.col("page") <= PAGES).select("doc_id", "page", F.posexplode(F.split("page_text", r"\r\n|\r|\n")).alias("line", "raw"))
    labelled = reduce(lambda a, b: a | b, (F.col("raw").contains(x) for x in T.MONTH_LABELS))
    found = lines.filter(labelled).withColumn("month", T.year_month(T.clean(F.col("raw")))).filter("month is not null")
    found = found.groupBy("doc_id").agg(F.min_by("month", F.struct("page", "line")).alias("month"))
    docs = pages.select("doc_id").distinct().join(found, "doc_id", "left")
    source = F.when(F.col("month").isNull(), "PC_DATE").otherwise("SOURCE")
    return docs.select("doc_id", F.coalesce("month", today if today is not None else F.current_date()).alias("month"), source.alias("month_source"))
