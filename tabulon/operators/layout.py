"""Output blocks and their place on the pages of a workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Sheets of the template, layout of a page, header cells, and column and marker of each level.
SHEETS = ["鏡", "本工事費内訳表", "内訳書", "明細書", "代価表", "単価表", "施工パッケージ"]
COVER, MAIN = SHEETS[:2]
PAGE_ROWS, SLOTS, SLOT_ROWS, HEADER_ROWS = 40, 9, 4, 3
HEADER = [(0, 1, "本工事費内訳表"), (2, 1, "費目　工種　種別　細別・規格"), (2, 8, "数　　量"), (2, 10, "単　位"), (2, 11, "単　　価"), (2, 12, "金　　額"), (2, 13, "摘　　　　要")]
LEVELS = [("fee", "費目行", 1), ("work", "工種行", 2), ("category", "種別行", 3), ("subcategory", "細別行", 4), ("specification_group", "規格行", 5)]


def blocks(items: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """(by, order, block, level, value, marker, item columns): a header block for each level whose value changes, then the item.

    ``items`` has levels ``l1`` .. ``l5`` (blank sub-levels allowed), ``name``. A change of a level is also a change of those below. A sub-level that
    is blank is forgotten, and a group of the last level without one above it is repeated for each item."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = {n: F.lag(f"l{n}").over(w) for n in range(1, 6)}
    first = F.row_number().over(w) == 1
    change = first
    changes = {}
    for n in (1, 2, 3):
        change = change | (F.col(f"l{n}") != before[n])
        changes[n] = change
    changes[4] = (F.col("l4") != "") & (change | (F.col("l4") != before[4]))
    changes[5] = (F.col("l5") != "") & (change | (F.col("l4") == "") | (F.col("l4") != before[4]) | (F.col("l5") != before[5]))
    parts = [F.when(changes[n], F.struct(F.lit(level).alias("level"), F.col(f"l{n}").alias("value"), F.lit(marker).alias("marker"))) for n, (level, marker, _) in zip(range(1, 6), LEVELS)]
    item = F.struct(F.lit("item").alias("level"), F.col("name").alias("value"), F.lit("").alias("marker"))
    found = items.withColumn("_b", F.array_compact(F.array(*parts, item)))
    return found.select(*items.columns, F.posexplode("_b").alias("_pos", "_block")).select(*items.columns, "_pos", "_block.*")


def numbered(found: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """Blocks with ``block`` (from 0), ``page``, ``slot`` and ``top``, the first of their four rows."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "_pos")) - 1
    found = found.withColumn("block", number).withColumns({"page": F.floor(F.col("block") / SLOTS).cast("int"), "slot": F.col("block") % SLOTS})
    return found.withColumn("top", 1 + F.col("page") * PAGE_ROWS + HEADER_ROWS + F.col("slot") * SLOT_ROWS)


def item_blocks(df: DataFrame) -> DataFrame:
    """Numbered blocks of classified items; items without a valid quantity are left out."""
    nonblank = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(F.lit(other))
    kept = df.filter("match_status <> 'INVALID_QUANTITY'").withColumns({
        "l1": nonblank("output_level1", "本工事費"), "l2": nonblank("output_level2", "工種未確認"), "l3": nonblank("output_level3", "種別未確認"),
        "l4": T.squeeze(F.col("output_subcategory")), "l5": T.squeeze(F.col("output_specification_group")), "name": T.squeeze(F.col("output_level4")),
    })
    kept = kept.select("doc_id", "place", "l1", "l2", "l3", "l4", "l5", "name", "quantity", "unit", "output_item_column", "output_code", "output_condition")
    return numbered(blocks(kept, ["doc_id"], ["place"]), ["doc_id"], ["place"])


def cell_writes(found: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, col, text, number): the cells of numbered blocks and of the page headers. Prices are never written."""

    def cell(row: Column, col: Column | int, text: Column | str | None = None, number: Column | int | None = None) -> Column:
        lit = lambda x, kind: (F.lit(x) if not isinstance(x, Column) else x).cast(kind)
        return F.struct(lit(row, "int").alias("row"), lit(col, "int").alias("col"), lit(text, "string").alias("text"), lit(number, "double").alias("number"))

    top, page = F.col("top"), F.col("page")
    start = 1 + page * PAGE_ROWS
    head = [cell(start + r, c, t) for r, c, t in HEADER] + [cell(start + 1, 13, number=page + 2)]
    column = F.coalesce(*(F.when(F.col("level") == level, c) for level, _, c in LEVELS), F.least(F.greatest("output_item_column", F.lit(4)), F.lit(6)))
    group = [cell(top, column, F.col("value")), cell(top, 8, number=1), cell(top, 10, "式"), cell(top + 1, 13, F.col("marker"))]
    code = F.when(F.col("output_code") != "", F.concat(F.lit("["), "output_code", F.lit("]"))).otherwise("")
    item = [cell(top, column, F.col("value")), cell(top, 8, number=F.col("quantity")), cell(top, 10, F.col("unit")), cell(top, 13, code), cell(top + 1, 4, F.col("output_condition"))]
    own = F.when(F.col("level") == "item", F.array(*item)).otherwise(F.array(*group))
    cells = F.when(F.col("slot") == 0, F.concat(F.array(*head), own)).otherwise(own)
    return found.select("doc_id", F.lit(MAIN).alias("sheet"), F.inline(cells))


def cover_writes(covers: DataFrame) -> DataFrame:
    """The cover's cells of (doc_id, project, location, work_category, district, month)."""
    rows = [(6, 4, "project"), (7, 4, "location"), (8, 5, None), (20, 10, None), (21, 4, "work_category"), (21, 10, "month"), (20, 15, "district")]
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), (F.col(v).cast("string") if v else F.lit(None).cast("string")).alias("text"), F.lit(None).cast("double").alias("number")) for r, c, v in rows))
    return covers.select("doc_id", F.lit(COVER).alias("sheet"), F.inline(cells))


def capacity(max_row: int) -> int:
    """Blocks that a main sheet of so many rows holds."""
    return ((max_row - 1) // PAGE_ROWS + 1) * SLOTS
