"""Tables from scans: recognised words to cells, repairs, column roles, and records.

Recognition itself is an external program; its JSON is the input: ocr(file, text, lines array<struct<text, words array<struct<text, x, y,
width, height>>>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import reachable
from . import grids as G
from .sheets import carry_down

#: Repairs of common misreadings, applied in order.
REPAIRS = [
    ("断面修復ェ", "断面修復工"), ("舎甫装工", "舗装工"), ("理戻し", "埋戻し"), ("! 卞卆", "型枠"), ("飾所", "箇所"), ("ァンカーホ 。 ルト", "アンカーボルト"),
    ("プンカーホ 。 ルト", "アンカーボルト"), ("鋼製六角ハ 。 ネル", "鋼製六角パネル"), ("コなズョイント", "ゴムジョイント"), ("デムズョイント", "ゴムジョイント"),
    ("耐グレーー型", "耐グレーダー型"), ("ー廃棄物重量", "廃棄物重量"), ("M ー 40", "M-40"), ("30 ー 12 ー 25BB", "30-12-25BB"), ("ミ 55 %", "≤55%"), ("ミ55%", "≤55%"),
    ("揚カ", "揚力"), ("べース", "ベース"), ("rn3", "m3"), ("rn2", "m2"), ("r n 3", "m3"), ("r n 2", "m2"),
]
#: Column orders of tables by their number of columns.
ORDERS = {
    5: {"work_type": 0, "category": 1, "item_name": 1, "unit": 2, "quantity": 3, "remarks": 4},
    6: {"work_type": 0, "category": 1, "item_name": 1, "specification": 2, "unit": 3, "quantity": 4, "remarks": 5},
    7: {"work_type": 0, "category": 1, "item_name": 2, "specification": 3, "unit": 4, "quantity": 5, "remarks": 6},
    8: {"section": 0, "work_type": 1, "category": 2, "item_name": 3, "specification": 4, "unit": 5, "quantity": 6, "remarks": 7},
}
ROLES = ["section", "work_type", "category", "item_name", "specification", "unit", "remarks", "quantity"]
SCAN_WARNING = "PDF OCR行です。原本の名称・規格・単位・数量を確認してください。"
NO_QUANTITY, NO_UNIT = "数量OCRを確定できませんでした。", "単位OCRを確定できませんでした。"
MEASURE = r"(?:L=|\d+(?:\.\d+)?mm)"
SIMILAR = 0.35


def repaired(labelled: Column) -> Column:
    """A label with common misreadings put right."""
    out = labelled
    for wrong, right in REPAIRS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = F.regexp_replace(out, r"(?U)中\s*(?=\d+\s*mm)", "Φ")
    out = F.regexp_replace(out, r"(?U)中\s*(\d+)m\b", "Φ$1mm")
    out = F.regexp_replace(out, r"(?U)^\s*=\s*(\d+)", "t=$1")
    return F.when(T.compact(labelled).rlike("^シー(?:ノ)?レ(?:卞オ|本オ|材)$"), "シール材").otherwise(out)


def decoded(lines: Column, text: Column) -> Column:
    """What one cell holds whose image was repeated: the word, if all words are the same; else the part of which the text is 5, 4 or 3
    copies; else the only word. ``lines`` as in the input, ``text`` cleaned."""
    words = F.filter(F.transform(F.flatten(F.transform(F.coalesce(lines, F.array()), lambda x: x["words"])), lambda w: T.squeeze(w["text"])), lambda w: w != "")
    short, out = T.compact(text), F.lit("")
    out = F.when(F.size(words) == 1, F.get(words, F.lit(0))).otherwise(out)
    for n in (3, 4, 5):
        part = F.substring(short, F.lit(1), (F.length(short) / n).cast("int"))
        out = F.when((short != "") & (F.length(short) % n == 0) & (F.repeat(part, n) == short), part).otherwise(out)
    return F.when((F.size(words) >= 3) & (F.size(F.array_distinct(words)) == 1), F.get(words, F.lit(0))).otherwise(out)


def with_repeats(first: DataFrame, repeated: DataFrame) -> DataFrame:
    """(file, text) of a first reading, blanks filled from the reading of repeated images."""
    again = repeated.select("file", decoded(F.col("lines"), T.clean(F.col("text"))).alias("again"))
    both = first.select("file", "text").join(again, "file", "full")
    blank = T.clean(F.col("text")) == ""
    return both.select("file", F.when(blank & (F.coalesce("again", F.lit("")) != ""), F.col("again")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def matrix(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """(doc_id, page, row, cells) from readings (doc_id, page, file ``r000_c000.png``, text) and shapes (doc_id, page, rows, columns)."""
    place = cells.select("doc_id", "page", F.regexp_extract("file", r"r(\d+)_c(\d+)", 1).cast("int").alias("row"), F.regexp_extract("file", r"r(\d+)_c(\d+)", 2).cast("int").alias("col"), T.label(T.clean(F.col("text"))).alias("text"))
    dense = shapes.select("doc_id", "page", "columns", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    found = place.groupBy("doc_id", "page", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    full = dense.join(found, ["doc_id", "page", "row"], "left")
    return full.select("doc_id", "page", "row", F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))).alias("cells"))


def words_to_columns(words: DataFrame, by: list[str], x: str, edges: Column) -> DataFrame:
    """``words`` with ``column``: the first interval of the ascending ``edges`` (an array) that holds ``x``, both ends included;
    words outside all of them are left out. Edges travel with the row, so that no range join is needed."""
    hit = F.filter(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: (F.get(edges, i) <= F.col(x)) & (F.col(x) <= F.get(edges, i + 1)))
    return words.withColumn("column", F.get(hit, F.lit(0))).filter("column is not null")


def row_candidates(ocr: DataFrame, transforms: DataFrame) -> DataFrame:
    """(doc_id, page, row, column, candidate): words of row images put back into columns. ``ocr``: doc_id, page, file ``row-0.png``, lines;
    ``transforms``: doc_id, page, file, left, scale, vertical (edges)."""
    lines = ocr.join(transforms, ["doc_id", "page", "file"]).select("doc_id", "page", F.regexp_extract("file", r"row-(\d+)", 1).cast("int").alias("row"), "left", "scale", "vertical", F.posexplode("lines").alias("line", "l"))
    words = lines.select("doc_id", "page", "row", "left", "scale", "vertical", "line", F.explode("l.words").alias("w"))
    words = words.withColumn("x", F.col("left") + (F.col("w.x") + F.col("w.width") / 2) / F.col("scale"))
    placed = words_to_columns(words, [], "x", F.col("vertical"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x", F.col("w.text").alias("t")))), lambda p: p["t"]), " ")
    return placed.groupBy("doc_id", "page", "row", "column").agg(text.alias("t")).select("doc_id", "page", "row", "column", T.label(T.clean(F.col("t"))).alias("candidate"))


def arbitrated(existing: Column, candidate: Column, similar: Column) -> Column:
    """The better of two readings of a cell (labels): blanks are filled, and a reading with a measurement replaces a similar one without, or lends it its unit."""
    old, new = T.compact(existing), T.compact(candidate)
    better = new.rlike(MEASURE) & ~old.rlike(MEASURE) & (similar >= SIMILAR)
    size = F.regexp_extract(new, r"(\d+(?:\.\d+)?)mm", 1)
    at = F.position(size, existing)
    lent = F.concat(F.substring(existing, F.lit(1), at - 1), size, F.lit("mm"), F.substring(existing, at + F.length(size), F.length(existing)))
    has = (size != "") & F.contains(old, size)
    return F.when(existing == "", candidate).when(better, F.when(F.contains(new, F.lit("L=")), candidate).when(has & (at > 0), lent).otherwise(candidate)).otherwise(existing)


def merged_rows(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, page, row, column, text): cells with the candidates of :func:`row_candidates` arbitrated in."""
    both = cells.join(candidates, ["doc_id", "page", "row", "column"], "left").withColumn("candidate", F.coalesce("candidate", F.lit("")))
    pick = arbitrated(F.col("text"), F.col("candidate"), T.ratio(T.compact(F.col("text")), T.compact(F.col("candidate"))))
    return both.select("doc_id", "page", "row", "column", F.when(F.col("candidate") == "", F.col("text")).otherwise(pick).alias("text"))


def column_roles(rows: DataFrame) -> DataFrame:
    """(doc_id, page, header_row, columns map): from the best header of the first four rows, or the fixed order for the number of columns. Pages with neither
    are left out."""
    named = rows.filter("row < 4").withColumn("_r", F.transform("cells", lambda c: T.header_role(T.squeeze(c))))
    at = {r: F.nullif(F.array_position("_r", r), F.lit(0)) - 1 for r in T.HEADER_ALIASES}
    pairs = F.filter(F.array(*(F.struct(F.lit(r).alias("r"), c.cast("int").alias("c")) for r, c in at.items())), lambda p: p["c"].isNotNull())
    named = named.withColumn("_p", pairs).withColumn("_n", F.size("_p"))
    best = named.groupBy("doc_id", "page").agg(F.max(F.size("cells")).alias("width"), F.max_by(F.struct("row", F.map_from_entries("_p").alias("m"), F.col("_n").alias("n")), F.struct("_n", -F.col("row"))).alias("b"))
    get = lambda r: F.try_element_at("b.m", F.lit(r))
    fixed = {n: F.create_map(*(x for k, v in o.items() for x in (F.lit(k), F.lit(v)))) for n, o in ORDERS.items()}
    whole = get("item_name").isNotNull() & get("unit").isNotNull() & get("quantity").isNotNull()
    road = (F.col("width") == 6) & (get("unit") == 3) & (get("quantity") == 4)
    columns = F.when(F.col("width") == 5, fixed[5]).when(road, fixed[6]).when(whole, F.col("b.m"))
    for n in (6, 7, 8):
        columns = columns.when(F.col("width") == n, fixed[n])
    header = F.when((F.col("width") == 5) & (F.col("b.n") == 0), -1).when((F.col("width") == 5) | road | whole, F.col("b.row")).otherwise(0)
    return best.select("doc_id", "page", header.alias("header_row"), columns.alias("columns")).filter("columns is not null")


def records(rows: DataFrame) -> DataFrame:
    """Records (as of :mod:`grids`) of scanned tables (doc_id, page, row, cells).

    Levels are carried down over runs of neighbouring pages. A row of nothing but a specification belongs to the record of the row just above it;
    below a row without a record, and below a row that was taken in that way, it is a record of its own. So in a series of such rows every second
    one is taken, counted from the last row whose record doesn't depend on the series."""
    reachable(rows.sparkSession)
    placed = rows.withColumn("_t", F.transform(T.nfkc_all(F.col("cells")), lambda x: T.label(T.squeeze(x))))
    placed = placed.join(column_roles(rows), ["doc_id", "page"]).filter("row > header_row")
    value = lambda r: F.coalesce(repaired(F.get("_t", F.coalesce(F.try_element_at("columns", F.lit(r)), F.lit(-1)))), F.lit(""))
    table = placed.select("doc_id", "page", "row", *(value(r).alias(r) for r in ROLES)).withColumn("number", T.scanned_quantity(F.col("quantity")))
    pages = Window.partitionBy("doc_id").orderBy("page", "row")
    apart = F.coalesce(F.col("page") - F.lag("page").over(pages) > 1, F.lit(True))
    table = table.withColumn("_run", F.sum(apart.cast("int")).over(pages))
    texts = [r for r in ROLES if r != "quantity"]
    other = G.any_of(F.col(r) != "" for r in texts if r != "specification")
    counts = F.col("number").isNotNull()
    lone = (F.col("specification") != "") & ~other & ~counts
    total = T.is_total(*(F.col(r) for r in texts))
    live = ~total & (other | counts | (F.col("specification") != ""))
    levels = ["section", "work_type", "category", "item_name", "unit"]
    # Total rows pass nothing on.
    table = table.withColumns({"_lone": lone, "_total": total, "_live": live} | {f"_{c}": F.when(live, F.col(c)).otherwise("") for c in levels})
    order, by = ["page", "row"], ["doc_id", "_run"]
    table = carry_down(table, order, by, ["_work_type", "_category", "_item_name"])
    table = carry_down(table, order, by, ["_section", "_unit"], resets=False)
    inherits = (F.col("item_name") == "") & ((F.col("specification") != "") | counts)
    unit = F.when(F.col("unit") != "", F.col("unit")).otherwise(F.when(inherits, F.col("f__unit")).otherwise(""))
    table = table.withColumns({"_own": F.col("unit"), "unit": unit})
    whole = F.col("_live") & (F.col("f__item_name") != "") & (counts | (F.col("unit") != ""))
    page = Window.partitionBy("doc_id", "page").orderBy("row")
    # A row that settles the question for those below: whether it has a record is known without them.
    settled = F.when(~F.col("_lone") | F.col("_total"), F.struct("row", whole.alias("has")))
    first = F.when(F.col("row") - F.lag("row", 1, -2).over(page) != 1, F.struct((F.col("row") - 1).alias("row"), F.lit(False).alias("has")))
    table = table.withColumns({"_whole": whole, "_settled": F.coalesce(settled, first)})
    table = table.withColumn("_since", F.last("_settled", ignorenulls=True).over(page))
    odd = (F.col("row") - F.col("_since.row")) % 2 == 1
    table = table.withColumns({
        "_has": F.when(F.col("_lone"), F.col("_whole") & (F.col("_since.has") != odd)).otherwise(F.col("_whole")),
        "_next": F.when(F.lead("_lone").over(page) & (F.lead("row").over(page) == F.col("row") + 1), F.lead("specification").over(page)),
    })
    found = table.filter("_has")
    place = F.concat(F.lit("PDF p."), F.col("page").cast("string"))
    warnings = F.array_compact(F.array(
        F.lit(SCAN_WARNING), F.when(~counts, F.lit(NO_QUANTITY)), F.when(F.col("unit") == "", F.lit(NO_UNIT)), F.when(F.col("_next").isNotNull(), F.lit(G.JOINED_WARNING)),
    ))
    return found.select(
        "doc_id", place.alias("source_sheet"), F.col("page").cast("int").alias("source_page"), (F.col("row") + 1).cast("int").alias("source_row"),
        F.when(F.col("f__section") != "", F.col("f__section")).otherwise(G.NO_SECTION).alias("section"), F.col("f__work_type").alias("work_type"), F.col("f__category").alias("category"),
        F.col("f__item_name").alias("item_name"), T.note(F.col("specification"), F.coalesce("_next", F.lit(""))).alias("specification"), "unit", F.col("number").alias("quantity"), "remarks",
        place.alias("source_reference"), F.lit("OCR_REVIEW_REQUIRED").alias("extraction_status"), F.when(counts & (F.col("unit") != ""), 0.7).otherwise(0.45).alias("extraction_confidence"),
        warnings.alias("extraction_warnings"),
    )


def unit_glyphs(matches: DataFrame) -> DataFrame:
    """(cell, unit): the best template of each blank unit cell, if it is close enough and clear of the second. ``matches``: cell, unit, ink and template
    (arrays of 0 and 1), aspect."""
    found = matches.withColumn("score", T.dice(F.col("ink"), F.col("template")) * F.col("aspect")).groupBy("cell", "unit").agg(F.max("score").alias("score"))
    w = Window.partitionBy("cell").orderBy(F.desc("score"), "unit")
    ranked = found.withColumns({"rank": F.row_number().over(w), "second": F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    return ranked.filter((F.col("rank") == 1) & (F.col("score") >= 0.62) & (F.col("score") - F.col("second") >= 0.06)).select("cell", "unit", "score")
