"""Catalog of known entries: from an accepted detail sheet, its merge, and its JSON form.

Entry columns: level1..level5, item_name, specification, unit, code, source_file, source_row, item_column, reference_type,
reference_text, ord (position in the merged catalog, which breaks ties in matching).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from .sheets import KEY

#: Sheet, marker of each level, its code pattern, and the 13 columns that are read.
SHEET = "本工事費内訳表"
MARKERS = {"費目行": 1, "工種行": 2, "種別行": 3, "細別行": 4, "規格行": 5}
CODE = r"^\[([A-Z]{2}\d{6})\]$"
COLUMNS = 13
LEVELS = [f"level{i}" for i in range(1, 6)]
DEDUP = [*LEVELS, "item_name", "specification", "unit", "code", "item_column", "reference_type"]
ENTRY = S.StructType([*(S.StructField(c, S.StringType()) for c in (*LEVELS, "item_name", "specification", "unit", "code", "source_file")), S.StructField("source_row", S.LongType()), S.StructField("item_column", S.LongType()), S.StructField("reference_type", S.StringType()), S.StructField("reference_text", S.StringType())])


def entries(cells: DataFrame) -> DataFrame:
    """Entries of the detail sheets in prepared cells. A marker names the level whose label stands in the row above and
    clears the deeper ones; a row is an entry if it has a name, a unit and a number, and the row below is no marker."""
    area = cells.filter((F.col("sheet") == SHEET) & (F.col("col") <= COLUMNS))
    value = lambda c: F.coalesce(F.max(F.when(F.col("col") == c, F.col("text"))), F.lit(""))
    rows = area.groupBy(*KEY, "row").agg(F.first("source_file").alias("source_file"), *(value(c).alias(f"x{c}") for c in (1, 2, 3, 4, 5, 6, 10, 13)), F.max(F.when((F.col("col") == 8) & (F.col("vtype") == "n"), F.lit(True))).alias("counted"))
    # The row below and the row above are physical rows, so blank rows count.
    spans = area.groupBy(*KEY).agg(F.first("source_file").alias("source_file"), F.max("row").alias("last"))
    dense = spans.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("last")))).drop("last", "source_file")
    rows = dense.join(rows, [*KEY, "row"], "left").fillna("", [f"x{c}" for c in (1, 2, 3, 4, 5, 6, 10, 13)])
    w = Window.partitionBy(*KEY).orderBy("row")
    number = F.coalesce(*(F.when(F.col("x13") == m, n) for m, n in MARKERS.items()), F.lit(0))
    rows = rows.withColumns({"marks": number, "below": F.lead("x13").over(w)})
    named = F.coalesce(*(F.when(F.col("marks") == n, F.lag(f"x{n}").over(w)) for n in range(1, 6)), F.lit(""))
    rows = rows.withColumns({"named": named, "conditions": F.array(*(F.lead(f"x{c}").over(w) for c in (4, 5, 6)))})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    for n in range(1, 6):
        resets = F.sum(F.when((F.col("named") != "") & (F.col("marks") < n) & (F.col("marks") > 0), 1).otherwise(0)).over(running)
        rows = rows.withColumn(f"_g{n}", resets)
    for n in range(1, 6):
        mine = (F.col("marks") == n) & (F.col("named") != "")
        last = F.last(F.when(mine, F.struct(F.col(f"_g{n}").alias("g"), F.col("named").alias("v"))), ignorenulls=True).over(running)
        rows = rows.withColumn(f"_l{n}", last)
    rows = rows.withColumns({f"level{n}": F.when(F.col(f"_l{n}.g") == F.col(f"_g{n}"), F.col(f"_l{n}.v")).otherwise("") for n in range(1, 6)})
    columns = F.filter(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"x{c}").alias("v")) for c in (4, 5, 6))), lambda p: p["v"] != "")
    leaf = F.try_element_at(columns, F.lit(-1))
    below = F.coalesce("below", F.lit(""))
    kind = F.when(below.startswith("施工 "), "施工").when(below.startswith("明細 "), "明細").when(below.contains("内訳書"), "内訳").otherwise("")
    rows = rows.withColumns({"leaf": leaf, "reference_type": kind, "below": below})
    rows = rows.filter((F.col("marks") == 0) & ~F.col("below").isin(list(MARKERS)) & F.col("leaf").isNotNull() & (F.col("x10") != "") & F.coalesce("counted", F.lit(False)))
    return rows.select(
        "doc_id", *LEVELS, F.col("leaf.v").alias("item_name"), T.combine_unique_all(F.col("conditions")).alias("specification"), F.col("x10").alias("unit"), F.regexp_extract("x13", CODE, 1).alias("code"),
        "source_file", F.col("row").cast("bigint").alias("source_row"), F.col("leaf.c").cast("bigint").alias("item_column"), "reference_type", F.when(F.col("reference_type") != "", F.col("below")).otherwise("").alias("reference_text"),
    )


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def merged(found: DataFrame) -> DataFrame:
    """Entries of all files without repetitions, the first in (file, row) order kept, with ``ord``. The catalog is a small
    dimension, so numbering it in one task is enough."""
    kept = first_wins(found, DEDUP, ["doc_id", "source_row"])
    return kept.withColumn("ord", F.row_number().over(Window.orderBy("doc_id", "source_row")).cast("bigint")).select(*ENTRY.names, "ord")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A catalog from its JSON form, version 1 or 2."""
    schema = S.StructType([S.StructField("schema_version", S.LongType()), S.StructField("entries", S.ArrayType(ENTRY))])
    book = spark.read.schema(schema).json(path, multiLine=True)
    version = F.assert_true(F.coalesce(F.col("schema_version").isin(1, 2), F.lit(False)), F.lit("catalog version is not supported"))
    rows = book.withColumn("_ok", version).filter("_ok is null").select(F.posexplode("entries").alias("pos", "e")).select((F.col("pos") + 1).cast("bigint").alias("ord"), "e.*")
    blank = {c: "" for c in (*LEVELS, "item_name", "specification", "unit", "code", "source_file", "reference_type", "reference_text")}
    column = F.least(F.greatest(F.coalesce("item_column", F.lit(4)), F.lit(4)), F.lit(6))
    return rows.fillna(blank).withColumn("item_column", column).select(*ENTRY.names, "ord")


def as_json(found: DataFrame, sources: DataFrame) -> DataFrame:
    """One row with the JSON text of a catalog: ``sources`` has (file_name, sha256, entries)."""
    listed = F.array_sort(F.collect_list(F.struct("ord", *ENTRY.names)))
    body = found.agg(listed.alias("l"), F.count("*").alias("n"))
    body = body.select(F.transform("l", lambda e: F.struct(*(e[c].alias(c) for c in ENTRY.names))).alias("entries"), F.col("n").alias("entry_count"))
    head = sources.agg(F.array_sort(F.collect_list(F.struct("file_name", "sha256", "entries"))).alias("sources"))
    return body.withColumn("_k", F.lit(1)).join(head.withColumn("_k", F.lit(1)), "_k").select(F.to_json(F.struct(F.lit(2).alias("schema_version"), "sources", "entry_count", "entries")).alias("value"))
