"""Reconciling review exports with the source rows.

Assignment is greedy in export order: each review row takes the best source row of its name that its queue has not taken yet, or, when all
are taken, the best of all. Source rows of different names never compete and queues have separate books, so (queue, name) groups
are independent. They come as sorted partitions, one stream for all groups of a task, which holds the source rows of one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import reachable

FIELDS = ["status", "queue", "workbook", "row", "name", "specification", "unit", "price", "message"]
PREFIX = "review_"


def review_rows(cells: DataFrame, queue: str) -> DataFrame:
    """Review rows of exported lists in prepared cells: the first sheet that isn't the settings, from row 7, fixed columns."""
    sheets = cells.filter(F.col("sheet") != "設定").groupBy("doc_id").agg(F.min("sheet_idx").alias("sheet_idx"))
    value = lambda c: F.coalesce(F.max(F.when(F.col("col") == c, F.col("text"))), F.lit(""))
    rows = cells.join(sheets, ["doc_id", "sheet_idx"], "left_semi").filter("row >= 7 and col <= 68").groupBy("doc_id", "row").agg(
        F.first("source_file").alias("workbook"), *(value(c).alias(n) for n, c in (("name", 2), ("specification", 17), ("unit", 32), ("message", 50), ("price", 68)))
    )
    workbook = F.regexp_extract("workbook", r"[^/\\]*$", 0)
    return rows.filter("name <> '' or message <> ''").select(F.lit(queue).alias("queue"), workbook.alias("workbook"), F.col("row").alias("row"), "name", "specification", "unit", "price", "message", F.concat_ws("#", F.lit(queue), "doc_id", F.lpad(F.col("row").cast("string"), 9, "0")).alias("ord"))


def expected(source: DataFrame) -> DataFrame:
    """Keys of source rows (ord and text columns): the adopted name and condition if there are any, else the raw ones."""
    def first(*names):
        there = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in source.columns]
        return F.coalesce(*there, F.lit(""))

    return source.select(
        F.col("ord").alias("s_ord"), T.match_key(T.clean(first("output_name", "item_name"))).alias("name_key"),
        T.match_key(T.clean(first("output_condition", "specification"))).alias("s_spec"), T.unit_key(T.clean(first("unit"))).alias("s_unit"),
    )


def assign(source: DataFrame, reviews: DataFrame) -> DataFrame:
    """(r_ord, s_ord): the source row of each review row that has one. ``ord`` orders both tables."""
    reachable(source.sparkSession)
    s = expected(source)
    r = reviews.select(F.col("ord").alias("r_ord"), "queue", T.match_key(T.clean(F.col("name"))).alias("name_key"), T.match_key(T.clean(F.col("specification"))).alias("r_spec"), T.unit_key(T.clean(F.col("unit"))).alias("r_unit"))
    groups = r.select("queue", "name_key").distinct()
    # One table of both kinds, sorted so that a group's source rows stand before its review rows; names without a review row don't come.
    left = s.join(groups, "name_key").select("queue", "name_key", F.lit(False).alias("review"), F.col("s_ord").cast("string").alias("ord"), F.col("s_spec").alias("spec"), F.col("s_unit").alias("unit"))
    right = r.select("queue", "name_key", F.lit(True).alias("review"), F.col("r_ord").cast("string").alias("ord"), F.col("r_spec").alias("spec"), F.col("r_unit").alias("unit"))
    both = left.unionByName(right).repartition("queue", "name_key").sortWithinPartitions("queue", "name_key", "review", "ord")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, books = None, None
        for pdf in frames:
            out = []
            for queue, name, review, o, spec, unit in zip(*(pdf[c] for c in ("queue", "name_key", "review", "ord", "spec", "unit"))):
                if (queue, name) != group:
                    group, books = (queue, name), _Books()
                if not review:
                    books.add(o, spec, unit)
                elif (got := books.take(spec, unit)) is not None:
                    out.append((o, got))
            yield pd.DataFrame(out, columns=["r_ord", "s_ord"])

    return both.mapInPandas(run, "r_ord string, s_ord string")


class _Books:
    """Source rows of one queue and name, and which of them are taken.

    The score tells apart only whether the specification (40) and the unit (20) are equal, so the best free row is the first free one of the
    first of these lists that has any: both equal, specification equal, unit equal, all. Heads of lists only move on, so that a
    row is taken in constant time, whatever the number of rows or of specifications."""

    def __init__(self) -> None:
        self.rows: list[str] = []
        self.free: list[bool] = []
        self.lists: dict[tuple, list[int]] = {}
        self.heads: dict[tuple, int] = {}

    @staticmethod
    def keys(spec: str, unit: str) -> tuple[tuple, ...]:
        return (spec, unit), (spec, None), (None, unit), (None, None)

    def add(self, row: str, spec: str, unit: str) -> None:
        for k in self.keys(spec, unit):
            self.lists.setdefault(k, []).append(len(self.rows))
        self.rows.append(row)
        self.free.append(True)

    def take(self, spec: str, unit: str) -> str | None:
        """The best free row, or the best of all where all are taken; None without any row."""
        known = [k for k in self.keys(spec, unit) if k in self.lists]
        for k in known:
            places, head = self.lists[k], self.heads.get(k, 0)
            while head < len(places) and not self.free[places[head]]:
                head += 1
            self.heads[k] = head
            if head < len(places):
                self.free[places[head]] = False
                return self.rows[places[head]]
        return self.rows[self.lists[known[0]][0]] if known else None


def reconcile(source: DataFrame, reviews: DataFrame) -> DataFrame:
    """All source rows with their reviews, then the review rows without a source; columns of ``source`` pass through, unknown ones too.

    ``ord`` must be a unique string in either table."""
    kept = [c for c in source.columns if c != "ord"]
    pairs = assign(source, reviews)
    mine = reviews.withColumns({c: T.clean(F.col(c).cast("string")) for c in ("workbook", "name", "specification", "unit", "price", "message")})
    joined = pairs.join(mine.withColumnRenamed("ord", "r_ord"), "r_ord")
    ordered = F.array_sort(F.collect_list(F.struct("r_ord", "queue", "workbook", F.col("row").cast("string").alias("row"), "name", "specification", "unit", "price", "message")))
    texts = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("_l", lambda x: x[c]), lambda v: v != "")), " | ")
    per = joined.groupBy("s_ord").agg(ordered.alias("_l"), F.array_sort(F.collect_set("queue")).alias("_q"))
    per = per.select("s_ord", F.col("_q"), F.array_join("_q", " | ").alias("queue"), F.array_join(F.transform("_l", lambda x: x["row"]), " | ").alias("row"), *(texts(c).alias(c) for c in ("workbook", "name", "specification", "unit", "price", "message")))
    status = F.when(F.size("_q") == 0, "NOT_IN_REVIEW_EXPORT").when(F.col("queue") == "unit", "UNIT_REVIEW").when(F.col("queue") == "work", "WORK_REVIEW").otherwise("UNIT_AND_WORK_REVIEW")
    per = per.withColumnsRenamed({c: PREFIX + c for c in FIELDS[1:]})
    left = source.withColumn("_s", F.col("ord").cast("string")).join(per, F.col("_s") == per["s_ord"], "left")
    left = left.withColumn("_q", F.coalesce("_q", F.array().cast("array<string>"))).withColumn("queue", F.coalesce(F.col(PREFIX + "queue"), F.lit("")))
    found = left.select(*(F.col(f"`{c}`") for c in kept if c not in [PREFIX + f for f in FIELDS]), status.alias(PREFIX + "status"), *(F.coalesce(PREFIX + c, F.lit("")).alias(PREFIX + c) for c in FIELDS[1:]))
    orphans = mine.join(pairs, mine["ord"] == pairs["r_ord"], "left_anti")
    lone = orphans.select(F.lit("UNMATCHED_REVIEW_ROW").alias(PREFIX + "status"), F.col("queue").alias(PREFIX + "queue"), F.col("workbook").alias(PREFIX + "workbook"), F.col("row").cast("string").alias(PREFIX + "row"), *(F.col(c).alias(PREFIX + c) for c in ("name", "specification", "unit", "price", "message")))
    return found.unionByName(lone, allowMissingColumns=True).fillna("", [c for c, k in found.dtypes if k == "string"])
