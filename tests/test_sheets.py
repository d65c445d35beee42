"""Sheets to records: documented cases, and random sheets against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import sheets
from tabulon.sources.workbooks import CELLS


def cells(spark, grids, doc="d", file="01_file（数量計算書）.xlsx"):
    """grids: list of (sheet, state, {(row, col): value})."""
    rows = []
    for i, (name, state, values) in enumerate(grids):
        deep, wide = max((r for r, _ in values), default=0), max((c for _, c in values), default=0)
        for (r, c), v in values.items():
            text, number = (v, None) if isinstance(v, str) else (None, float(v))
            rows.append((doc, file, i, name, state, deep, wide, r, c, "s" if text is not None else "n", text, number, None))
    return spark.createDataFrame(rows, CELLS)


def grid(*rows, top=3, left=2):
    return {(top + i, left + j): v for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None}


HEAD = ["工種", "種別", "細別", "規格等", "単位", "数量", "備考"]


def records(spark, df):
    return sorted(sheets.records(sheets.prepared(df)).collect(), key=lambda r: (r.doc_id, r.source_sheet, r.source_row))


def test_generic_table(spark):
    df = cells(spark, [("数量総括", "visible", grid(HEAD, ["補修工", "断面修復工", "左官工法", "モルタル", "m3", 1.2], [0, 0, 0, "別規格", "m3", 0.3], [0, 0, 0, "合計", "m3", 1.5]) | {(1, 2): "設計書名: 新橋"})])
    got = records(spark, df)
    assert [(r.work_type, r.category, r.item_name, r.specification, r.quantity, r.extraction_status, r.extraction_confidence) for r in got] == [("補修工", "断面修復工", "左官工法", "モルタル", 1.2, "READY", 0.98), ("補修工", "断面修復工", "左官工法", "別規格", 0.3, "READY", 0.98)]
    ready = sheets.prepared(df)
    assert sheets.project_names(ready, sheets.select_tables(sheets.detect_tables(ready))).first().project == "新橋"


def test_repeated_header_is_skipped(spark):
    body = {(5, c + 1): v for c, v in enumerate(["工種", "種別", "細別", "規格", "単位", "数量"])} | {(6, 1): "橋台工", (7, 2): "旧", (9, 1): "設計数量総括表(下部工)"}
    body |= {(13, c + 1): v for c, v in enumerate(["工種", "種別", "細別", "規格", "単位", "数量"])} | {(14, 2): "作業土工", (15, 3): "床掘り", (15, 4): "土砂,小規模", (15, 5): "m3", (15, 6): 19.1}
    got = records(spark, cells(spark, [("設計数量総括表(下部工)", "visible", body)]))
    assert [(r.section, r.work_type, r.category, r.item_name, r.quantity) for r in got] == [("下部工", "橋台工", "作業土工", "床掘り", 19.1)]


def test_quantity_below_and_legacy_columns(spark):
    body = {(3, c + 1): v for c, v in enumerate(["工種", "種別", "細別", "規格", "単位", "数量"])} | {(4, 1): "A", (4, 3): "型枠", (4, 5): "m2", (5, 6): 12.5, (5, 8): "P.1442"}
    got = records(spark, cells(spark, [("設計数量総括表(上部工)", "visible", body)]))
    assert [(r.item_name, r.quantity, r.source_reference, r.source_row) for r in got] == [("型枠", 12.5, "P.1442", 4)]


def test_blank_row_between_repeats_the_quantity(spark):
    """The row between an item and its quantity looks ahead too: two records, as documented."""
    got = records(spark, cells(spark, [("数量総括", "visible", grid(HEAD, ["w", "c", "i", "s", "m3", None], [None] * 7, [None, None, None, None, None, 5.0]))]))
    assert [(r.source_row, r.quantity) for r in got] == [(4, 5.0), (5, 5.0)]


def test_hidden_and_weak_sheets(spark):
    df = cells(spark, [("a", "hidden", grid(HEAD, ["w", "c", "i", "s", "m3", 1])), ("数量集計", "visible", grid(HEAD, ["w", "c", "i", "s", "m3", 2])), ("数量集計2", "visible", grid(HEAD, ["w", "c", "i", "s", "m3", 3]))])
    tables = sheets.select_tables(sheets.detect_tables(sheets.prepared(df))).collect()
    assert [(t.sheet, t.warnings) for t in tables] == [("数量集計", [sheets.NO_SUMMARY + "数量集計"])]


def test_estimate_month(spark):
    df = cells(spark, [("a", "hidden", {(1, 1): "積算年月", (1, 3): "令和8年6月", (2, 1): "単価年月", (2, 2): "2020/1"})])
    row = sheets.estimate_months(sheets.prepared(df)).first()
    assert (str(row.month), row.month_source) == ("2026-06-01", "SOURCE")
    row = sheets.estimate_months(sheets.prepared(cells(spark, [("a", "visible", {(1, 1): "x"})]))).first()
    assert row.month_source == "PC_DATE"


def plain(rows, section):
    """A plain loop over rows of (section, work, category, item, spec, unit, quantity)."""
    now, used, out = dict.fromkeys("swciu", ""), set(), []
    now["s"] = section
    total = lambda *v: any(x in ("計", "合計") for x in v)
    for k, (s, w, c, i, spec, u, q) in enumerate(rows):
        if k in used or total(s, w, c, i, spec):
            continue
        if s:
            now |= {"s": s, "w": "", "c": "", "i": ""}
        if w:
            now |= {"w": w, "c": "", "i": ""}
        if c:
            now |= {"c": c, "i": ""}
        if i:
            now["i"] = i
        if u:
            now["u"] = u
        found, at = q, k
        if q is None:
            for n in range(k + 1, min(k + 5, len(rows))):
                if any(rows[n][x] for x in (0, 1, 2, 3, 5)):
                    break
                if rows[n][6] is not None:
                    found, at = rows[n][6], n
                    used.add(n)
                    break
        if not any((s, w, c, i, spec, u)) and found is None:
            continue
        item, unit = i or now["i"], u or (now["u"] if spec or found is not None else "")
        if not item or not unit or (found == 0 and not i and not spec):
            continue
        out.append((k, now["s"] or section, now["w"], now["c"], item, spec, unit, found))
    return out


def test_random_sheets(spark):
    rng = random.Random(11)
    frames, want = [], {}
    pick = lambda share, *v: rng.choice(v) if rng.random() < share else ""
    for d in range(60):
        rows = [(pick(0.05, "S1", "S2"), pick(0.1, "W1", "W2", "計"), pick(0.15, "C1", "C2"), pick(0.3, "I1", "I2", "合計"), pick(0.3, "p1", "p2"), pick(0.3, "m", "t"), rng.choice([None, None, 0.0, 1.5, 2.0])) for _ in range(rng.randint(1, 25))]
        values = grid(["費目", *HEAD[:-1]], *[[x if x != "" else None for x in r] for r in rows])
        values[(3 + len(rows), 1)] = "."  # the sheet ends with its last row
        frames.append(cells(spark, [("数量総括", "visible", values)], doc=f"d{d}"))
        want[f"d{d}"] = [(k + 4, *r) for k, *r in plain(rows, "本工事費")]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    got = {d: [] for d in want}
    for r in sorted(sheets.records(sheets.prepared(df)).collect(), key=lambda r: r.source_row):
        got[r.doc_id].append((r.source_row, r.section, r.work_type, r.category, r.item_name, r.specification, r.unit, r.quantity))
    assert got == want


@pytest.mark.parametrize("resets", [True, False])
def test_carry_down_empty(spark, resets):
    df = spark.createDataFrame([], "k int, o int, a string, b string")
    assert sheets.carry_down(df, ["o"], ["k"], ["a", "b"], resets).select("f_a", "f_b").count() == 0
    assert df.select(F.lit(1)).count() == 0
