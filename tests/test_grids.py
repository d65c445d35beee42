"""Table matrices and scans to records."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import grids as G
from tabulon.operators import scans
from tabulon.functions import text as T

GRID = "doc_id string, page int, page_text string, table_idx int, row int, cells array<string>"
#: A park's lists: kinds of plants and furniture, with a remark column at the end.
PLAIN = ["種別", "規格", "単位", "数量", "摘要"]


def table(spark, *pages):
    rows = [("d", page, text, 0, i, [None if v is None else str(v) for v in row]) for page, text, rows in pages for i, row in enumerate(rows)]
    return spark.createDataFrame(rows, GRID)


def read(spark, *pages):
    return sorted(G.records(table(spark, *pages)).collect(), key=lambda r: (r.source_page, r.source_row, r.source_reference))


def test_total_column(spark):
    head = ["種別", None, "規格", "単位", "数量", None, None, "摘要"]
    sides = [None] * 4 + ["北側", "南側", "合計", None]
    rows = [head, sides, ["芝生", None, "野芝", "m2", "40", "2.5", "42.5", None], ["低木", None, "H0.5", "株", "7", "8", "15", None], [None, "サツキ", None, "株", "3", "4", "1,007", None], ["小計", None, None, "株", "1", "2", "3", None]]
    got = read(spark, (2, "第4. 花壇工 数量集計表", rows))
    assert [(r.work_type, r.item_name, r.specification, r.quantity) for r in got] == [("花壇工", "芝生", "野芝", 42.5), ("花壇工", "低木", "H0.5", 15.0), ("花壇工", "低木", "サツキ", 1007.0)]
    assert {(r.source_sheet, r.extraction_status, r.extraction_confidence) for r in got} == {("第4. 花壇工数量集計表", "PDF_TEXT_REVIEW_REQUIRED", 0.97)}


def test_split_columns(spark):
    rows = [["種別", "規格", "単位", "数量", None, "摘要"], [None, None, None, "東", "西", None], ["縁石", "曲線", "m", "3.25", "6 (7)", "要確認"]]
    got = read(spark, (1, "園路工数量集計表", rows))
    assert [(r.quantity, r.remarks, r.source_reference, r.extraction_confidence) for r in got] == [(3.25, "要確認 / 数量区分: 東", "PDF p.1 (東)", 0.9), (6.0, "要確認 / 数量区分: 西 / 原文数量: 6 (7)", "PDF p.1 (西)", 0.9)]
    assert G.COLUMN_WARNING.format("東") in got[0].extraction_warnings and G.NUMBERS_WARNING in got[1].extraction_warnings


def test_scope_change_resets_category(spark):
    first = [PLAIN, ["広場", None, None, None, None], ["平板", "30角", "m2", "8", None]]
    other = [PLAIN, ["ベンチ", "木製", "基", "2", None]]
    got = read(spark, (1, "広場工数量集計表", first), (2, "休憩所工数量集計表", other))
    assert [(r.work_type, r.category, r.item_name) for r in got] == [("広場工", "広場", "平板"), ("休憩所工", "", "ベンチ")]
    same = read(spark, (1, "広場工数量集計表", first), (2, "広場工数量集計表", other))
    assert [(r.work_type, r.category, r.item_name) for r in same] == [("広場工", "広場", "平板"), ("広場工", "広場", "ベンチ")]
    apart = read(spark, (1, "数量集計表", first), (5, "数量集計表", other))
    assert [(r.work_type, r.category) for r in apart] == [("", "広場"), ("", "")]


def test_inline_specification(spark):
    head = ["工種", "種別", "細目", "単位", "数量", "摘要"]
    rows = [head, ["植栽工", "植樹", "高木", "本", "10", None], [None, None, "支柱付", None, None, None], [None, None, "客土共", None, None, None], [None, None, None, "本", "3", None], [None, "移植", "中木", "本", "約5", None], ["施設工", "遊具", None, "基", "1", None], [None, "合計", None, "基", "7", None]]
    got = read(spark, (1, "数量総括表", rows))
    assert [(r.work_type, r.category, r.item_name, r.specification, r.quantity) for r in got] == [
        ("植栽工", "植樹", "植樹", "高木 / 支柱付 / 客土共", 10.0), ("植栽工", "植樹", "植樹", "客土共", 3.0), ("植栽工", "移植", "移植", "中木", 5.0), ("施設工", "遊具", "遊具", "", 1.0),
    ]
    assert [G.JOINED_WARNING in r.extraction_warnings for r in got] == [True, False, False, False]


def test_names_split_over_two_rows(spark):
    head = ["工種", "種別", "名称", "規格", "単位", "数量", "備考"]
    rows = [head, ["広場", "舗装", "平板\n縁石", "A", "m", "4", None], [None, None, None, "B", "m", "5 (6)", None], [None, None, "砂場と\n安全柵", "C", "基", "1", None], [None, None, "滑り台", "D", "基", "1", None]]
    got = read(spark, (1, "数量総括表", rows))
    assert [(r.category, r.item_name, r.quantity, r.remarks) for r in got] == [("舗装", "平板", 4.0, ""), ("舗装", "縁石", 5.0, "原文数量: 5 (6)"), ("舗装", "砂場と安全柵", 1.0, ""), ("舗装", "滑り台", 1.0, "")]
    assert [G.LINES_WARNING in r.extraction_warnings for r in got] == [False, False, True, False]


def test_item_column_follows_the_work_row(spark):
    """A row that names a work and fills only the first name column makes that the item's column."""
    head = ["工種", "種別", "名称", "単位", "数量"]
    rows = [head, ["園路", "路床", "砕石", "m3", "1"], ["柵", "木柵", None, "m", "2"], [None, "鉄柵", None, "m", "3"], ["水", "配管", "塩ビ管", "m", "4"]]
    got = read(spark, (1, "数量総括表", [[*r[:3], "x", *r[3:]] if i else [*r[:3], "規格", *r[3:]] for i, r in enumerate(rows)]))
    assert [(r.work_type, r.category, r.item_name) for r in got] == [("園路", "路床", "砕石"), ("柵", "", "木柵"), ("柵", "", "鉄柵"), ("水", "配管", "塩ビ管")]


def test_pages(spark):
    rows = [PLAIN, ["藤棚", "", "基", "1", None]]
    wide = [["種別", None, "規格", "単位", "数量", "摘要"], ["水飲み", "", "", "基", "1", None]]
    pages = lambda *p: sorted({r.source_page for r in read(spark, *p)})
    assert pages((1, "目次", rows), (2, "数量総括表", rows), (3, "数量計算書", rows)) == [2]
    assert pages((1, "数量総括表", rows), (2, "続き", rows), (4, "続き", rows)) == [1, 2]
    assert pages((1, "数量総括表", rows), (2, "数量計算書", rows), (3, "数量集計表", rows)) == [1, 3]
    assert pages((1, "数量総括表", rows), (2, "続き", wide), (3, "続き", rows)) == [1]
    assert pages((1, "数量総括表", rows), (2, "数量集計表", wide), (3, "続き", wide), (4, "続き", rows)) == [1, 2, 3]
    assert pages((1, "", rows)) == [] and pages((1, "数量総括表", [["x", "y"], ["1", "2"]])) == []
    assert G.records(table(spark, (1, "数量総括表", rows)).filter(F.lit(False))).count() == 0


def test_odd_grids(spark):
    """Null cells, short rows, an empty row, a null page text, and a column named like an inner one."""
    rows = [PLAIN, ["花壇", None, "m2"], [], [None] * 5, ["球根", "秋植", "球", "9", None]]
    df = table(spark, (1, "数量総括表", rows), (2, None, rows)).withColumn("found", F.lit(1))
    assert [(r.source_page, r.category, r.item_name, r.quantity) for r in sorted(G.records(df).collect(), key=lambda r: r.source_page)] == [(1, "花壇", "球根", 9.0), (2, "花壇", "球根", 9.0)]


def scanned(spark, *pages):
    rows = [("d", page, i, row) for page, rows in pages for i, row in enumerate(rows)]
    df = scans.records(spark.createDataFrame(rows, "doc_id string, page int, row int, cells array<string>"))
    return sorted(df.collect(), key=lambda r: (r.source_page, r.source_row))


def test_scan_seven_columns(spark):
    head = ["工種", "種別", "細別", "規格等", "単位", "数量", "備考"]
    got = scanned(spark, (1, [head, ["施設工", "遊具工", "ブランコ設置", "二連", "基", "3O", ""], ["", "", "", "四連", "", "5", ""], ["", "", "小計", "", "基", "35", ""]]))
    assert [(r.work_type, r.item_name, r.specification, r.unit, r.quantity, r.extraction_status) for r in got] == [("施設工", "ブランコ設置", "二連", "基", 30.0, "OCR_REVIEW_REQUIRED"), ("施設工", "ブランコ設置", "四連", "基", 5.0, "OCR_REVIEW_REQUIRED")]


def test_scan_six_columns_continue_once(spark):
    head = ["工種", "種別", "細目", "単位", "数量", "摘要"]
    got = scanned(spark, (1, [head, ["舎甫装工", "透水層", "開粒度アスコン(13)", "m2", "9", ""], ["", "", "t=4cm", "", "", ""], ["", "", "t=6cm", "", "", ""]]))
    assert [(r.work_type, r.category, r.item_name, r.specification, r.quantity) for r in got] == [("舗装工", "透水層", "透水層", "開粒度アスコン(13) / t=4cm", 9.0), ("舗装工", "透水層", "透水層", "t=6cm", None)]


def continued(rows):
    """Records (row, specification) of rows (kind, specification) by the rule's words: a lone specification goes to the record just above."""
    out, carried = [], False
    for i, (kind, spec) in enumerate(rows, 1):
        if kind == "item":
            carried = True
        if kind == "lone" and out and out[-1][0] == i - 1:
            out[-1][1].append(spec)
        elif kind != "blank" and spec != "計" and carried:
            out.append((i, [spec]))
    return [(i, " / ".join(s)) for i, s in out]


def test_scan_series_of_specifications(spark):
    rng = random.Random(4)
    head = ["工種", "種別", "細別", "規格", "単位", "数量", "備考"]
    pages, want = [], []
    for page in range(1, 30, 2):
        kinds = [(rng.choice(["lone", "lone", "lone", "item", "blank"]), rng.choice(["計", "a", "b", "c"])) for _ in range(14)]
        kinds = [(k, "x" if k == "item" else s if k == "lone" else "") for k, s in kinds]
        cells = {"item": ["", "", "石", "x", "個", "2", ""], "blank": [""] * 7}
        pages.append((page, [head, *(cells.get(k) or ["", "", "", s, "", "", ""] for k, s in kinds)]))
        want += [(page, i + 1, s) for i, s in continued(kinds)]
    assert [(r.source_page, r.source_row, r.specification) for r in scanned(spark, *pages)] == want


def test_scan_five_columns_and_gaps(spark):
    got = scanned(spark, (3, [["外構工", "門扉", "基", "1", ""]]), (4, [["", "フェンス", "m", "2", ""]]), (12, [["", "看板", "枚", "3", ""]]))
    assert [(r.source_page, r.work_type, r.category, r.item_name) for r in got] == [(3, "外構工", "門扉", "門扉"), (4, "外構工", "フェンス", "フェンス"), (12, "", "看板", "看板")]


@pytest.mark.parametrize(("text", "want"), [("断面修復ェ", "断面修復工"), ("削孔 ( 中 30mm )", "削孔 ( Φ30mm )"), ("= 150", "t=150"), ("シーノレ本オ", "シール材"), ("中30m", "Φ30mm")])
def test_repairs(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scans.repaired(T.label(T.clean(F.col("t"))))).first()[0] == want


def test_words(spark):
    words = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 25.0), (4, 99.0)], "id int, x double")
    edges = F.array(*(F.lit(float(v)) for v in (0, 10, 20, 30)))
    assert {r.id: r.column for r in scans.words_to_columns(words, [], "x", edges).collect()} == {1: 0, 2: 0, 3: 2}
    ocr = spark.createDataFrame([("a", "4040404040", [{"text": "", "words": [{"text": "4040404040", "x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}]}]), ("b", "x x x", [{"text": "", "words": [{"text": "x", "x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}] * 3}]), ("c", "ab", [])], "file string, text string, lines array<struct<text:string,words:array<struct<text:string,x:double,y:double,width:double,height:double>>>>")
    assert {r.file: r.x for r in ocr.select("file", scans.decoded(F.col("lines"), T.clean(F.col("text"))).alias("x")).collect()} == {"a": "40", "b": "x", "c": ""}
    first = spark.createDataFrame([("a", ""), ("z", "kept")], "file string, text string")
    assert {r.file: r.text for r in scans.with_repeats(first, ocr).collect()} == {"a": "40", "b": "x", "c": "", "z": "kept"}


@pytest.mark.parametrize(("old", "new", "want"), [("", "x", "x"), ("削孔 30", "削孔 30mm", "削孔 30mm"), ("鋼管 A", "鋼管 A L=5", "鋼管 A L=5"), ("a", "zzzz", "a")])
def test_arbitration(spark, old, new, want):
    df = spark.createDataFrame([("d", 1, 0, 0, old)], "doc_id string, page int, row int, column int, text string")
    other = spark.createDataFrame([("d", 1, 0, 0, new)], "doc_id string, page int, row int, column int, candidate string")
    assert scans.merged_rows(df, other).first().text == want


def test_matrix_and_row_words(spark):
    cells = spark.createDataFrame([("d", 1, "r000_c001.png", "数 量"), ("d", 1, "r001_c000.png", "x")], "doc_id string, page int, file string, text string")
    shapes = spark.createDataFrame([("d", 1, 2, 2)], "doc_id string, page int, rows int, columns int")
    assert [r.cells for r in scans.matrix(cells, shapes).orderBy("row").collect()] == [["", "数量"], ["x", ""]]
    word = {"text": "b", "x": 10.0, "y": 0.0, "width": 2.0, "height": 1.0}
    ocr = spark.createDataFrame([("d", 1, "row-1.png", [{"text": "", "words": [word, word | {"text": "a", "x": 4.0}]}])], "doc_id string, page int, file string, lines array<struct<text:string,words:array<struct<text:string,x:double,y:double,width:double,height:double>>>>")
    moves = spark.createDataFrame([("d", 1, "row-1.png", 100.0, 2.0, [100, 110, 120])], "doc_id string, page int, file string, left double, scale double, vertical array<int>")
    assert [(r.row, r.column, r.candidate) for r in scans.row_candidates(ocr, moves).collect()] == [(1, 0, "a b")]


def test_glyphs(spark):
    rows = [("c1", "m", [1, 1, 0, 0], [1, 1, 0, 0], 1.0), ("c1", "t", [1, 1, 0, 0], [0, 0, 1, 1], 1.0), ("c2", "m", [1, 0, 0, 0], [0, 1, 0, 0], 1.0)]
    df = spark.createDataFrame(rows, "cell string, unit string, ink array<int>, template array<int>, aspect double")
    assert [(r.cell, r.unit) for r in scans.unit_glyphs(df).collect()] == [("c1", "m")]


def test_lines(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "at": [1, 2, 3, 7, 8, 30]}))
    assert sorted(r.line for r in G.line_groups(df, ["k"], "at").collect()) == [2, 8, 30]
    assert sorted(r["at"] for r in G.dense_run(df, ["k"], "at", 2).collect()) == [1, 2, 3]
