"""Workbooks, catalogs, conversion, reconciliation and the stream, end to end on small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.operators import catalog as C
from tabulon.operators import layout, reconcile, sheets
from tabulon.plans import convert
from tabulon.sources import files, workbooks
from tabulon.streaming import reviews as stream


def book(path, content):
    path.write_bytes(workbooks.workbook_bytes(content))
    return str(path)


DETAIL = [(4, 1, "本工事費", None), (5, 13, "費目行", None), (8, 2, "舗装", None), (9, 13, "工種行", None), (12, 3, "表層工", None), (13, 13, "種別行", None), (16, 4, "表層", None), (16, 8, None, 100.0), (16, 10, "m2", None), (16, 13, "[CB410260]", None), (17, 4, "密粒度", None), (17, 13, "施工 第 0-189号表", None)]
DEEP = DETAIL + [(20, 4, "細別名", None), (21, 13, "細別行", None), (24, 5, "規格名", None), (25, 13, "規格行", None), (28, 6, "深い", None), (28, 8, None, 2.0), (28, 10, "m", None), (29, 13, "明細 1", None)]


def test_workbook_round_trip(spark, tmp_path):
    path = book(tmp_path / "a.xlsx", {"x": [(2, 3, "あ & <b>", None), (1, 28, None, 1.5)], "y": [(1, 1, None, 7.0)]})
    rows = {(r.sheet, r.row, r.col): (r.vtype, r.str_val, r.num_val, r.max_row, r.max_col) for r in workbooks.workbook_cells(spark, path).collect()}
    assert rows == {("x", 2, 3): ("s", "あ & <b>", None, 2, 28), ("x", 1, 28): ("n", None, 1.5, 2, 28), ("y", 1, 1): ("n", None, 7.0, 1, 1)}


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def unpacked(raw):
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return {n: z.read(n).decode() for n in z.namelist()}


MAIN_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_phonetic_text_is_not_content(spark, tmp_path):
    """Shared and inline strings with reading aids and with formatted runs."""
    parts = unpacked(workbooks.workbook_bytes({"a&b <x>": [(1, 1, "x", None)]}))
    parts["xl/sharedStrings.xml"] = f"""<sst {MAIN_NS}><si><t>工種</t><rPh sb="0" eb="2"><t>コウシュ</t></rPh><phoneticPr fontId="1"/></si>
      <si><r><t>数</t></r><r><rPr><b/></rPr><t xml:space="preserve">量 </t></r><rPh sb="0" eb="1"><t>スウ</t></rPh></si><si/></sst>"""
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>単位</t><rPh sb="0" eb="2"><t>タンイ</t></rPh></is></c><c r="D1" t="s"><v>2</v></c></row>'
    parts["xl/worksheets/sheet1.xml"] = f"<worksheet {MAIN_NS}><sheetData>{rows}</sheetData></worksheet>"
    (tmp_path / "p.xlsx").write_bytes(packed(parts))
    got = [(r.sheet, r.str_val) for r in workbooks.workbook_cells(spark, str(tmp_path / "p.xlsx")).orderBy("col").collect()]
    assert got == [("a&b <x>", "工種"), ("a&b <x>", "数量 "), ("a&b <x>", "単位"), ("a&b <x>", "")]


def test_template_is_edited_in_place():
    parts = unpacked(workbooks.workbook_bytes({n: [(1, 1, "old", None)] for n in ("cover", "main", "rest")}))
    styled = '<row r="2" spans="1:3" ht="30" customHeight="1"><c r="A2" s="4" t="str"><v>gone</v></c><c r="B2" s="5"><v>1</v></c><c r="C2"><f>A2*2</f><v>2</v></c></row><row r="40"><c r="A40" s="9"/></row>'
    sheet = f"""<worksheet {MAIN_NS}><cols><col min="1" max="3" width="17"/></cols><sheetData>{styled}</sheetData><mergeCells count="1"><mergeCell ref="A2:B2"/></mergeCells><pageMargins left="1"/></worksheet>"""
    parts["xl/worksheets/sheet2.xml"] = sheet
    formula = '<c r="B1"><f>main!A2</f><v>9</v></c>'
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace("</row>", formula + "</row>")
    parts["xl/styles.xml"] = f"<styleSheet {MAIN_NS}/>"
    parts["xl/calcChain.xml"] = f"<calcChain {MAIN_NS}/>"
    parts["[Content_Types].xml"] = parts["[Content_Types].xml"].replace("</Types>", '<Override PartName="/xl/calcChain.xml" ContentType="x"/></Types>')
    depth = []
    raw = workbooks.filled_template(packed(parts), [("main", 2, 1, "new <&", None), ("main", 3, 2, None, 5.0), ("cover", 1, 1, "me", None)], ["cover", "main"], "cover", "main", lambda n: depth.append(n) or n)
    got = unpacked(raw)
    assert depth == [40]
    kept = '<row r="2" ht="30" customHeight="1"><c r="A2" s="4" t="inlineStr"><is><t xml:space="preserve">new &lt;&amp;</t></is></c><c r="B2" s="5"><v>1</v></c></row>'
    body = f'<sheetData>{kept}<row r="3"><c r="B3"><v>5</v></c></row><row r="40"><c r="A40" s="9"/></row></sheetData>'
    assert got["xl/worksheets/sheet2.xml"] == sheet.replace(f"<sheetData>{styled}</sheetData>", body)
    assert got["xl/worksheets/sheet3.xml"] == parts["xl/worksheets/sheet3.xml"] and got["xl/styles.xml"] == parts["xl/styles.xml"]
    assert formula in got["xl/worksheets/sheet1.xml"] and "old" not in got["xl/worksheets/sheet1.xml"]
    assert "xl/calcChain.xml" not in got and "calcChain" not in got["[Content_Types].xml"] and 'fullCalcOnLoad="1"' in got["xl/workbook.xml"]


def test_catalog(spark, tmp_path):
    book(tmp_path / "a.xlsx", {C.SHEET: DEEP})
    book(tmp_path / "b.xlsx", {C.SHEET: DETAIL, "other": [(1, 1, "x", None)]})
    found, sources = convert.build_catalog(spark, str(tmp_path))
    rows = found.orderBy("ord").collect()
    assert [(r.level1, r.level2, r.level3, r.level4, r.level5, r.item_name, r.specification, r.code, r.item_column, r.reference_type) for r in rows] == [
        ("本工事費", "舗装", "表層工", "", "", "表層", "密粒度", "CB410260", 4, "施工"), ("本工事費", "舗装", "表層工", "細別名", "規格名", "深い", "", "", 6, "明細"),
    ]
    out = tmp_path / "catalog.json"
    convert.write_catalog(found, sources, str(out))
    body = json.loads(out.read_text())
    assert body["schema_version"] == 2 and body["entry_count"] == 2 and [s["entries"] for s in body["sources"]] == [2, 1]
    again = C.load(spark, str(out))
    assert [r.item_name for r in again.orderBy("ord").collect()] == ["表層", "深い"]
    out.write_text(json.dumps(body | {"schema_version": 3}))
    with pytest.raises(Exception, match="version"):
        C.load(spark, str(out)).count()


def test_convert(spark, tmp_path):
    (tmp_path / "c").mkdir()
    book(tmp_path / "c" / "a.xlsx", {C.SHEET: DETAIL})
    catalog, _ = convert.build_catalog(spark, str(tmp_path / "c"))
    head = [(3, 2 + i, v, None) for i, v in enumerate(["工種", "種別", "細別", "規格", "単位", "数量"])]
    row = [(4, 2 + i, v, None) for i, v in enumerate(["舗装", "表層工", "表層", "密粒度", "m2"])] + [(4, 7, None, 12.0)]
    source = book(tmp_path / "s.xlsx", {"数量総括": [(1, 2, "設計書名: 新橋", None), (1, 5, "積算年月", None), (1, 6, "令和8年6月", None), *head, *row]})
    cells = convert.source_cells(spark, source)
    done = convert.items(cells, catalog).cache()
    r = done.first()
    assert (r.match_status, r.output_code, r.output_level2) == ("CATALOG_EXACT_CODE", "CB410260", "舗装")
    assert convert.write_extraction(sheets.records(cells), str(tmp_path / "x.csv")) == {"records": 1, "status_counts": {"READY": 1}}
    assert convert.batch_summary(done, str(tmp_path / "b.json"))[0]["codes"] == 1
    pages = spark.createDataFrame([("p", 1, "x\n単価年月 R7.4"), ("q", 16, "積算年月 2024/1")], "doc_id string, page int, page_text string")
    months = {r.doc_id: (str(r.month), r.month_source) for r in sheets.estimate_months_of_pages(pages, F.lit("2020-01-01").cast("date")).collect()}
    assert months == {"p": ("2025-04-01", "SOURCE"), "q": ("2020-01-01", "PC_DATE")}
    template = workbooks.workbook_bytes({n: [(40 if n == layout.MAIN else 1, 1, "old", None)] for n in layout.SHEETS})
    out = tmp_path / "out.xlsx"
    assert convert.write_workbook(template, done, convert.covers(cells, done, district="D"), str(out)) == 4
    got = {(x.sheet, x.row, x.col): (x.str_val, x.num_val) for x in workbooks.workbook_cells(spark, str(out)).collect()}
    assert got[layout.COVER, 6, 4] == ("新橋", None) and got[layout.COVER, 20, 15] == ("D", None) and got[layout.COVER, 21, 10] == ("2026-06-01", None)
    assert got[layout.MAIN, 16, 4] == ("表層", None) and got[layout.MAIN, 16, 13] == ("[CB410260]", None) and ("内訳書", 1, 1) not in got
    with pytest.raises(ValueError, match="lacks"):
        convert.write_workbook(workbooks.workbook_bytes({"x": []}), done, convert.covers(cells, done), str(out))
    with pytest.raises(ValueError, match="holds"):
        workbooks.filled_template(template, [(layout.MAIN, 99, 1, "x", None)], layout.SHEETS, layout.COVER, layout.MAIN, lambda n: 40)
    review = tmp_path / "review.csv"
    files.write_csv(files.review(done).drop("doc_id"), str(review))
    assert review.read_bytes().startswith(b"\xef\xbb\xbf")
    back = files.source_review(spark, str(review))
    assert back.columns == files.REVIEW and back.first().output_code == "CB410260" and back.first().quantity == "12"
    with pytest.raises(ValueError):
        convert.source_cells(spark, "x.txt")


def review_frame(spark, rows):
    return spark.createDataFrame([(f"{i:03d}", q, "w.xlsx", 7 + i, n, s, u, "", m) for i, (q, n, s, u, m) in enumerate(rows)], "ord string, queue string, workbook string, row int, name string, specification string, unit string, price string, message string")


def test_reconcile(spark, tmp_path):
    source = spark.createDataFrame([("1", "表層工", "s", "m2", "extra"), ("2", "表層", "t", "m2", ""), ("3", "型枠", "", "", "")], "ord string, item_name string, specification string, unit string, other string")
    rows = review_frame(spark, [("unit", "表層", "t", "m2", "a"), ("unit", "表層", "t", "m2", "b"), ("unit", "表層", "t", "m2", "c"), ("work", "表層", "s", "㎡", "d"), ("work", "なし", "", "", "e")])
    got = {r.item_name or r.review_name: r for r in reconcile.reconcile(source, rows).collect()}
    assert (got["表層"].review_status, got["表層"].review_row, got["表層"].review_message) == ("UNIT_REVIEW", "7 | 9", "a | c")
    assert (got["表層工"].review_status, got["表層工"].review_message, got["表層工"].review_queue, got["表層工"].other) == ("UNIT_AND_WORK_REVIEW", "b | d", "unit | work", "extra")
    assert got["型枠"].review_status == "NOT_IN_REVIEW_EXPORT"
    assert (got["なし"].review_status, got["なし"].other) == ("UNMATCHED_REVIEW_ROW", "")
    counts = convert.reconciliation(source, rows, str(tmp_path / "r.csv"))
    assert counts == {"UNIT_REVIEW": 1, "UNIT_AND_WORK_REVIEW": 1, "NOT_IN_REVIEW_EXPORT": 1, "UNMATCHED_REVIEW_ROW": 1}
    assert json.loads((tmp_path / "r.json").read_text())["status_counts"] == counts
    with pytest.raises(ValueError):
        convert.reconciliation(source.filter(F.lit(False)), rows.filter(F.lit(False)), str(tmp_path / "r.csv"))


def test_review_export(spark, tmp_path):
    path = book(tmp_path / "unit.xlsx", {"設定": [(7, 2, "no", None)], "一覧": [(6, 2, "head", None), (7, 2, "表層", None), (7, 17, "s", None), (7, 32, "m2", None), (7, 50, "単価なし", None), (7, 68, None, 5.0), (8, 17, "blank", None)]})
    rows = reconcile.review_rows(sheets.prepared(workbooks.workbook_cells(spark, path)), "unit").collect()
    assert [(r.workbook, r.row, r.name, r.specification, r.unit, r.price, r.message) for r in rows] == [("unit.xlsx", 7, "表層", "s", "m2", "5", "単価なし")]


def test_recognised(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"file": "a", "text": "x", "lines": [{"text": "x", "words": [{"text": "x", "x": 1, "y": 1, "width": 2, "height": 1}]}]}, {"file": "b", "error": "bad"}]))
    assert files.recognised(spark, str(tmp_path / "o.json")).count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"file": "b", "error": "bad"}))
    with pytest.raises(ValueError):
        files.recognised(spark, str(tmp_path / "p.json"))
    assert files.available_path(str(tmp_path), "o", ".json", "1").endswith("o_1.json")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("queue,workbook,row,name,specification,unit,price,message\nunit,w,7,n,,,,m\nunit,w,8,,,,,\n")
    q = stream.running_counts(stream.arriving(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.queue, r.workbook, r.n) for r in spark.sql("select * from arrived").collect()] == [("unit", "w", 1)]
