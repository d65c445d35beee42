"""Text, number and date functions as column expressions.

Only two things need Python, because Spark has no built-in for them: compatibility normalisation of Unicode
(:func:`nfkc`, :func:`nfkc_all`) and the Ratcliff-Obershelp ratio (:func:`ratio`); both are Arrow UDFs. The others expect text that went through
:func:`clean` once, so that a plan calls Python once for each source column. Blank text is ``""``, never null.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Characters between which white space is dropped.
JAPANESE = "一-龯々ぁ-ゖァ-ヺー"
#: Header labels of each role, in order of preference.
HEADER_ALIASES = {
    "section": ["費目", "費目名"],
    "work_type": ["工種", "工種名"],
    "category": ["種別", "種別名"],
    "item_name": ["細別", "細別名", "細目", "名称", "項目"],
    "specification": ["規格", "規格等", "形状寸法", "仕様"],
    "unit": ["単位"],
    "quantity": ["数量", "設計数量", "合計数量"],
    "remarks": ["備考", "摘要"],
    "standard": ["積算基準", "適用基準", "基準", "適用積算基準"],
    "daily_output": ["日当り施工量", "日施工量", "日当たり施工量"],
    "setting": ["設定", "施工条件", "条件", "設定内容"],
    "notes": ["注記", "注意事項", "特記事項"],
    "source_reference": ["参照", "参照頁", "根拠頁", "出典"],
}
#: Labels of total rows (the last is how a scan reads one of them).
TOTAL_LABELS = ["計", "小計", "合計", "総計", "合計数量", "一三ロ"]
#: Patterns of titles and names.
LEGACY_SUMMARY = r"^設計数量総括表[（(](.+?)[）)]$"
PROJECT_LABEL = r"設計書名\s*[:：]\s*(.+)"
STRUCTURAL_PREFIX = r"^\s*§\s*\d+(?:[.-]\d+)*[.．]?\s*(?:設計)?数量総括表\s*"
STRUCTURAL_NAME = r"^(?:§\s*\d+(?:[.-]\d+)*[.．]?|(?:設計)?数量(?:総括表|計算書)|目次)$"
#: Numbering in front of hierarchy labels, tried in order.
NUMBERING = [r"^\s*[（(]\s*\d+(?:[.-]\d+)*\s*[）)]\s*", r"^\s*(?:§\s*)?\d+(?:[.-]\d+)*[.．、:：)]\s*", r"^\s*\d+\s+(?=\S)"]
#: What the two name keys leave out.
MATCH_DROPPED = r"[\s・･()（）「」【】\[\]‐‑‒–—―-]"
NAME_DROPPED = r"[\s・･()（）「」【】\[\]{}｛｝/／,，.。:：;；‐‑‒–—―ーｰ\-_'\"“”‘’]"
#: Units that stand for each other.
UNIT_WORDS = [("m²", "m2"), ("m³", "m3"), ("㎡", "m2"), ("㎥", "m3"), ("ton", "t")]
UNIT_PAIRS = [("孔", "箇所"), ("掛m2", "m2")]
#: Patterns of a year and a month.
ERA_MONTH = r"(?i)(?:令和|R)\s*(\d{1,2})\s*(?:年|[./-])?\s*(\d{1,2})\s*月?"
WESTERN_MONTH = r"\b(20\d{2})\s*(?:年|[./-])\s*(\d{1,2})\s*月?"
#: Labels beside which the estimate's month stands.
MONTH_LABELS = ["積算年月", "単価適用年月", "歩掛単価適用年月", "歩掛り単価適用年月", "単価年月"]
_U = "(?U)"  # white space and digits as Unicode has them


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility normalisation; null becomes blank."""
    return values.map(lambda v: "" if v is None else v if v.isascii() else unicodedata.normalize("NFKC", v))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(values: pd.Series) -> pd.Series:
    """Compatibility normalisation of arrays; null elements become blank, a null array an empty one."""
    form = lambda v: "" if v is None else v if v.isascii() else unicodedata.normalize("NFKC", v)
    return values.map(lambda a: [] if a is None else [form(v) for v in a])


@F.pandas_udf(DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for a, b in zip(left, right):
        if (a, b) not in known:
            known[a, b] = SequenceMatcher(None, a or "", b or "").ratio()
        out.append(known[a, b])
    return pd.Series(out, dtype="float64")


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _U + r"\s+", " "))


def clean(text: Column) -> Column:
    """Normalised, collapsed and trimmed."""
    return squeeze(nfkc(text))


def label(cleaned: Column) -> Column:
    """Without white space between two Japanese characters."""
    return F.regexp_replace(cleaned, rf"{_U}(?<=[{JAPANESE}])\s+(?=[{JAPANESE}])", "")


def compact(cleaned: Column) -> Column:
    return F.regexp_replace(cleaned, _U + r"\s+", "")


def _rounded(number: Column) -> Column:
    """Finite numbers to 12 places."""
    return F.when(F.abs(number) < float("inf"), F.when(F.abs(number) < 1e3, F.round(number, 12)).otherwise(number))


def quantity(cleaned: Column) -> Column:
    """The number that a text is, or null."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(cleaned, "[, ]", ""), "．", "."), "[−ー]", "-")
    return _rounded(F.when(text.rlike(r"^[-+]?\d+(?:\.\d+)?$"), text.try_cast("double")))


def cell_quantity(kind: Column, number: Column, cleaned: Column) -> Column:
    """The number in a cell: of numeric cells their value, of text the number it is; booleans have none."""
    return F.when(kind == "n", _rounded(number)).when(kind == "s", quantity(cleaned))


def first_quantity(cleaned: Column) -> Column:
    """The number that a text is, else the first number in it; dashes have none."""
    text = F.regexp_replace(F.regexp_replace(cleaned, ",", ""), "．", ".")
    inside = F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0)
    return F.coalesce(quantity(cleaned), F.when(~text.rlike("^[-―ー－–—]+$") & (inside != ""), _rounded(inside.try_cast("double"))))


def scanned_quantity(cleaned: Column) -> Column:
    """The number that a text is, the letter O read as zero if need be."""
    return F.coalesce(quantity(cleaned), quantity(F.translate(cleaned, "Oo", "00")))


def header_key(cleaned: Column) -> Column:
    return F.regexp_replace(F.lower(cleaned), _U + r"[\s・･()（）\[\]【】:：/／]", "")


def header_role(cleaned: Column) -> Column:
    """The role that a header cell names, or blank."""
    pairs = [F.lit(x) for role, names in HEADER_ALIASES.items() for name in names for x in (name, role)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), header_key(cleaned)), F.lit(""))


def cell_text(kind: Column, number: Column, cleaned: Column) -> Column:
    """A cell as a label; a numeric zero is blank (cached formulas of layout cells), the text "0" is not."""
    return F.when((kind == "n") & (number == 0), "").otherwise(label(cleaned))


def hierarchy_label(cleaned: Column) -> Column:
    """Without the first kind of numbering that applies."""
    out = cleaned
    for pattern in reversed(NUMBERING):
        cut = F.regexp_replace(cleaned, _U + pattern, "")
        out = F.when(cut != cleaned, F.btrim(cut)).otherwise(out)
    return out


def _spelled(cleaned: Column) -> Column:
    return F.replace(F.replace(cleaned, F.lit("コンクリ-ト"), F.lit("コンクリート")), F.lit("積込み"), F.lit("積込"))


def match_key(cleaned: Column) -> Column:
    """Key of exact comparison: any trailing 工 is dropped."""
    return F.regexp_replace(F.lower(F.regexp_replace(_spelled(cleaned), _U + MATCH_DROPPED, "")), "工$", "")


def name_key(cleaned: Column) -> Column:
    """Key of catalog names: more punctuation is dropped, a trailing 工 only from more than two characters."""
    key = F.lower(F.regexp_replace(_spelled(cleaned), _U + NAME_DROPPED, ""))
    return F.when(F.length(key) > 2, F.regexp_replace(key, "工$", "")).otherwise(key)


def unit_key(cleaned: Column) -> Column:
    out = F.lower(cleaned)
    for word, short in UNIT_WORDS:
        out = F.replace(out, F.lit(word), F.lit(short))
    return F.replace(out, F.lit(" "), F.lit(""))


def units_compatible(left: Column, right: Column) -> Column:
    """Of unit keys: blank fits all."""
    out = (left == "") | (right == "") | (left == right)
    for a, b in UNIT_PAIRS:
        out = out | ((left == a) & (right == b)) | ((left == b) & (right == a))
    return out


def similarity(left: Column, right: Column, rest: Column) -> Column:
    """Of name keys: 0 if one is blank, 1 if equal, by length if one contains the other, else ``rest``."""
    short = F.when(F.length(left) <= F.length(right), left).otherwise(right)
    long = F.when(F.length(left) <= F.length(right), right).otherwise(left)
    inside = F.greatest(F.lit(0.82), F.lit(0.98) * F.length(short) / F.length(long))
    return F.when((left == "") | (right == ""), 0.0).when(left == right, 1.0).when((F.length(short) >= 3) & F.contains(long, short), inside).otherwise(rest)


def specification_similarity(left: Column, right: Column, rest: Column) -> Column:
    """Of keys normalised twice, as :func:`similarity` is applied to keys here; blanks are told apart before the second time."""
    return F.when((left == "") & (right == ""), 1.0).when((left == "") | (right == ""), 0.25).otherwise(similarity(name_key(left), name_key(right), rest))


def combine_unique(*cleaned: Column) -> Column:
    """Distinct texts in order, without blanks and dashes."""
    kept = F.filter(F.array(*cleaned), lambda x: ~x.isin("", "-", "―"))
    return F.array_join(F.array_distinct(kept), " / ")


def add_warning(warnings: Column, message: str | Column, when: Column) -> Column:
    """``warnings`` with the message behind it, if new."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.array_distinct(F.concat(warnings, F.array(message)))).otherwise(warnings)


def note(*cleaned: Column) -> Column:
    """Texts joined without blanks."""
    return F.array_join(F.filter(F.array(*cleaned), lambda x: x != ""), " / ")


def is_total(*labels: Column) -> Column:
    return F.exists(F.array(*labels), lambda x: F.replace(x, F.lit(" "), F.lit("")).isin(TOTAL_LABELS))


def summary_level(cleaned: Column) -> Column:
    """3 for a summary sheet, 2 for a collection, 1 for a quantity table, else 0."""
    name = F.replace(cleaned, F.lit(" "), F.lit(""))
    return F.when(name.rlike(LEGACY_SUMMARY) | name.contains("数量総括"), 3).when(name.contains("数量集計"), 2).when(name.contains("数量表"), 1).otherwise(0)


def section_of_sheet(cleaned: Column) -> Column:
    found = squeeze(F.regexp_extract(cleaned, LEGACY_SUMMARY, 1))
    return F.when(found != "", found).otherwise(F.lit("本工事費"))


def project_of_file(stem: Column) -> Column:
    name = F.regexp_replace(stem, "[（(]?数量(?:計算書|総括表)[）)]?", "")
    name = F.btrim(F.regexp_replace(name, _U + r"^\d+[\s_\-－]+", ""), F.lit(" _-－"))
    return F.when(name != "", name).otherwise(F.lit("数量計算書変換工事"))


def project_of_title(labelled: Column) -> Column:
    """The project that a title cell names, or blank."""
    named = squeeze(F.regexp_extract(labelled, _U + PROJECT_LABEL, 1))
    legacy = squeeze(F.regexp_extract(labelled, r"^(?:設計)?数量総括表[（(](.+?)[）)]$", 1))
    rest = F.btrim(F.regexp_replace(F.regexp_replace(labelled, _U + STRUCTURAL_PREFIX, ""), _U + r"\s*(?:設計)?数量総括表\s*$", ""))
    found = F.when(named != "", named).when(legacy != "", legacy).when(labelled.contains("数量総括表"), rest).otherwise("")
    return F.when(found.rlike(_U + STRUCTURAL_NAME), "").otherwise(found)


def year_month(cleaned: Column) -> Column:
    """First day of the month that a text names, or null (also for months that don't exist)."""

    def of(pattern: str, plus: int) -> Column:
        year, month = (F.regexp_extract(cleaned, _U + pattern, i).try_cast("int") for i in (1, 2))
        return F.when(month.between(1, 12), F.make_date(year + plus, month, F.lit(1)))

    era = cleaned.rlike(_U + ERA_MONTH)
    return F.when(era, of(ERA_MONTH, 2018)).when(cleaned.rlike(_U + WESTERN_MONTH), of(WESTERN_MONTH, 0))


def iso_date(text: Column) -> Column:
    return F.to_date(F.nullif(F.btrim(text), F.lit("")))


def lines(cleaned_lines: Column) -> Column:
    """Non-blank labels of an array of lines."""
    return F.filter(F.transform(cleaned_lines, lambda x: label(squeeze(x))), lambda x: x != "")


def is_summary_page(cleaned: Column) -> Column:
    return compact(cleaned).rlike("数量総括表|数量集計表")


def is_detail_page(page_lines: Column) -> Column:
    """One of the first six lines is the title of a detailed calculation."""
    return F.exists(F.slice(page_lines, 1, 6), lambda x: compact(x).rlike("数量計算書|詳細計算|計算明細") & ~compact(x).rlike("数量総括表|数量集計表"))


def title_and_scope(page_lines: Column) -> tuple[Column, Column]:
    """(title, scope) of a page: the first of eight lines that names a summary, and what stands before that name."""
    found = F.get(F.filter(F.slice(page_lines, 1, 8), lambda x: compact(x).rlike("数量総括表|数量集計表")), F.lit(0))
    before = F.regexp_replace(compact(found), "(?:数量集計表|数量総括表).*$", "")
    scope = F.regexp_replace(before, _U + r"^[第\d０-９]+[.．、・\s]*", "")
    return F.coalesce(found, F.get(page_lines, F.lit(0)), F.lit("")), F.coalesce(scope, F.lit(""))


def dice(left: Column, right: Column) -> Column:
    """Dice coefficient of two arrays of 0 and 1; 0 if both are empty."""
    both = F.aggregate(F.zip_with(left, right, lambda a, b: F.when((a > 0) & (b > 0), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    ink = lambda c: F.size(F.filter(c, lambda x: x > 0))
    total = ink(left) + ink(right)
    return F.when(total > 0, 2.0 * both / total).otherwise(0.0)


def combine_unique_all(cleaned: Column) -> Column:
    """Distinct non-blank texts of an array in order."""
    return F.array_join(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))), " / ")
