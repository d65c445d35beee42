"""Queries of the library over the driver's tables, and the same as DuckDB SQL.

The tables are not quantity sheets; each query builds the operator's input from whole tables and runs the operator on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import classify, grids, layout, matching, reconcile, scans, sheets
from ..session import reachable

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Matching: a catalog of part names, each with and without a specification, and items of line items with parts.


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part").filter("p_name not like 'old %'").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    two = names.select("p_name", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    blank = F.lit("")
    return two.select(
        blank.alias("level1"), F.lit("alpha").alias("level2"), F.lit("beta one").alias("level3"), blank.alias("level4"), blank.alias("level5"), F.col("p_name").alias("item_name"), F.when(F.col("s") == 1, "PROMO").otherwise("").alias("specification"),
        F.when(F.col("k") % 3 == 0, "m2").when(F.col("k") % 3 == 1, "ton").otherwise("").alias("unit"), F.when((F.col("s") == 1) | (F.col("k") % 2 == 0), F.concat(F.lit("CB"), F.lpad((2 * F.col("k") + F.col("s")).cast("string"), 6, "0"))).otherwise("").alias("code"),
        F.lit("part").alias("source_file"), F.col("k").alias("source_row"), F.lit(4).cast("bigint").alias("item_column"), blank.alias("reference_type"), blank.alias("reference_text"), (2 * F.col("k") + F.col("s")).alias("ord"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct kinds of line items with their number: equal items match equally, so they are counted before they are matched."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))
    both = lines.join(_table(spark, sf_dir, "part"), lines["l_partkey"] == F.col("p_partkey"))
    kinds = both.select(
        F.when(F.col("p_size") % 11 == 0, "unlisted").when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" set"))).otherwise(F.col("p_name")).alias("item_name"),
        F.when(F.col("p_type") == "PROMO", "PROMO").otherwise("").alias("specification"), F.when(F.col("l_linestatus") == "O", "m2").otherwise("t").alias("unit"),
        F.when(F.col("l_returnflag") == "N", "alpha").otherwise("").alias("work_type"), F.when(F.col("l_returnflag") == "A", "").otherwise("beta one").alias("category"), "n",
    )
    key = ["item_name", "specification", "unit", "work_type", "category"]
    return kinds.groupBy(*key).agg(F.sum("n").alias("n")).withColumn("ord", F.concat_ws("|", *key))


_MATCH_SQL = """
with cat as (
  select p_name as item_name, case when s = 1 then 'PROMO' else '' end as spec,
    case when k % 3 = 0 then 'm2' when k % 3 = 1 then 't' else '' end as unit,
    case when s = 1 or k % 2 = 0 then 'CB' || lpad((2 * k + s)::varchar, 6, '0') else '' end as code, 2 * k + s as entry_ord
  from (select p_name, min(p_partkey) as k from part where p_name not like 'old %' group by 1), (values (0), (1)) v(s)
), item as (
  select item_name, spec, unit, work, cate, sum(n)::bigint as n from (
    select case when p_size % 11 = 0 then 'unlisted' when p_size % 5 = 0 then p_name || ' set' else p_name end as item_name,
      case when p_type = 'PROMO' then 'PROMO' else '' end as spec, case when l_linestatus = 'O' then 'm2' else 't' end as unit,
      case when l_returnflag = 'N' then 'alpha' else '' end as work, case when l_returnflag = 'A' then '' else 'beta one' end as cate, 1 as n
    from lineitem join part on l_partkey = p_partkey) group by all
), named as (
  select distinct item_name, replace(item_name, ' ', '') as k from item
), known as (
  select distinct replace(item_name, ' ', '') as k from cat
), near as (
  select a.item_name, b.k, case when a.k = b.k then 1.0::double else greatest(0.82::double, 0.98::double * least(length(a.k), length(b.k)) / greatest(length(a.k), length(b.k))) end as name_score, a.k = b.k as exact
  from named a join known b on a.k = b.k or contains(a.k, b.k) or contains(b.k, a.k)
), best as (
  select *, max(name_score) over (partition by item_name) as top, bool_or(exact) over (partition by item_name) as any_exact from near
), pool0 as (
  select i.*, c.spec as c_spec, c.unit as c_unit, c.code, c.entry_ord, b.name_score, b.exact,
    (i.unit = '' or c.unit = '' or i.unit = c.unit) as fits
  from item i join best b on b.item_name = i.item_name and (case when any_exact then exact else name_score >= greatest(0.82::double, top - 0.04::double) end)
  join cat c on replace(c.item_name, ' ', '') = b.k
), pool as (
  select * from (select *, bool_or(fits) over (partition by item_name, spec, unit, work, cate) as any_fits from pool0) where fits or not any_fits
), scored as (
  select *, case when spec = c_spec then 1.0::double when spec = '' or c_spec = '' then 0.25::double end as spec_score,
    case when work = 'alpha' then 0.4::double else 0.0::double end + case when cate = 'beta one' then 0.6::double else 0.0::double end as context,
    case when unit = c_unit then 1.0::double when fits then 0.7::double else 0.0::double end as unit_score from pool
), total as (
  select *, name_score * 0.6::double + unit_score * 0.12::double + spec_score * 0.18::double + context * 0.1::double as score from scored
), ranked as (
  select *, row_number() over w as rank, coalesce(lead(score) over w, 0.0) as runner_up, count(*) over p as candidates, count(distinct nullif(code, '')) over p as codes
  from total window w as (partition by item_name, spec, unit, work, cate order by score desc, entry_ord), p as (partition by item_name, spec, unit, work, cate)
), safe as (
  select *, (work = '' and cate = '') or context >= 0.55 as path from ranked where rank = 1
), done as (
  select *, exact and code <> '' and (codes = 1 or (path and score - runner_up >= 0.12 and spec_score >= 0.78)) and ((spec <> '' and spec_score >= 0.75) or context >= 0.75) as code_safe from safe
), status as (
  select item_name, spec, unit, work, cate, n, case when exact then case when code_safe then 'EXACT_CODE' when path then 'EXACT_PATH' else 'EXACT_AMBIGUOUS' end
    when name_score >= 0.92 and score - runner_up >= 0.08 and path then 'FUZZY_PATH' else 'AMBIGUOUS' end as status, score, candidates, path, code_safe, entry_ord, unit_score from done
  union all
  select i.*, 'NOT_FOUND', null, 0, false, false, null, null from item i where item_name not in (select item_name from near)
)
"""


@query(_MATCH_SQL + """select m as match_status, count(*)::bigint as kinds, sum(n)::bigint as items from (
  select n, case when status in ('EXACT_CODE', 'EXACT_PATH') then case when status = 'EXACT_CODE' then 'CATALOG_EXACT_CODE' else 'NAME_SEARCH' end when status = 'FUZZY_PATH' then 'NAME_SEARCH_REVIEW' else 'NAME_SEARCH_REQUIRED' end as m from status) group by 1""")
def match_status_counts(spark, sf_dir):
    """How many items are coded, searchable or open, after matching and classification."""
    items = _items(spark, sf_dir)
    found = matching.match(items, _catalog(spark, sf_dir)).join(items.select("ord", "n"), "ord")
    found = found.withColumns({"quantity": F.lit(1.0), "extraction_status": F.lit("READY"), "extraction_confidence": F.lit(0.98), "output_code": F.when(F.col("code_safe"), F.col("c_code")).otherwise(""), "catalog_status": F.col("status")})
    return found.withColumn("match_status", classify.status()[0]).groupBy("match_status").agg(F.count("*").alias("kinds"), F.sum("n").alias("items"))


@query(_MATCH_SQL + "select item_name, spec as specification, unit, work as work_type, cate as category, status, round(score, 9) as score, candidates::bigint as candidate_count, path and status <> 'AMBIGUOUS' as path_safe, code_safe from status where status <> 'NOT_FOUND'")
def candidate_rank_margin(spark, sf_dir):
    """The best candidate of each kind of item, with safety gates."""
    items = _items(spark, sf_dir)
    found = matching.match(items, _catalog(spark, sf_dir), digits=9).filter("status <> 'NOT_FOUND'").join(items, "ord")
    return found.select("item_name", "specification", "unit", "work_type", "category", "status", "score", "candidate_count", "path_safe", "code_safe")


@query(_MATCH_SQL + "select item_name, spec as specification, unit, work as work_type, cate as category, count(*)::bigint as pool, count(distinct c_unit)::bigint as units from pool group by all")
def unit_compatible_pool(spark, sf_dir):
    """Candidate pools after narrowing to compatible units."""
    items = _items(spark, sf_dir)
    entries = matching.catalog_keys(_catalog(spark, sf_dir)).withColumnRenamed("ord", "entry_ord").drop("specification")
    pool, _ = matching.candidates(matching.item_keys(items), entries)
    narrowed = matching.scored(pool).groupBy("ord").agg(F.count("*").alias("pool"), F.count_distinct("k_unit").alias("units"))
    return narrowed.join(items, "ord").select("item_name", "specification", "unit", "work_type", "category", "pool", "units")


@query()
def fuzzy_ratio_pool(spark, sf_dir):
    """Catalog names close to misspelt part names, by Ratcliff-Obershelp ratio."""
    part = _table(spark, sf_dir, "part")
    names = part.select(F.translate(F.concat_ws("", F.split("p_name", " ")), "aeiou", "eaiuo").alias("i_item_name")).distinct()
    entries = part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("k_item_name"))
    found = matching.fuzzy_pool(names, entries)
    return found.select("i_item_name", F.round("best", 9).alias("best"), F.array_join(F.array_sort(F.transform("near", lambda x: x["name"])), ",").alias("near"))


@query("""select p_partkey, replace(lower(p_name), ' ', '') as name_key, replace(lower(p_type), ' ', '') as type_key, replace(lower(p_brand), ' ', '') as match_key, case p_size % 4 when 0 then 'm2' when 1 then 't' when 2 then 'm3' else 'kg/m2' end as unit_key,
  case p_size % 4 when 0 then true when 1 then p_size % 3 = 0 when 2 then p_size % 3 = 0 else p_size % 3 = 0 end as compatible from part""")
def name_and_unit_keys(spark, sf_dir):
    """Comparison keys of names and units."""
    part = _table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*(F.lit(x) for x in ("㎡", "Ton", "m³", "kg / m²"))), F.col("p_size") % 4 + 1)
    part = part.withColumn("_u", T.unit_key(T.clean(unit)))
    other = F.when(F.col("p_size") % 3 == 0, "").otherwise("m2")
    return part.select("p_partkey", T.name_key(T.clean(F.col("p_name"))).alias("name_key"), T.name_key(T.clean(F.col("p_type"))).alias("type_key"), T.match_key(T.clean(F.col("p_brand"))).alias("match_key"), F.col("_u").alias("unit_key"), T.units_compatible(F.col("_u"), other).alias("compatible"))


@query()
def document_text_keys(spark, sf_dir):
    """Normalised text of every document, as digests of its cleaned, labelled and keyed forms."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("c"))
    return docs.select("doc_id", F.sha2("c", 256).alias("cleaned"), F.sha2(T.label(F.col("c")), 256).alias("labelled"), F.sha2(T.match_key(F.col("c")), 256).alias("match_key"), F.sha2(T.name_key(F.col("c")), 256).alias("name_key"))


@query("""with e as (
  select user_id, event_id, ts, case when event_type = 'signup' then 's' || event_id else '' end as section, case when event_type = 'error' then 'w' || event_id else '' end as work_type,
    case when event_type = 'click' then 'c' || event_id else '' end as category, case when event_type = 'purchase' then 'i' || event_id else '' end as item_name from events
), g as (
  select *, count(nullif(section, '')) over w as gs, count(nullif(section || work_type, '')) over w as gw, count(nullif(section || work_type || category, '')) over w as gc
  from e window w as (partition by user_id order by ts, event_id rows unbounded preceding)
)
select user_id, event_id, coalesce(last_value(nullif(section, '') ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), '') as f_section,
  coalesce(last_value(nullif(work_type, '') ignore nulls) over (partition by user_id, gs order by ts, event_id rows unbounded preceding), '') as f_work_type,
  coalesce(last_value(nullif(category, '') ignore nulls) over (partition by user_id, gw order by ts, event_id rows unbounded preceding), '') as f_category,
  coalesce(last_value(nullif(item_name, '') ignore nulls) over (partition by user_id, gc order by ts, event_id rows unbounded preceding), '') as f_item_name from g""")
def hierarchy_ffill_reset(spark, sf_dir):
    """Levels carried down with resets, over each user's events."""
    kinds = {"section": "signup", "work_type": "error", "category": "click", "item_name": "purchase"}
    e = _table(spark, sf_dir, "events").withColumns({c: F.when(F.col("event_type") == k, F.concat(F.lit(c[0]), "event_id")).otherwise("") for c, k in kinds.items()})
    return sheets.carry_down(e, ["ts", "event_id"], ["user_id"], list(kinds)).select("user_id", "event_id", *(f"f_{c}" for c in kinds))


_LOOK = """with e as (select user_id, event_id, ts, event_type, case when event_type in ('purchase', 'view') then value end as q, event_type in ('signup', 'error') as stop from events),
l as (select *, lead(q, 1) over w as q1, lead(q, 2) over w as q2, lead(q, 3) over w as q3, lead(q, 4) over w as q4,
  coalesce(lead(stop, 1) over w, true) as s1, coalesce(lead(stop, 2) over w, true) as s2, coalesce(lead(stop, 3) over w, true) as s3, coalesce(lead(stop, 4) over w, true) as s4
  from e window w as (partition by user_id order by ts, event_id)),
d as (select *, case when q is not null then 0 when s1 then 0 when q1 is not null then 1 when s2 then 0 when q2 is not null then 2 when s3 then 0 when q3 is not null then 3 when s4 then 0 when q4 is not null then 4 else 0 end as distance from l),
f as (select *, case distance when 0 then q when 1 then q1 when 2 then q2 when 3 then q3 else q4 end as found, event_type <> 'click' or event_id % 2 = 0 as live from d)
"""


@query(_LOOK + """select user_id, event_id, found, distance::int as distance, coalesce(lag(distance, 1) over w = 1 and lag(live, 1) over w, false) or coalesce(lag(distance, 2) over w = 2 and lag(live, 2) over w, false)
  or coalesce(lag(distance, 3) over w = 3 and lag(live, 3) over w, false) or coalesce(lag(distance, 4) over w = 4 and lag(live, 4) over w, false) as consumed from f window w as (partition by user_id order by ts, event_id)""")
def lookahead_consumed(spark, sf_dir):
    """Quantities found up to four rows below, and the rows that gave theirs away."""
    e = _table(spark, sf_dir, "events").withColumn("q", F.when(F.col("event_type").isin("purchase", "view"), F.col("value")))
    found = sheets.look_ahead(e, ["ts", "event_id"], ["user_id"], "q", F.col("event_type").isin("signup", "error"))
    found = sheets.consumed(found, ["ts", "event_id"], ["user_id"], (F.col("event_type") != "click") | (F.col("event_id") % 2 == 0))
    return found.select("user_id", "event_id", "found", "distance", "consumed")


_HEADS = ["費目", "工種", "種別", "細別", "規格", "単位", "数量", "備考", "基準", "設定", "注記", "参照", "x", "工　種"]


def _sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of sheets whose header words come from parts: 25 rows of a sheet for each brand and size class."""
    word = F.element_at(F.array(*(F.lit(w) for w in _HEADS)), ((F.col("p_partkey") * 7 + F.col("p_size")) % 14 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(
        F.col("p_type").alias("doc_id"), F.col("p_type").alias("source_file"), (F.col("p_size") % 4).alias("sheet_idx"), F.when(F.col("p_size") % 4 == 1, "数量集計").when((F.col("p_size") % 4 == 2) & (F.col("p_type") < "M"), "数量総括").otherwise("表").alias("sheet"),
        F.when(F.col("p_size") % 4 == 3, "hidden").otherwise("visible").alias("state"), F.lit(25).alias("max_row"), F.lit(40).alias("max_col"), (F.col("p_partkey") % 3 + 1).cast("int").alias("row"), (F.floor(F.col("p_partkey") / 3) % 45 + 1).cast("int").alias("col"),
        F.lit("s").alias("vtype"), word.alias("str_val"), F.lit(None).cast("double").alias("num_val"), F.lit(None).cast("timestamp").alias("ts_val"),
    )


@query("""with c as (select p_type as doc_id, p_size % 4 as sheet_idx, p_partkey % 3 + 1 as r, (p_partkey // 3) % 45 + 1 as c, (p_partkey * 7 + p_size) % 14 as w,
  case when p_size % 4 = 1 then 2 when p_size % 4 = 2 and p_type < 'M' then 3 else 0 end as level from part where p_size % 4 <> 3),
n as (select doc_id, sheet_idx, level, r, case when w = 13 then 1 else w end as w, min(c) as c from c where c <= 40 and w <> 12 group by all),
h as (select doc_id, sheet_idx, level, r, count(*) as roles, count(*) filter (w <= 2) as ranks, min(c) filter (w = 3) as c_item_name, min(c) filter (w = 5) as c_unit, min(c) filter (w = 6) as c_quantity from n group by all),
s as (select *, 10 * roles + 5 * ranks + 30 * level as score from h where c_item_name is not null and c_unit is not null and c_quantity is not null and ranks > 0),
b as (select * from (select *, row_number() over (partition by doc_id, sheet_idx order by score desc, r) as k from s) where k = 1),
t as (select *, max(level) over (partition by doc_id) as top, row_number() over (partition by doc_id order by score desc, sheet_idx) as pick from b)
select doc_id, sheet_idx::int as sheet_idx, r::int as header_row, score::int as score, c_item_name::int as c_item_name, c_unit::int as c_unit, c_quantity::int as c_quantity, case when top >= 3 then level = top else pick = 1 end as selected from t""")
def header_role_argmax(spark, sf_dir):
    """The header row of each sheet, and the tables that a document's selection takes."""
    tables = sheets.detect_tables(sheets.prepared(_sheet_cells(spark, sf_dir)))
    chosen = sheets.select_tables(tables).select("doc_id", "sheet_idx", F.lit(True).alias("selected"))
    both = tables.join(chosen, ["doc_id", "sheet_idx"], "left")
    return both.select("doc_id", "sheet_idx", "header_row", "score", "c_item_name", "c_unit", "c_quantity", F.coalesce("selected", F.lit(False)).alias("selected"))


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, u.label, u.quantity from (
  select *, case when l_tax > 0 then [{'label': '合計', 'quantity': l_tax}] else [{'label': 'A1', 'quantity': l_extendedprice}] || case when l_discount > 0 then [{'label': 'A2', 'quantity': l_discount}] else [] end end as us from lineitem), unnest(us) as t(u)""")
def total_preferred_unpivot(spark, sf_dir):
    """Several quantity columns as rows: the total alone where there is one."""
    lines = _table(spark, sf_dir, "lineitem").withColumns({"_t": F.when(F.col("l_tax") > 0, F.col("l_tax")), "_d": F.when(F.col("l_discount") > 0, F.col("l_discount"))})
    return grids.unpivot_quantities(lines, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"A1": "l_extendedprice", "A2": "_d", "合計": "_t"})


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_returnflag <> 'R' and not (l_linestatus = 'O' and l_discount = 0)""")
def drop_total_rows(spark, sf_dir):
    """Rows without total rows and without zeros below inherited labels."""
    lines = _table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "小 計").otherwise(F.col("l_returnflag"))
    artefact = (F.col("l_discount") == 0) & (F.col("l_linestatus") == "O")
    return lines.filter(~T.is_total(label, F.col("l_linestatus")) & ~artefact).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("""with i as (select o_orderkey, o_orderpriority as work, o_orderstatus as sheet, o_custkey % 97 = 0 as safe, 'p' || (o_custkey % 2) as level2, case when o_custkey % 3 = 0 then 'NOT_FOUND' else 'EXACT_PATH' end as status, c_mktsegment as section, n_name as cate
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
g as (select sheet, section, work, cate, min(level2) as only from i where safe group by all having count(distinct level2) = 1)
select o_orderkey, level2 as output_level2, case when g.only is not null and not safe and status = 'NOT_FOUND' then 'NOT_FOUND_GROUP_PATH' else status end as catalog_status from i left join g using (sheet, section, work, cate)""")
def group_path(spark, sf_dir):
    """Statuses of items whose group has one confirmed path."""
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_custkey") % 3 == 0, "NOT_FOUND").otherwise("EXACT_PATH")
    o = o.select("o_orderkey", F.lit("all").alias("doc_id"), F.col("o_orderstatus").alias("source_sheet"), F.col("c_mktsegment").alias("_section"), F.col("o_orderpriority").alias("_work_type"), F.col("n_name").alias("_category"), (F.col("o_custkey") % 97 == 0).alias("path_safe"), F.concat(F.lit("p"), F.col("o_custkey") % 2).alias("output_level2"), F.lit("x").alias("output_level3"), status.alias("status"))
    return matching.group_paths(o).select("o_orderkey", "output_level2", "catalog_status")


@query("select min(doc_id) as doc_id, count(*)::bigint as n from documents group by text")
def dedup_first_wins(spark, sf_dir):
    """The first document of each text, with the number of its copies."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("\u0000")), 256).alias("key"))
    copies = docs.groupBy("key").agg(F.count("*").alias("n"))
    return C.first_wins(docs, ["key"], ["doc_id"]).join(copies, "key").select("doc_id", "n")


@query("""with f as (select conv_id, role, min(turn) as t, count(*) as n from conversations group by 1, 2)
select conv_id, string_agg(role, ' / ' order by t) as roles, sum(n)::bigint as turns from f where role not in ('', '-') group by 1""")
def ordered_distinct_concat(spark, sf_dir):
    """Speakers of each conversation in order of appearance."""
    turns = _table(spark, sf_dir, "conversations").filter("role not in ('', '-')")
    # Speakers are counted before they are listed, so that a long conversation stays small.
    first = turns.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"), F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    listed = first.groupBy("conv_id").agg(F.concat(listed, F.array(F.lit(""), F.get(listed, F.lit(0)))).alias("listed"), F.sum("n").alias("turns"))
    return listed.select("conv_id", T.combine_unique_all(F.col("listed")).alias("roles"), "turns")


@query("""with h as (select source, sum((contains(text, 'thing'))::int) as a, sum((contains(text, 'ung') or contains(text, 'keit'))::int) as b, sum((contains(text, 'que'))::int) as c from documents group by 1),
s as (select source, a + case when contains(source, '1') then 3 else 0 end as a, b, c + case when contains(source, '2') then 3 else 0 end as c from h)
select source as doc_id, case when greatest(a, b, c) < 2 then '' when a = greatest(a, b, c) then 'english' when b = greatest(a, b, c) then 'german' else 'romance' end as work_category from s""")
def work_category_vote(spark, sf_dir):
    """The category of most keyword hits for each source."""
    docs = _table(spark, sf_dir, "documents")
    items = docs.select(F.col("source").alias("doc_id"), F.lit("").alias("work_type"), F.lit("").alias("category"), F.col("text").alias("item_name"), F.lit("").alias("specification"))
    projects = docs.select(F.col("source").alias("doc_id")).distinct().withColumn("project", F.regexp_replace(F.regexp_replace("doc_id", "1", "thing"), "2", "que"))
    return classify.work_categories(items, projects, {"english": ["thing"], "german": ["ung", "keit"], "romance": ["que"]})


_BLOCKS = """with i as (select r_name, c_custkey, n_name as l1, c_mktsegment as l2, case when c_custkey % 3 = 0 then 'x' else 'y' end as l3, case when c_acctbal > 5000 then 'rich' else '' end as l4,
  case when c_acctbal > 2000 then 'g' || (c_custkey % 2) else '' end as l5, c_name as name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
p as (select *, lag(l1) over w as p1, lag(l2) over w as p2, lag(l3) over w as p3, lag(l4) over w as p4, lag(l5) over w as p5, row_number() over w = 1 as first from i window w as (partition by r_name order by l1, c_custkey)),
c as (select *, first or l1 <> p1 as c1, first or l1 <> p1 or l2 <> p2 as c2, first or l1 <> p1 or l2 <> p2 or l3 <> p3 as c3 from p),
d as (select *, l4 <> '' and (c3 or l4 <> p4) as c4 from c), e as (select *, l5 <> '' and (c3 or l4 = '' or l4 <> p4 or l5 <> p5) as c5 from d),
u as (select r_name, l1, c_custkey, 0 as pos, 'fee' as level, l1 as value from e where c1 union all select r_name, l1, c_custkey, 1, 'work', l2 from e where c2 union all select r_name, l1, c_custkey, 2, 'category', l3 from e where c3
  union all select r_name, l1, c_custkey, 3, 'subcategory', l4 from e where c4 union all select r_name, l1, c_custkey, 4, 'specification_group', l5 from e where c5 union all select r_name, l1, c_custkey, 5, 'item', name from e),
b as (select *, row_number() over (partition by r_name order by l1, c_custkey, pos) - 1 as block from u)
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    i = c.select("r_name", "c_custkey", F.col("n_name").alias("l1"), F.col("c_mktsegment").alias("l2"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise("y").alias("l3"), F.when(F.col("c_acctbal") > 5000, "rich").otherwise("").alias("l4"), F.when(F.col("c_acctbal") > 2000, F.concat(F.lit("g"), F.col("c_custkey") % 2)).otherwise("").alias("l5"), F.col("c_name").alias("name"))
    order = ["l1", "c_custkey"]
    return layout.numbered(layout.blocks(i, ["r_name"], order), ["r_name"], order)


@query(_BLOCKS + "select r_name, c_custkey, level, value, block::int as block from b")
def output_blocks(spark, sf_dir):
    """Header and item blocks of a grouped list."""
    return _blocks(spark, sf_dir).select("r_name", "c_custkey", "level", "value", F.col("block").cast("int").alias("block"))


@query(_BLOCKS + "select r_name, (block // 9)::int as page, (block % 9)::int as slot, (1 + (block // 9) * 40 + 3 + (block % 9) * 4)::int as top, level, value from b")
def block_layout(spark, sf_dir):
    """Blocks on the pages of a workbook."""
    return _blocks(spark, sf_dir).select("r_name", "page", F.col("slot").cast("int").alias("slot"), F.col("top").cast("int").alias("top"), "level", "value")


def _sides(spark: SparkSession, sf_dir: str, one_class: bool) -> tuple[DataFrame, DataFrame]:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    spec = (lambda c: F.lit("s")) if one_class else F.col
    source = _table(spark, sf_dir, "orders").select(pad("o_orderkey").alias("ord"), F.concat(F.lit("u"), "o_custkey").alias("item_name"), spec("o_orderstatus").alias("specification"), F.lit("kg").alias("unit"))
    spec = F.lit("s") if one_class else F.when(F.col("event_type") == "view", "F").otherwise("O")
    reviews = _table(spark, sf_dir, "events").select(pad("event_id").alias("ord"), F.when(F.col("event_type") == "error", "unit").otherwise("work").alias("queue"), F.lit("w").alias("workbook"), F.col("event_id").alias("row"), F.concat(F.lit("u"), "user_id").alias("name"), spec.alias("specification"), F.lit("kg").alias("unit"), F.lit("").alias("price"), F.col("event_type").alias("message"))
    return source, reviews


_GREEDY = """with recursive s as (
  select lpad(o_orderkey::varchar, 12, '0') as ord, o_custkey as name, o_orderstatus as spec, row_number() over (partition by o_custkey order by o_orderkey) as place from orders
), r as (
  select lpad(event_id::varchar, 12, '0') as ord, case when event_type = 'error' then 'unit' else 'work' end as queue, user_id as name, case when event_type = 'view' then 'F' else 'O' end as spec,
    row_number() over (partition by event_type = 'error', user_id order by event_id) as k from events
), g as (
  select distinct queue, name, 0::bigint as k, []::varchar[] as taken, null::varchar as r_ord, null::varchar as s_ord from r
  union all
  select queue, name, k, case when list_contains(taken, pick) then taken else list_append(taken, pick) end, r_ord, pick from (
    select g.queue, g.name, r.k, any_value(g.taken) as taken, r.ord as r_ord, arg_min(s.ord, (list_contains(g.taken, s.ord)::bigint * 2 + (s.spec <> r.spec)::bigint) * 1000000 + s.place) as pick
    from g join r on r.queue = g.queue and r.name = g.name and r.k = g.k + 1 join s on s.name = g.name group by g.queue, g.name, r.k, r.ord)
)
select r_ord, s_ord from g where r_ord is not null"""


@query(_GREEDY)
def reconcile_greedy(spark, sf_dir):
    """Source row of each review row, best score first."""
    return reconcile.assign(*_sides(spark, sf_dir, one_class=False))


@query("""with s as (select o_orderkey, 'u' || o_custkey as name, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as n, min(o_orderkey) over (partition by o_custkey) as first from orders),
r as (select event_id, case when event_type = 'error' then 'unit' else 'work' end as queue, 'u' || user_id as name, event_type, row_number() over (partition by event_type = 'error', user_id order by event_id) as k from events),
m as (select r.*, s.o_orderkey from r join s on r.name = s.name and (case when r.k <= s.n then r.k = s.k else s.k = 1 end)),
p as (select o_orderkey, string_agg(event_id::varchar, ' | ' order by event_id) as rows_, count(distinct queue) as qs, min(queue) as q from m group by 1)
select s.name as item_name, case when p.qs is null then 'NOT_IN_REVIEW_EXPORT' when p.qs = 2 then 'UNIT_AND_WORK_REVIEW' when q = 'unit' then 'UNIT_REVIEW' else 'WORK_REVIEW' end as review_status, coalesce(rows_, '') as review_row from s left join p on s.o_orderkey = p.o_orderkey
union all select '', 'UNMATCHED_REVIEW_ROW', event_id::varchar from r where event_id not in (select event_id from m)""")
def reconcile_full_outer(spark, sf_dir):
    """All source rows with their reviews, and reviews without a source."""
    return reconcile.reconcile(*_sides(spark, sf_dir, one_class=True)).select("item_name", "review_status", "review_row")


_PAGES = "select page_id, regexp_extract(url, '^[^/]*//[^/]*\\.([a-z]+)/', 1) as tld, starts_with(url, 'https') as geometry, contains(url, '.html') as anchor, contains(url, '?') as strong, contains(url, '#') as detail from pages"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^[^/]*//[^/]*\.([a-z]+)/", 1).alias("tld"), url.startswith("https").alias("geometry"), url.contains(".html").alias("anchor"), url.contains("?").alias("strong"), url.contains("#").alias("detail"))


@query(f"""with p as ({_PAGES}), e as (select * from p where anchor or (strong and not detail)),
n as (select *, case when page_id - lag(page_id) over w = 1 and geometry = lag(geometry) over w then 0 else 1 end as new from e window w as (partition by tld order by page_id)),
i as (select *, sum(new) over (partition by tld order by page_id rows unbounded preceding)::bigint as island from n)
select page_id, tld, island from (select *, bool_or(anchor) over (partition by tld, island) as has from i) where has""")
def page_islands(spark, sf_dir):
    """Pages of runs that hold an anchor."""
    return grids.page_islands(_pages(spark, sf_dir), ["tld"], "page_id", "geometry", "anchor", "strong", "detail").select("page_id", "tld", "island")


@query(f"""with p as ({_PAGES}), n as (select *, page_id - row_number() over (partition by tld order by page_id) as run from p) select tld, round_even(avg(page_id), 0)::int as line from n group by tld, run""")
def line_groups(spark, sf_dir):
    """Rounded means of runs of consecutive positions."""
    return grids.line_groups(_pages(spark, sf_dir), ["tld"], "page_id")


@query(f"""with p as ({_PAGES}), n as (select *, case when page_id - lag(page_id) over w <= 4 then 0 else 1 end as new from p window w as (partition by tld order by page_id)),
r as (select *, sum(new) over (partition by tld order by page_id rows unbounded preceding) as run from n), s as (select *, count(*) over (partition by tld, run) as size from r)
select tld, page_id from (select *, dense_rank() over (partition by tld order by size desc, run) as k from s) where k = 1""")
def dense_run(spark, sf_dir):
    """The longest run of lines with small gaps."""
    return grids.dense_run(_pages(spark, sf_dir), ["tld"], "page_id", 4).select("tld", "page_id")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_quantity <= 10 then 0 when l_quantity <= 25 then 1 else 2 end::int as column from lineitem where l_quantity between 1 and 40".replace("as column", 'as "column"'))
def range_bucket(spark, sf_dir):
    """Positions in intervals, the first one on a shared edge."""
    edges = F.array(*(F.lit(float(x)) for x in (1, 10, 25, 40)))
    return scans.words_to_columns(_table(spark, sf_dir, "lineitem"), [], "l_quantity", edges).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "column")


@query("""select o_orderkey, case o_orderstatus when 'F' then make_date(2018 + (year(o_orderdate) % 100) % 30, month(o_orderdate), 1) when 'O' then make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), 1) end as month from orders""")
def estimate_month(spark, sf_dir):
    """First day of months written in the era's or the western way."""
    o, y, m = _table(spark, sf_dir, "orders"), F.year("o_orderdate") % 100, F.month("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("令和"), y % 30, F.lit("年"), m, F.lit("月"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("20"), F.lpad(y.cast("string"), 2, "0"), F.lit("/"), m)).otherwise(F.lit("none 13"))
    return o.select("o_orderkey", T.year_month(T.clean(text)).alias("month"))


@query("""with s as (select l_returnflag as doc_id, case when l_quantity <= 5 then 'INVALID_QUANTITY' when l_linestatus = 'O' and l_tax > 0.06 then 'SOURCE_REVIEW_REQUIRED' when l_discount > 0.08 then 'CATALOG_EXACT_CODE' when l_discount > 0.04 then 'NAME_SEARCH' when l_discount > 0.02 then 'NAME_SEARCH_REVIEW' when l_discount > 0.01 then 'NAME_SEARCH_GROUP' else 'NAME_SEARCH_REQUIRED' end as m, l_discount from lineitem)
select doc_id, count(*)::bigint as source_items, count(*) filter (m in ('INVALID_QUANTITY', 'SOURCE_REVIEW_REQUIRED'))::bigint as review_required, count(*) filter (l_discount > 0.02)::bigint as matched, count(*) filter (l_discount > 0.08)::bigint as codes, count(distinct m)::bigint as statuses from s group by 1""")
def status_rollup(spark, sf_dir):
    """Counts of a run by document."""
    d = F.col("l_discount")
    status = F.when(d > 0.08, "EXACT_CODE").when(d > 0.04, "EXACT_PATH").when(d > 0.02, "FUZZY_PATH").when(d > 0.01, "AMBIGUOUS_GROUP_PATH").otherwise("NOT_FOUND")
    i = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("doc_id"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0.0).alias("quantity"), F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.06), "PDF_TEXT_REVIEW_REQUIRED").otherwise("READY").alias("extraction_status"), F.lit(0.9).alias("extraction_confidence"), status.alias("catalog_status"), F.when(d > 0.08, "CB1").otherwise("").alias("output_code"), (d > 0.08).alias("code_safe"), F.array().cast("array<string>").alias("extraction_warnings"))
    done = classify.classify(i)
    return classify.summary(done).join(done.groupBy("doc_id").agg(F.count_distinct("match_status").alias("statuses")), "doc_id")


def _event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary sheet for each user: a header, and a row for each event, labels and quantities by kind of event."""
    e = _table(spark, sf_dir, "events")
    row = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + 3
    kind, text = F.col("event_type"), lambda k, p: F.when(F.col("event_type") == k, F.concat(F.lit(p), F.col("event_id") % 7))
    number = F.when(kind.isin("purchase", "view"), F.col("value"))
    cell = lambda c, s, n=F.lit(None).cast("double"): F.struct(F.lit(c).alias("col"), s.cast("string").alias("str_val"), n.alias("num_val"))
    none = F.lit(None)
    own = F.array(cell(1, text("signup", "W")), cell(2, text("error", "C")), cell(3, F.coalesce(text("click", "I"), F.when((kind == "view") & (F.col("event_id") % 11 == 0), "合計"))), cell(4, text("purchase", "s")), cell(5, F.when(F.col("event_id") % 2 == 0, "m2")), cell(6, none, number))
    body = e.withColumn("row", row).select("user_id", "row", F.inline(own))
    heads = F.array(*(cell(i, F.lit(h)) for i, h in enumerate(["工種", "種別", "細別", "規格", "単位", "数量"], 1)))
    head = e.select("user_id").distinct().select("user_id", F.lit(3).alias("row"), F.inline(heads))
    rows = body.unionByName(head).filter("str_val is not null or num_val is not null")
    deep = F.max("row").over(Window.partitionBy("user_id"))
    doc = F.col("user_id").cast("string")
    return rows.withColumn("max_row", deep).select(
        doc.alias("doc_id"), doc.alias("source_file"), F.lit(0).alias("sheet_idx"), F.lit("数量総括").alias("sheet"), F.lit("visible").alias("state"), "max_row", F.lit(6).alias("max_col"), "row", "col",
        F.when(F.col("num_val").isNotNull(), "n").otherwise("s").alias("vtype"), "str_val", "num_val", F.lit(None).cast("timestamp").alias("ts_val"),
    )


_SHEET_SQL = """with e as (select user_id::varchar as doc_id, event_id, row_number() over (partition by user_id order by ts, event_id) + 3 as r,
  case when event_type = 'signup' then 'W' || (event_id % 7) else '' end as w, case when event_type = 'error' then 'C' || (event_id % 7) else '' end as c,
  case when event_type = 'click' then 'I' || (event_id % 7) when event_type = 'view' and event_id % 11 = 0 then '合計' else '' end as i, case when event_type = 'purchase' then 's' || (event_id % 7) else '' end as s,
  case when event_id % 2 = 0 then 'm2' else '' end as u, case when event_type in ('purchase', 'view') then value end as q from events),
n as (select *, i <> '合計' as live, (w || c || i || u) <> '' as stop from e),
l as (select *, lead(q, 1) over x as q1, lead(q, 2) over x as q2, lead(q, 3) over x as q3, lead(q, 4) over x as q4, coalesce(lead(stop, 1) over x, true) as s1, coalesce(lead(stop, 2) over x, true) as s2,
  coalesce(lead(stop, 3) over x, true) as s3, coalesce(lead(stop, 4) over x, true) as s4 from n window x as (partition by doc_id order by r)),
d as (select *, case when q is not null or s1 then 0 when q1 is not null then 1 when s2 then 0 when q2 is not null then 2 when s3 then 0 when q3 is not null then 3 when s4 then 0 when q4 is not null then 4 else 0 end as dist from l),
f as (select *, case dist when 0 then q when 1 then q1 when 2 then q2 when 3 then q3 else q4 end as found,
  coalesce(lag(dist, 1) over x = 1 and lag(live, 1) over x, false) or coalesce(lag(dist, 2) over x = 2 and lag(live, 2) over x, false) or coalesce(lag(dist, 3) over x = 3 and lag(live, 3) over x, false) or coalesce(lag(dist, 4) over x = 4 and lag(live, 4) over x, false) as used
  from d window x as (partition by doc_id order by r)),
k as (select *, count(nullif(w, '')) over x as gw, count(nullif(w || c, '')) over x as gc from f where live and not used window x as (partition by doc_id order by r rows unbounded preceding)),
p as (select *, coalesce(last_value(nullif(w, '') ignore nulls) over (partition by doc_id order by r rows unbounded preceding), '') as fw, coalesce(last_value(nullif(c, '') ignore nulls) over (partition by doc_id, gw order by r rows unbounded preceding), '') as fc,
  coalesce(last_value(nullif(i, '') ignore nulls) over (partition by doc_id, gc order by r rows unbounded preceding), '') as fi, coalesce(last_value(nullif(u, '') ignore nulls) over (partition by doc_id order by r rows unbounded preceding), '') as fu from k),
o as (select *, case when u <> '' then u when s <> '' or found is not null then fu else '' end as unit from p where (w || c || i || s || u) <> '' or found is not null)
select doc_id, r::int as source_row, fw as work_type, fc as category, fi as item_name, s as specification, unit, found as quantity, case when found is null then 'SOURCE_REVIEW_REQUIRED' else 'READY' end as extraction_status
from o where fi <> '' and unit <> '' and not coalesce(found = 0 and i = '' and s = '', false)"""


@query(_SHEET_SQL)
def sheet_records(spark, sf_dir):
    """Records of one sheet for each user, through detection, look-ahead and carry-down."""
    found = sheets.records(sheets.prepared(_event_cells(spark, sf_dir)))
    return found.select("doc_id", "source_row", "work_type", "category", "item_name", "specification", "unit", "quantity", "extraction_status")


def _order_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each customer: a header and a row for each order."""
    o = _table(spark, sf_dir, "orders")
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    cells = F.array(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("W"), F.col("o_orderkey") % 5)).otherwise(""), F.substring("o_orderpriority", 3, 20), F.lit("規格"), F.when(F.col("o_orderstatus") != "P", "m2").otherwise(""), F.round("o_totalprice", 1).cast("string"), F.lit(""))
    body = o.select("o_custkey", row.alias("row"), cells.alias("cells"))
    head = o.select("o_custkey").distinct().select("o_custkey", F.lit(0).alias("row"), F.array(*(F.lit(x) for x in ("工種", "名称", "規格", "単位", "数量", "備考"))).alias("cells"))
    return body.unionByName(head).select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit("数量総括表").alias("page_text"), F.lit(0).alias("table_idx"), "row", "cells")


@query("""with o as (select o_custkey::varchar as doc_id, row_number() over (partition by o_custkey order by o_orderkey) as r, case when o_orderstatus = 'F' then 'W' || (o_orderkey % 5) end as w, substring(o_orderpriority, 3, 20) as i, o_orderstatus, round(o_totalprice, 1) as q from orders)
select doc_id, (r + 1)::int as source_row, coalesce(last_value(w ignore nulls) over (partition by doc_id order by r rows unbounded preceding), '') as work_type, i as item_name, q as quantity from o qualify o_orderstatus <> 'P'""")
def grid_records(spark, sf_dir):
    """Records of a table matrix for each customer."""
    return grids.records(_order_grids(spark, sf_dir)).select("doc_id", "source_row", "work_type", "item_name", "quantity")


@query("""with o as (select o_custkey::varchar as doc_id, row_number() over (partition by o_custkey order by o_orderkey) as r, case when o_orderstatus = 'F' then 'W' || (o_orderkey % 5) end as w, substring(o_orderpriority, 3, 20) as i, o_orderstatus, round(o_totalprice, 1) as q from orders)
select doc_id, (r + 1)::int as source_row, coalesce(last_value(w ignore nulls) over (partition by doc_id order by r rows unbounded preceding), '') as work_type, i as item_name, q as quantity, case when o_orderstatus = 'P' then 0.45 else 0.7 end::double as extraction_confidence from o""")
def scan_records(spark, sf_dir):
    """Records of the same matrices as scans."""
    rows = _order_grids(spark, sf_dir).select("doc_id", "page", "row", "cells")
    return scans.records(rows).select("doc_id", "source_row", "work_type", "item_name", "quantity", "extraction_confidence")

def _cells_of(rows: DataFrame, heads: list[str]) -> DataFrame:
    """One grid for each doc_id and page of (doc_id, page, page_text, row, cells), with a header row 0."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row")) == 1
    line = lambda row, cells: F.struct(row.alias("row"), cells.alias("cells"))
    head, own = line(F.lit(0), F.array(*(F.lit(x) for x in heads))), line(F.col("row"), F.col("cells"))
    both = rows.withColumn("lines", F.when(first, F.array(head, own)).otherwise(F.array(own)))
    return both.select("doc_id", "page", "page_text", F.lit(0).alias("table_idx"), F.inline("lines"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in turn, as rows of four kinds (k)."""
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey", row.cast("int").alias("row"))
    digest = F.floor(F.col("o_orderkey") / 4)
    return o.withColumns({"k": digest % 4, "a": digest % 3, "q": (digest % 7 + 1).cast("double")})


_KINDS = """with o as (select o_custkey::varchar as doc_id, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey))::int as r, (o_orderkey // 4) % 4 as k, (o_orderkey // 4) % 3 as a, ((o_orderkey // 4) % 7 + 1)::double as q from orders)
"""


@query(_KINDS + """, e as (
  select *, case when k = 0 then 'W' || a else '' end as w, case k when 0 then 'C' || a when 2 then 'D' || a else '' end as n, case k when 0 then 's' || a when 1 then 'p' || (o_orderkey % 5) when 2 then '' else '' end as s from o
), g as (
  select *, sum((k <> 1)::int) over t as grp, count(nullif(w || n || s, '')) over t as m, last_value(nullif(w, '') ignore nulls) over t as work, last_value(nullif(n, '') ignore nulls) over t as name
  from e window t as (partition by doc_id order by r rows unbounded preceding)
), c as (
  select *, first_value(s) over (partition by doc_id, m order by r) as inside from g
), f as (
  select doc_id, grp, string_agg(s, ' / ' order by r) as following from (select doc_id, grp, s, min(r) as r from c where k = 1 group by all) group by all
)
select c.doc_id, r + 1 as source_row, coalesce(work, '') as work_type, name as item_name, concat_ws(' / ', nullif(inside, ''), f.following) as specification, q as quantity, f.following is not null as joined
from c left join f on f.doc_id = c.doc_id and f.grp = c.grp where k <> 1 and name is not null""")
def grid_inline(spark, sf_dir):
    """Records of tables whose specification stands behind the name, and goes on in the rows below."""
    k, a = F.col("k"), F.col("a").cast("string")
    work, name = F.when(k == 0, F.concat(F.lit("W"), a)), F.when(k == 0, F.concat(F.lit("C"), a)).when(k == 2, F.concat(F.lit("D"), a))
    detail = F.when(k == 0, F.concat(F.lit("s"), a)).when(k == 1, F.concat(F.lit("p"), (F.col("o_orderkey") % 5).cast("string")))
    body = F.when(k != 1, F.lit("m2")), F.when(k != 1, F.col("q").cast("string"))
    rows = _kinds(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.lit("数量総括表").alias("page_text"), "row", F.array(work, name, detail, *body, F.lit("")).alias("cells"))
    found = grids.records(_cells_of(rows, ["工種", "種別", "細目", "単位", "数量", "摘要"]))
    return found.select("doc_id", "source_row", "work_type", "item_name", "specification", "quantity", F.array_contains("extraction_warnings", grids.JOINED_WARNING).alias("joined"))


@query(_KINDS + """, p as (
  select *, ((r - 1) // 6 + 1)::int as page, case when ((r - 1) // 6) % 3 = 2 then 'Y' else 'X' end as scope from o
), t as (
  select *, sum((lag_scope is distinct from scope)::int) over (partition by doc_id order by r rows unbounded preceding) as part from (select *, lag(scope) over (partition by doc_id order by r) as lag_scope from p)
), h as (
  select *, last_value(case when k = 0 then 'H' || a end ignore nulls) over w as category, sum((k = 0)::int) over w as sect from t window w as (partition by doc_id, part order by r rows unbounded preceding)
), i as (
  select *, last_value(case when k = 1 then 'I' || a end ignore nulls) over w as item, last_value(case when k = 1 then 'q' || a when k = 2 then 'r' || a end ignore nulls) over w as qualifier
  from h window w as (partition by doc_id, part, sect order by r rows unbounded preceding)
)
select doc_id, page as source_page, (r + 1)::int as source_row, scope as work_type, coalesce(category, '') as category, item as item_name, qualifier as specification, q as quantity from i where k <> 0 and item is not null""")
def grid_type(spark, sf_dir):
    """Records of tables with headings, over pages whose titles name the work."""
    k, a = F.col("k"), F.col("a").cast("string")
    name = F.when(k == 0, F.concat(F.lit("H"), a)).when(k == 1, F.concat(F.lit("I"), a))
    second = F.when(k == 1, F.concat(F.lit("q"), a)).when(k == 2, F.concat(F.lit("r"), a))
    rows = _kinds(spark, sf_dir).withColumn("page", F.floor((F.col("row") - 1) / 6).cast("int") + 1)
    title = F.concat(F.when((F.col("page") - 1) % 3 == 2, "Y").otherwise("X"), F.lit("数量総括表"))
    rows = rows.select("doc_id", "page", title.alias("page_text"), "row", F.array(name, second, F.lit(None).cast("string"), F.when(k != 0, F.lit("m2")), F.when(k != 0, F.col("q").cast("string"))).alias("cells"))
    found = grids.records(_cells_of(rows, ["種別", "", "規格", "単位", "数量"]))
    return found.select("doc_id", "source_page", "source_row", "work_type", "category", "item_name", "specification", "quantity")


@query("""with p as (select page_id, page_id // 40 as doc, starts_with(url, 'https') as shape, page_id % 5 = 0 as summary, page_id % 5 <> 0 and page_id % 7 = 3 as detail from pages where page_id % 11 <> 4),
s as (select *, last_value(case when summary then shape end ignore nulls) over (partition by doc order by page_id rows unbounded preceding) as led from p),
f as (select * from s where summary or (not detail and shape = led)),
n as (select *, summary or coalesce(page_id - lag(page_id) over (partition by doc order by page_id) > 1, true) as new from f),
g as (select *, sum(new::int) over (partition by doc order by page_id rows unbounded preceding) as island from n)
select doc::varchar as doc_id, page_id::int as source_page from (select *, first_value(summary) over (partition by doc, island order by page_id) as ok from g) where ok""")
def grid_pages(spark, sf_dir):
    """Pages whose tables are read: summaries, and what continues them in the same shape."""
    p = _table(spark, sf_dir, "pages").filter("page_id % 11 <> 4")
    n = F.col("page_id")
    text = F.when(n % 5 == 0, "数量総括表").when(n % 7 == 3, "数量計算書").otherwise("続き")
    p = p.select((F.floor(n / 40)).cast("string").alias("doc_id"), n.cast("int").alias("page"), text.alias("page_text"), F.col("url").startswith("https").alias("wide"))
    heads, row = ["種別", "規格", "単位", "数量"], [F.lit("a"), F.lit(""), F.lit("m"), F.lit("1")]
    line = lambda i, cells: F.struct(F.lit(i).alias("row"), F.when(F.col("wide"), F.array(*cells, F.lit(""))).otherwise(F.array(*cells)).alias("cells"))
    rows = p.select("doc_id", "page", "page_text", F.lit(0).alias("table_idx"), F.inline(F.array(line(0, [F.lit(x) for x in heads]), line(1, row))))
    return grids.records(rows).select("doc_id", "source_page")


@query(_KINDS + """, e as (select *, case when k = 0 then 'I' || a else '' end as i, case when k in (0, 2) then 's' || a when k = 1 and a > 0 then 'p' || a else '' end as s, case when k in (0, 2) then q end as n from o),
c as (select *, k = 1 and s <> '' as lone, last_value(nullif(i, '') ignore nulls) over w as item from e window w as (partition by doc_id order by r rows unbounded preceding)),
b as (select *, max(case when not lone then r end) over (partition by doc_id order by r rows unbounded preceding) as at from c),
h as (select b.*, case when lone then b.item is not null and (coalesce(x.item is not null and x.n is not null, false) <> ((b.r - coalesce(b.at, 0)) % 2 = 1)) else b.item is not null and b.n is not null end as has
  from b left join (select doc_id as d, r as ar, item, n from c) x on x.d = b.doc_id and x.ar = b.at)
select doc_id, (r + 1)::int as source_row, item as item_name, concat_ws(' / ', nullif(s, ''), case when next_lone then next_s end) as specification, n as quantity from (
  select *, lead(lone) over w as next_lone, lead(s) over w as next_s from h window w as (partition by doc_id order by r)) where has""")
def scan_series(spark, sf_dir):
    """Records of scans with series of lone specifications, every second one of which goes to the record above."""
    k, a = F.col("k"), F.col("a").cast("string")
    counts = k.isin(0, 2)
    spec = F.when(counts, F.concat(F.lit("s"), a)).when((k == 1) & (F.col("a") > 0), F.concat(F.lit("p"), a))
    cells = F.array(F.lit("W"), F.lit(""), F.when(k == 0, F.concat(F.lit("I"), a)), spec, F.when(counts, F.lit("m2")), F.when(counts, F.col("q").cast("string")), F.lit(""))
    blank = F.transform(cells, lambda x, i: F.when((i == 0) & ~counts, F.lit("")).otherwise(F.when(i == 0, F.lit("")).otherwise(x)))
    rows = _cells_of(_kinds(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.lit("").alias("page_text"), "row", blank.alias("cells")), ["工種", "種別", "細別", "規格", "単位", "数量", "備考"])
    return scans.records(rows.drop("page_text", "table_idx")).select("doc_id", "source_row", "item_name", "specification", "quantity")


@query("""with p as (select p_partkey, p_size % 6 as k, p_partkey % 100 as n, p_name as t from part)
select p_partkey, case k when 0 then n + 0.5 when 1 then n when 2 then -n when 3 then null when 4 then n * 1000 + 5 else n end::double as first_quantity,
  t as hierarchy_label, t || ' / ' || t || 'x' as note, t || ' / y' as combined, replace(t, ' ', '') as compacted,
  case when k < 3 then '第' || n || '工区' else '本工事費' end as section, t as file_project, case when k = 0 then '' else t end as title_project,
  k % 2 = 0 as summary_page, k = 3 as detail_page, case when k < 3 then 'scope' || n else '' end as scope,
  make_date(2000 + (n % 30)::int, (k + 1)::int, 5) as day, ['old'] || case when k > 2 then ['new'] else [] end as warnings, round(case when k = 0 then 0 else 2.0 * least(k, 3) / (k + 3) end, 9)::double as dice from p""")
def text_functions(spark, sf_dir):
    """Labels, notes, titles, dates, page tests and the Dice coefficient, over texts made from part names."""
    part = _table(spark, sf_dir, "part")
    k, n, t = F.col("p_size") % 6, F.col("p_partkey") % 100, F.col("p_name")
    pick = lambda *xs: F.element_at(F.array(*xs), (k + 1).cast("int"))
    number = pick(F.concat(F.lit("約"), n, F.lit(".5m")), F.concat(n, F.lit(" (7)")), F.concat(F.lit("-"), n), F.lit("―"), F.concat(n, F.lit(",005 kg")), n.cast("string"))
    numbered = pick(F.concat(F.lit("(3) "), t), F.concat(F.lit("§ 1.2. "), t), F.concat(F.lit("12 "), t), t, F.concat(F.lit("（1-2）"), t), F.concat(F.lit("3:"), t))
    sheet = F.when(k < 3, F.concat(F.lit("設計数量総括表(第"), n, F.lit("工区)"))).otherwise(F.lit("表"))
    title = pick(F.lit("目次"), F.concat(F.lit("設計書名: "), t), F.concat(F.lit("数量総括表（"), t, F.lit("）")), F.concat(F.lit("§3 設計数量総括表 "), t), F.concat(t, F.lit(" 数量総括表")), F.concat(F.lit("設計書名："), t))
    page = F.when(k % 2 == 0, "数量 総括表").when(k == 3, "詳細計算").otherwise("x")
    scoped = F.array(F.lit("a"), F.when(k < 3, F.concat(F.lit("第2. scope"), n, F.lit(" 数量集計表(1)"))).otherwise("b"))
    ones = lambda m: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (i <= m).cast("int"))
    return part.select(
        "p_partkey", T.first_quantity(T.clean(number)).alias("first_quantity"), T.hierarchy_label(T.clean(numbered)).alias("hierarchy_label"), T.note(t, F.lit(""), F.concat(t, F.lit("x"))).alias("note"),
        T.combine_unique(t, F.lit("―"), t, F.lit(""), F.lit("y")).alias("combined"), T.compact(t).alias("compacted"), T.section_of_sheet(T.clean(sheet)).alias("section"),
        T.project_of_file(F.concat(F.lit("03_"), t, F.lit("(数量計算書)"))).alias("file_project"), T.project_of_title(T.label(T.clean(title))).alias("title_project"), T.is_summary_page(page).alias("summary_page"),
        T.is_detail_page(F.array(F.lit("y"), page)).alias("detail_page"), T.title_and_scope(scoped)[1].alias("scope"), T.iso_date(F.concat_ws("-", F.lit(2000) + n % 30, F.lpad((k + 1).cast("string"), 2, "0"), F.lit("05"))).alias("day"),
        T.add_warning(T.add_warning(F.array(F.lit("old")), "new", k > 2), "old", F.lit(True)).alias("warnings"), F.round(T.dice(ones(k), ones(F.lit(3))), 9).alias("dice"),
    )


@query("""select 'unit' as queue, 'b' || (o_custkey % 10) || '.xlsx' as workbook, (min(o_orderkey) % 1000)::int as min_key, count(*)::bigint as n, count(*) filter (o_orderpriority like '1%' and o_orderstatus <> 'P')::bigint as urgent, sum(o_orderkey)::bigint as rows_ from orders
where o_orderkey >= 7 and (o_orderstatus <> 'P' or o_custkey % 2 = 0) group by o_custkey % 10""")
def review_list(spark, sf_dir):
    """Review rows of exported lists: the first sheet that isn't the settings, from row 7 on, with a name or a message."""
    o = _table(spark, sf_dir, "orders")
    cell = lambda sheet, c, s: F.struct(F.lit(sheet[0]).alias("sheet_idx"), F.lit(sheet[1]).alias("sheet"), F.lit(c).alias("col"), s.cast("string").alias("text"))
    first, second = (1, "一覧"), (2, "次")
    cells = F.array(
        cell((0, "設定"), 2, F.lit("no")), cell(first, 2, F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("")), cell(first, 50, F.when(F.col("o_custkey") % 2 == 0, "m").otherwise("")),
        cell(first, 17, F.lit("s")), cell(second, 2, F.lit("no")),
    )
    book = F.concat(F.lit("x/b"), F.col("o_custkey") % 10, F.lit(".xlsx"))
    rows = o.select(book.alias("doc_id"), book.alias("source_file"), F.col("o_orderkey").cast("int").alias("row"), F.inline(cells))
    found = reconcile.review_rows(rows, "unit")
    return found.groupBy("queue", "workbook").agg((F.min("row") % 1000).cast("int").alias("min_key"), F.count("*").alias("n"), F.sum(F.col("name").startswith("1").cast("bigint")).alias("urgent"), F.sum("row").alias("rows_"))

@query(_KINDS + """, e as (select *, last_value(case when k = 0 then 'W' || a end ignore nulls) over w as l2, sum((k = 0)::int) over w as part from o window w as (partition by doc_id order by r rows unbounded preceding)),
f as (select *, last_value(case when k = 1 then 'C' || a end ignore nulls) over (partition by doc_id, part order by r rows unbounded preceding) as l3 from e)
select doc_id, (4 * r)::bigint as source_row, coalesce(l2, '') as level2, coalesce(l3, '') as level3, 'N' || a as item_name, case when a = 2 then 'c' || a || ' / d' else 'c' || a end as specification,
  case when a = 0 then 'CB4102' || lpad((o_orderkey % 100)::varchar, 2, '0') else '' end as code, (case when k = 3 then 5 else 4 end)::bigint as item_column,
  case when a = 1 then '施工' else '' end as reference_type, case when a = 1 then '施工 第 1' else '' end as reference_text from f where k >= 2""")
def catalog_entries(spark, sf_dir):
    """Entries of detail sheets: levels named by markers in the row below, and items with their conditions."""
    k, a, none = F.col("k"), F.col("a").cast("string"), F.lit(None).cast("string")
    cell = lambda down, c, s, n=False: F.struct(F.lit(down).alias("down"), F.lit(c).alias("col"), s.cast("string").alias("text"), F.lit("n" if n else "s").alias("vtype"))
    code = F.when(F.col("a") == 0, F.concat(F.lit("[CB4102"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("]"))).otherwise(none)
    item = [cell(0, 4, F.concat(F.lit("N"), a)), cell(0, 8, F.lit("1"), True), cell(0, 10, F.lit("m")), cell(0, 13, code), cell(1, 4, F.concat(F.lit("c"), a)), cell(1, 5, F.when(F.col("a") == 2, "d")), cell(1, 13, F.when(F.col("a") == 1, "施工 第 1"))]
    deep = [cell(0, 4, none), cell(0, 5, F.concat(F.lit("N"), a)), *item[1:]]
    of = F.when(k == 0, F.array(cell(0, 2, F.concat(F.lit("W"), a)), cell(1, 13, F.lit("工種行")))).when(k == 1, F.array(cell(0, 3, F.concat(F.lit("C"), a)), cell(1, 13, F.lit("種別行")))).when(k == 2, F.array(*item)).otherwise(F.array(*deep))
    rows = _kinds(spark, sf_dir).withColumn("base", F.col("row") * 4).select("doc_id", "base", F.inline(of)).filter("text is not null")
    cells = rows.select("doc_id", F.col("doc_id").alias("source_file"), F.lit(0).alias("sheet_idx"), F.lit(C.SHEET).alias("sheet"), (F.col("base") + F.col("down")).alias("row"), "col", "vtype", "text")
    return C.entries(cells).select("doc_id", "source_row", "level2", "level3", "item_name", "specification", "code", "item_column", "reference_type", "reference_text")


_HEADER_SQL = ", ".join(f"({r}, {c}, '{t}', null::double)" for r, c, t in layout.HEADER)


@query(_BLOCKS + f""", z as (select *, (block // 9)::int as page, (block % 9)::int as slot, (1 + (block // 9) * 40 + 3 + (block % 9) * 4)::int as top from b),
w as (
  select r_name, 1 + page * 40 + v.r as row_, v.c as col_, v.t as text, v.n as number from z, (values {_HEADER_SQL}) v(r, c, t, n) where slot = 0
  union all select r_name, 2 + page * 40, 13, null, (page + 2)::double from z where slot = 0
  union all select r_name, top, case level when 'fee' then 1 when 'work' then 2 when 'category' then 3 when 'subcategory' then 4 when 'specification_group' then 5 else least(greatest(c_custkey % 9, 4), 6) end, value, null from z
  union all select r_name, top, 8, null, case when level = 'item' then c_custkey else 1 end::double from z
  union all select r_name, top, 10, case when level = 'item' then 'm' else '式' end, null from z
  union all select r_name, case when level = 'item' then top else top + 1 end, 13, case level when 'fee' then '費目行' when 'work' then '工種行' when 'category' then '種別行' when 'subcategory' then '細別行' when 'specification_group' then '規格行' else case when c_custkey % 2 = 1 then '[CB1]' else '' end end, null from z
  union all select r_name, top + 1, 4, 'c' || (c_custkey % 5), null from z where level = 'item'
)
select r_name as doc_id, row_::int as row, col_::int as col, text, number from w""")
def workbook_cells_written(spark, sf_dir):
    """Every cell that the output's main sheet gets: page headers, level rows and items."""
    found = _blocks(spark, sf_dir).withColumnRenamed("r_name", "doc_id")
    k = F.col("c_custkey")
    found = found.withColumns({"quantity": k.cast("double"), "unit": F.lit("m"), "output_item_column": k % 9, "output_code": F.when(k % 2 == 1, "CB1").otherwise(""), "output_condition": F.concat(F.lit("c"), (k % 5).cast("string"))})
    return layout.cell_writes(found).select("doc_id", "row", "col", "text", "number")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
