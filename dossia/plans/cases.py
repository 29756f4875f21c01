"""Registered queries over audit-shaped rows: tables from cells and detections, checks, templates, runs, reports and model findings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossia.operators import evidence, history, pages, report, review_table, summaries, templates
from dossia.plans import book
from dossia.plans.book import query, rows
from dossia.sources import run_store as store
from dossia.sources import shared
from dossia.sources.tables import table

#: Recognised texts of a review table with their places; the tenth has none.
BOXES = """select o_orderkey as doc_id, 1 as page_num, b.seq, case b.seq when 0 then '法定(含無障礙)汽車停車位' when 1 then concat(cast(o_orderkey % 90 as string), '輛') when 2 then '無障礙停車位' when 3 then cast(o_orderkey % 4 as string) when 4 then '基準容積'
    when 5 then concat(cast(1 + o_orderkey % 8 as string), ',') when 6 then '406.50' when 7 then case when o_orderkey % 3 = 0 then '實設' else '其他' end when 8 then '平面' when 9 then concat(cast(o_orderkey % 30 as string), '輛') when 10 then '機械' when 11 then case when o_orderkey % 5 = 0 then '無' else cast(o_orderkey % 40 as string) end
    when 12 then '送審類別' when 13 then case o_orderkey % 4 when 0 then '■B-1：168專案小組版□B-2' when 1 then '審議會版(第1次補正)' when 2 then '□A-1 □B-1' else '無' end when 14 then '獎勵上限 1,877.63' else '#12無障礙環境設計 84.36' end as text,
  cast(0.9 as double) as conf, b.x0, b.x0 + 50 as x1, b.yc, cast(14 as double) as h from orders, (values (0, cast(0 as double), cast(50 as double)), (1, cast(60 as double), cast(52 as double)), (2, cast(200 as double), cast(50 as double)), (3, cast(260 as double), cast(47 as double)), (4, cast(0 as double), cast(100 as double)),
    (5, cast(60 as double), cast(101 as double)), (6, cast(120 as double), cast(99 as double)), (7, cast(0 as double), cast(150 as double)), (8, cast(60 as double), cast(200 as double)), (9, cast(120 as double), cast(200 as double)), (10, cast(180 as double), cast(200 as double)), (11, cast(240 as double), cast(200 as double)),
    (12, cast(0 as double), cast(250 as double)), (13, cast(60 as double), cast(250 as double)), (14, cast(0 as double), cast(300 as double)), (15, cast(0 as double), cast(350 as double))) as b(seq, x0, yc)"""


@query("""with t as (select o_orderkey as k from orders), s as (select k, k % 30 as surface, case when k % 5 <> 0 then k % 40 end as mech from t)
  select k as doc_id, (k % 90)::int as legal_parking, (k % 4)::int as accessible_parking, (1 + k % 8) * 1000 + 406.5::double as base_floor_area, 1877.63::double as bonus_limit, case when k % 3 = 0 and mech is not null then surface + mech + k % 4 end::int as actual_parking,
    case when k % 3 = 0 and mech is not null then concat('平面', surface, '機械', mech, '無障礙', k % 4, '充電-') end as actual_parking_detail, case k % 4 when 0 then 'B-1' when 1 then 'C' end as submission_type from s""")
def detected_fields(spark, folder):
    out = review_table.from_detections(rows(spark, folder, BOXES))
    return out.select("doc_id", "legal_parking", "accessible_parking", "base_floor_area", "bonus_limit", "actual_parking", "actual_parking_detail", "submission_type")


@query("""with l as (select l_orderkey as doc_id, (row_number() over (partition by l_orderkey order by l_linenumber, concat('t', l_partkey), case when l_linenumber % 3 <> 0 then round(l_discount * 10, 2) end, l_quantity) - 1)::int as seq, concat('t', l_partkey) as text, case when l_linenumber % 3 <> 0 then round(l_discount * 10, 2) end as s, l_quantity as q from lineitem)
  select doc_id, seq, text, round(coalesce(s, 1.0), 3) as conf, round(q, 1) as x0, round(q + 40, 1) as x1, round(q * 2 + 5, 1) as yc, 10.0::double as h from l where coalesce(s, 1.0) >= 0.5""")
def detections(spark, folder):
    li = table(spark, folder, "lineitem")
    score = F.when(F.col("l_linenumber") % 3 != 0, F.round(F.col("l_discount") * 10, 2))
    q = F.col("l_quantity")
    box = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((q, q * 2), (q + 40, q * 2), (q + 40, q * 2 + 10), (q, q * 2 + 10))])
    one = F.struct("l_linenumber", F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), score.alias("score"), box.alias("box"))
    page = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    took = page.select("doc_id", F.lit(1).alias("page_num"), F.transform("all", lambda x: x["text"]).alias("texts"), F.transform("all", lambda x: x["score"]).alias("scores"), F.transform("all", lambda x: x["box"]).alias("polygons"))
    return pages.shown_detections(pages.detections(took)).drop("page_num")


TABLE_HTML = """select o_orderkey as doc_id, concat('<table><tr><td>基地面積</td><td> ', cast(o_orderkey % 900 as string), '.5 m<b>2</b></td><td>法定停車位</td><td></td></tr>', chr(10), '<tr><th class="a">充電車位</th><td>', cast(o_orderkey % 6 as string), '</td><td>實施者</td><td>',
  case when o_orderkey % 2 = 0 then '甲公司' else '' end, '</td></tr><tr><td>基地面積</td><td>7</td></tr></table>') as html from orders"""


@query("""with t as (select o_orderkey as k from orders) select k as doc_id, (k % 900) + 0.5::double as land_area, null::int as legal_parking, (k % 6)::int as ev_parking, case when k % 2 = 0 then '甲公司' else '實施者' end as implementer from t""")
def cell_fields(spark, folder):
    cells = pages.html_cells(rows(spark, folder, TABLE_HTML), ["doc_id"], "html")
    return review_table.from_cells(cells, ["doc_id"]).select("doc_id", "land_area", "legal_parking", "ev_parking", "implementer")


#: Pages whose list items stand in table rows of two or three cells.
ITEMS = "replace(replace(html, '<li>', '<tr><th>名</th><td class=\"v\">'), '</li>', concat('</td>', case when page_id % 2 = 0 then '<td> <b>x</b></td>' else '' end, '</tr>'))"


@query(rf"""with h as (select page_id, unnest(x) as item, generate_subscripts(x, 1) - 1 as row from (select page_id, regexp_extract_all({ITEMS}, '(?s)<tr>(.*?)</tr>', 1) as x from pages)), c as (select page_id, row::int as row, regexp_extract_all(item, '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1) as x from h)
  select page_id, row, (generate_subscripts(x, 1) - 1)::int as col, trim(regexp_replace(unnest(x), '<[^>]+>', '', 'g')) as text from c""")
def page_cells(spark, folder):
    return pages.html_cells(table(spark, folder, "pages").select("page_id", F.expr(ITEMS).alias("html")), ["page_id"], "html")


FIELDS = ["land_area", "base_floor_area", "bonus_floor_area", "bonus_limit", "legal_parking", "actual_parking"]


def tier(m: int) -> str:
    """A tier's numbers: a field is there where the key isn't a multiple of some number."""
    n = ", ".join(f"case when (o_orderkey + {i}) % {m + i % 3} <> 0 then cast({m * 1000 + i} as {'int' if 'parking' in f else 'double'}) end as {f}" for i, f in enumerate(FIELDS))
    return f"select o_orderkey as doc_id, cast(case when o_orderkey % 19 <> 0 then 3 end as int) as raw_page, {n} from orders"


TIERS = [tier(m) for m in (2, 3, 2, 3)]
REGIONS = "select o_orderkey as doc_id, case when o_orderkey % 2 = 0 then '2 002' else '3,002.5' end as bonus_text, case when o_orderkey % 3 = 0 then '9 999' else '1' end as base_text from orders"
FILL = lambda t, gate: ", ".join(f"coalesce(a.{f}, case when {gate} then {t}.{f} end) as {f}" for f in FIELDS)
COVER = "((a.bonus_floor_area is not null)::int + (a.bonus_limit is not null)::int + (a.legal_parking is not null)::int + (a.actual_parking is not null)::int + (a.land_area is not null)::int) / 5.0"


@query(f"""with t0 as ({TIERS[0]}), t1 as ({TIERS[1]}), t2 as ({TIERS[2].replace('+ 0)', '+ 1)')}), t3 as ({TIERS[3]}), g as ({REGIONS}),
  a1 as (select a.doc_id, a.raw_page, {FILL('b', 'a.raw_page is not null and ' + COVER + ' < 1.0')} from t0 a join t1 b using (doc_id)),
  a2 as (select a.* replace (coalesce(a.base_floor_area, case when a.raw_page is not null and abs(case when g.doc_id % 2 = 0 then 2002 else 3002.5 end - a.bonus_floor_area) <= greatest(1, a.bonus_floor_area * 0.01) and 9999 > a.bonus_floor_area and g.base_text = '9 999' then 9999 end) as base_floor_area) from a1 a join g using (doc_id)),
  a3 as (select a.doc_id, a.raw_page, {FILL('b', 'a.raw_page is not null and ' + COVER + ' < 0.6')} from a2 a join t3 b using (doc_id)) select * from a3""")
def extraction_cascade(spark, folder):
    base, boxes, vision = (rows(spark, folder, t) for t in (TIERS[0], TIERS[1], TIERS[3]))
    return review_table.cascade(base, ["doc_id"], boxes=boxes.drop("raw_page"), regions=rows(spark, folder, REGIONS), vision=vision.drop("raw_page"))


@query("""with t as (select o_orderkey as doc_id, o_custkey * 400.0::double as base, case when o_orderkey % 3 = 0 then o_custkey * 200.0 + 100 else o_custkey * 200.0 end::double as lim, case when o_orderkey % 4 = 0 then o_custkey * 300.0 + 9 else o_custkey * 100.0 end::double as bonus from orders),
  c as (select *, abs(lim - base * 0.5) <= greatest(0.01, abs(base * 0.5) * 0.01) as c1, bonus <= lim * 1.01 as c2 from t),
  n as (select doc_id, base, case when not c1 and doc_id % 2 = 0 then base * 0.5 else lim end as lim, case when not c2 and doc_id % 5 <> 0 then base * 0.25 else bonus end as bonus from c)
  select doc_id, lim as bonus_limit, bonus as bonus_floor_area, concat_ws(';', case when not abs(lim - base * 0.5) <= greatest(0.01, abs(base * 0.5) * 0.01) then '衍生獎勵上限 = 基準容積 × 50%' end, case when not bonus <= lim * 1.01 then '合計獎勵樓地板 ≤ 獎勵上限' end) as residual from n""")
def verify_loop(spark, folder):
    o = table(spark, folder, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("double")
    t = o.select(k.alias("doc_id"), (c * 400).alias("base_floor_area"), F.when(k % 3 == 0, c * 200 + 100).otherwise(c * 200).alias("bonus_limit"), F.when(k % 4 == 0, c * 300 + 9).otherwise(c * 100).alias("bonus_floor_area"))
    again = o.select(k.alias("doc_id"), F.when(k % 2 == 0, c * 200).alias("bonus_limit"), F.when(k % 5 != 0, c * 100).alias("bonus_floor_area"))
    return review_table.verified(t, ["doc_id"], [again]).select("doc_id", "bonus_limit", "bonus_floor_area", F.array_join("residual", ";").alias("residual"))


HEADINGS = [(1, "壹、計畫地區範圍"), (1, "說明"), (2, "參、小節"), (1, "貳、實施者資料（若無則免附）"), (1, "參、現況分析"), (1, "肆、處理方式（請擇一填寫）"), (1, "伍、區段劃分（請擇一填寫）"), (1, "附錄一、證明文件"), (1, "附錄二、其他（視實際情形）"), (1, "附錄三、甲案（擇一填寫）")]
SCHEMA = [("壹", "計畫地區範圍", "計畫地區範圍", "chapter", "required"), ("貳", "實施者資料（若無則免附）", "實施者資料", "chapter", "optional"), ("參", "現況分析", "現況分析", "chapter", "required"), ("肆", "處理方式（請擇一填寫）", "處理方式", "chapter", "choose_one"),
          ("伍", "區段劃分（請擇一填寫）", "區段劃分", "chapter", "choose_one"), ("附錄一", "證明文件", "證明文件", "appendix", "required"), ("附錄二", "其他（視實際情形）", "其他", "appendix", "optional"), ("附錄三", "甲案（擇一填寫）", "甲案", "appendix", "choose_one")]
SCHEMA_SQL = "s(marker, title, key, kind, requirement, o) as (values " + ", ".join(f"('{m}', '{t}', '{k}', '{kind}', '{r}', {i})" for i, (m, t, k, kind, r) in enumerate(SCHEMA, 1)) + ")"
DOCS = f"""select o_orderkey as doc_id, case when o_orderkey % 13 = 0 then '' else concat({", ' ', ".join(f"case when (o_orderkey + {i}) % {2 + i % 3} = 0 then '{k[:1]} {k[1:]}' else '無' end" for i, (_, _, k, _, _) in enumerate(SCHEMA))}) end as text, '事業計畫書' as doc_type, '113' as version from orders"""


def template(spark):
    found = spark.createDataFrame([("事業計畫書", "113", i, level, text) for i, (level, text) in enumerate(HEADINGS)], "doc_type string, version string, seq int, level int, text string")
    return templates.sections(found, ["doc_type", "version"])


@query(f'with {SCHEMA_SQL} select marker, title, kind, requirement, o::int as "order" from s')
def template_sections(spark, folder):
    return template(spark).select("marker", "title", "kind", "requirement", "order")


@query(f"""with {SCHEMA_SQL}, d as ({DOCS}), e as (select doc_id, s.*, contains(replace(text, ' ', ''), key) as has from d, s), any_ as (select doc_id from e where has group by 1),
  need as (select doc_id, case kind when 'chapter' then 'FMT-CH-0' else 'FMT-AP-0' end || o as rule_id, 'high' as severity, case kind when 'chapter' then concat('未偵測到必附章節「', marker, '、', title, '」') else concat('未偵測到必附附錄「', marker, '、', title, '」（113年版官方範本必附）') end as message from e where requirement = 'required' and not has),
  grp as (select doc_id, min(o) as o, string_agg(marker, '、' order by o) as names, bool_or(has) as has from e where requirement = 'choose_one' group by doc_id, case when o < 6 then 1 else 2 end),
  x as (select doc_id, 'FMT-XOR-0' || o as rule_id, 'medium' as severity, concat('擇一填寫群「', names, '」未偵測到任一節（應擇一填寫）') as message from grp where not has) select u.* from (select * from need union all select * from x) u join any_ using (doc_id)""")
def format_findings(spark, folder):
    schema = template(spark)
    present = templates.present_sections(rows(spark, folder, DOCS), schema)
    return templates.check_format(present, schema).select("doc_id", "rule_id", "severity", "message")


PLAN = "select o_orderkey as case_id, case when o_orderkey % 7 <> 0 then cast(o_custkey as double) end as land_area_sqm, case when o_orderkey % 5 <> 0 then cast(o_orderkey % 40 as int) end as owner_count, cast(o_custkey * 2 as double) as pre_renewal_value_wan, cast(o_custkey * 3 as double) as post_renewal_value_wan, case when o_orderkey % 3 = 0 then ' 甲 ' else '甲' end as implementer_name from orders"
OTHER = "select o_orderkey as case_id, cast(o_custkey as double) + o_orderkey % 3 * cast(0.4 as double) as land_area_sqm, cast(o_orderkey % 20 as int) as owner_count, case when o_orderkey % 2 = 0 then cast(o_custkey * 2 + o_orderkey % 3 as double) end as pre_renewal_value_wan, cast(o_custkey * 3 - o_orderkey % 4 as double) as post_renewal_value_wan, case o_orderkey % 4 when 0 then '' when 1 then '乙' else '甲' end as implementer_name from orders"


@query(f"""with a as ({PLAN}), b as ({OTHER}), j as (select a.case_id, a.land_area_sqm as a1, b.land_area_sqm as b1, a.owner_count as a2, b.owner_count as b2, a.pre_renewal_value_wan as a3, b.pre_renewal_value_wan as b3, a.post_renewal_value_wan as a4, b.post_renewal_value_wan as b4, a.implementer_name as a5, b.implementer_name as b5 from a join b using (case_id))
  select case_id, 'CONS-AREA-001' as rule_id, concat(format('{{:.2f}}', a1), ' m²') as business_plan_value, concat(format('{{:.2f}}', b1), ' m²') as rights_exchange_value from j where abs(a1 - b1) > 0.5 union all select case_id, 'CONS-OWN-001', concat(a2, ' 人'), concat(b2, ' 人') from j where a2 <> b2
  union all select case_id, 'CONS-VAL-001', concat(format('{{:.1f}}', a3), ' 萬元'), concat(format('{{:.1f}}', b3), ' 萬元') from j where abs(a3 - b3) > 1 union all select case_id, 'CONS-VAL-002', concat(format('{{:.1f}}', a4), ' 萬元'), concat(format('{{:.1f}}', b4), ' 萬元') from j where abs(a4 - b4) > 1
  union all select case_id, 'CONS-IMP-001', a5, b5 from j where a5 <> '' and b5 <> '' and trim(a5) <> trim(b5)""")
def cross_document(spark, folder):
    return evidence.cross_document(rows(spark, folder, PLAN), rows(spark, folder, OTHER)).select("case_id", "rule_id", "business_plan_value", "rights_exchange_value")


EXTRACTED = """select o_orderkey as id, case o_orderkey % 4 when 0 then '113' when 1 then '108' else '111' end as reg_year, case when o_orderkey % 3 <> 0 then cast(30 + o_orderkey % 20 as double) end as bonus_total_pct, cast(o_orderkey % 25 as double) as r1, cast(o_orderkey % 30 as double) as r2,
  case when o_orderkey % 6 <> 0 then cast(55 + o_orderkey % 40 as double) end as owner_pct, case when o_orderkey % 7 <> 0 then cast(65 + o_orderkey % 30 as double) end as area_pct, '112年1月2日' as application_date, case when o_orderkey % 5 = 0 then '112年1月3日' else '112年1月2日' end as affidavit_date,
  case when o_orderkey % 2 = 0 then '112年1月2日' end as power_of_attorney_date from orders"""


def extracted(spark, folder):
    return rows(spark, folder, EXTRACTED).withColumn("bonus_items", F.array("r1", "r2"))


VIOLATED_SQL = f"""x as ({EXTRACTED}), y as (select *, case when reg_year = '113' then 80.0 else 200.0 / 3 end as o_min, case when reg_year = '113' then 80.0 else 75.0 end as a_min from x),
  v as (select id, 'LAW-FAR-001' as rule_id, concat(format('{{:.1f}}', bonus_total_pct), '%') as actual_value from y where bonus_total_pct > 40 union all select id, 'LAW-FAR-001', concat(format('{{:.1f}}', r1 + r2), '%（各項合計）') from y where bonus_total_pct is null and r1 + r2 > 40
    union all select id, 'LAW-CON-001', concat(format('{{:.2f}}', owner_pct), '%') from y where owner_pct < o_min union all select id, 'LAW-CON-002', concat(format('{{:.2f}}', area_pct), '%') from y where area_pct < a_min
    union all select id, 'CONS-DATE-001', concat('申請書=112年1月2日、切結書=112年1月3日', case when id % 2 = 0 then '、委託書=112年1月2日' else '' end) from y where id % 5 = 0)"""


@query(f"with {VIOLATED_SQL} select * from v")
def field_findings(spark, folder):
    return evidence.field_findings(extracted(spark, folder)).select("id", "rule_id", "actual_value")


@query(f"""with {VIOLATED_SQL}, p as (select x.id, list_distinct(list(rule_id) filter (rule_id is not null)) as p from x left join v using (id) group by 1), e as (select id, coalesce(p, []) as p, case when id % 9 = 0 then ['LAW-FAR-001', 'OTHER'] else coalesce(p, []) end as e from p),
  c as (select sum(len(list_intersect(p, e))) as tp, sum(len(p) - len(list_intersect(p, e))) as fp, sum(len(e) - len(list_intersect(p, e))) as fn from e)
  select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, round(2 * tp / (2 * tp + fp + fn), 4) as f1 from c""")
def gold_evaluation(spark, folder):
    x = extracted(spark, folder)
    found = evidence.field_findings(x).groupBy("id").agg(F.collect_set("rule_id").alias("predicted"))
    both = x.select("id").join(found, "id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    both = both.withColumn("expected", F.when(F.col("id") % 9 == 0, F.array(F.lit("LAW-FAR-001"), F.lit("OTHER"))).otherwise(F.col("predicted")))
    out = summaries.micro_average(summaries.label_counts(both).select("tp", "fp", "fn"))
    return out.select("tp", "fp", "fn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""with r as ({book.RUNS}) select submission_type, count(*) as n, round(avg(bonus_pct), 1) as avg_bonus_pct, round(avg(critical_count), 1) as avg_critical, round(avg(high_count), 1) as avg_high, round(avg(warn_count), 1) as avg_warn, round(avg(pii_high_count), 1) as avg_pii_high, round(avg(parking_pass), 2) as parking_pass_rate
  from r where critical_count is not null and submission_type <> '' group by 1 having count(*) >= 2""")
def peer_stats(spark, folder):
    return history.peer_stats(rows(spark, folder, book.RUNS))


@query(f"""with f as ({book.FINDINGS}), g as (select *, case when seq in (2, 3) then 'CALC-00' || seq else rule_id end as r from f),
  m as (select doc_id, count(*) filter (status = 'fail' and severity = 'critical') as critical_count, count(*) filter (status = 'fail' and severity = 'high') as high_count, count(*) filter (status = 'warn') as warn_count, bool_and(status = 'pass') filter (r like 'CALC%') as pp from g group by 1),
  t as ({book.TABLES}), b as (select *, coalesce(nullif(base_floor_area, 0), nullif(bonus_limit, 0) * 2) as whole from t)
  select doc_id, critical_count, high_count, warn_count, pp::int as parking_pass, submission_type, case when bonus_floor_area <> 0 and whole > 0 then round(bonus_floor_area / whole * 100, 1) end as bonus_pct, (doc_id % 3)::bigint as pii_high_count from m join b using (doc_id)""")
def run_metrics(spark, folder):
    f = rows(spark, folder, book.FINDINGS).withColumn("rule_id", F.when(F.col("seq").isin(2, 3), F.concat(F.lit("CALC-00"), F.col("seq").cast("string"))).otherwise(F.col("rule_id")))
    t = rows(spark, folder, book.TABLES)
    pii = t.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("i"), F.lit("HIGH").alias("severity")).where("i > 0")
    return history.metrics(f, t, pii)


@query(f"""with r as ({book.RUNS}), n as (select *, row_number() over (partition by case_name order by id desc) = 1 as newest from r where case_name not ilike '%e2e_test%' and case_name not ilike '%api_test%')
  select id, case_name, case when newest and id % 2 = 0 then 'D' else submission_type end as submission_type, case when newest and id % 2 = 0 then 99 else critical_count end::int as critical_count from n""")
def run_update(spark, folder):
    kept = history.without_tests(rows(spark, folder, book.RUNS))
    new = kept.groupBy("case_name").agg(F.max("id").alias("id")).where("id % 2 = 0").select("case_name", F.lit("D").alias("submission_type"), F.lit(1.0).alias("bonus_pct"), *[F.lit(99).alias(c) for c in history.METRICS[2:]])
    return history.with_metrics(kept, new).select("id", "case_name", "submission_type", "critical_count")


@query(f"""with f as ({book.FINDINGS}), p as (select doc_id, seq, rule_id, case when doc_id % 3 = 0 then status when doc_id % 3 = 1 then 'pass' else 'warn' end as was from f where seq <> 5 and doc_id % 11 <> 0)
  select f.doc_id, f.rule_id, was as prev_status, f.status, case when was is null then 'new' when was in ('fail', 'warn') and status = 'pass' then 'improved' when was = 'pass' and status in ('fail', 'warn') then 'regressed' else 'changed' end as change
  from f left join p on p.doc_id = f.doc_id and p.rule_id = f.rule_id where f.doc_id % 11 <> 0 and (was is null or was <> f.status)""")
def finding_diff(spark, folder):
    now = rows(spark, folder, book.FINDINGS)
    was = F.when(F.col("doc_id") % 3 == 0, F.col("status")).when(F.col("doc_id") % 3 == 1, "pass").otherwise("warn")
    saved = history.encoded(now.where("seq <> 5 and doc_id % 11 <> 0").withColumn("status", was))
    return history.finding_diff(now, history.decoded(saved, ["doc_id"]), ["doc_id"]).select("doc_id", "rule_id", "prev_status", "status", "change")


HEADS = "select o_orderkey as doc_id, concat('案', cast(o_orderkey as string)) as case_name, case when o_orderkey % 4 <> 0 then '112年1月2日' end as report_date, '申請書' as report_date_source, cast(o_orderkey % 3 as int) as report_date_page, '111年版' as rule_version, '2024-01-02 03:04' as audit_time from orders"
SORT_SQL = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 9 end"


@query(f"""with f as ({book.FINDINGS}), h as ({HEADS}), i as (select *, row_number() over (partition by doc_id, status order by {SORT_SQL}, seq) as n from f),
  b as (select doc_id, status, string_agg(concat(n, '. 【', rule_id, '】', rule_name, chr(10), '　現況：', message, case when expected_calc is not null or computed_result is not null then concat(chr(10), '　核算：', concat_ws('；', expected_calc, computed_result)) else '' end, case when reference is not null then concat(chr(10), '　法源：', reference) else '' end, chr(10), '　建議：',
      case status when 'fail' then '請實施者修正後再送。' else '系統資料不足或需判讀，請承辦人工確認（非實施者違規）。' end), chr(10) order by n) as t, count(*) as n from i where status in ('fail', 'warn', 'pass') group by 1, 2)
  select h.doc_id, md5(concat('臺北市都市更新審議 自動審查意見', chr(10), '案名：', case_name, chr(10), case when report_date is not null then concat('報核日期：', report_date, '（來源：', report_date_source, case when report_date_page <> 0 then concat(' 第', report_date_page, '頁') else '' end, '）→ 適用 111年版') else '適用版次：111年版' end, chr(10), '審查時間：', audit_time, chr(10), chr(10),
    '一、應修正項目（必檢）', chr(10), coalesce(a.t, '　（無）'), chr(10), chr(10), '二、待人工核對項目（建議提醒）', chr(10), coalesce(w.t, '　（無）'), chr(10), chr(10), '三、通過項目：共 ', coalesce(p.n, 0), ' 項，符合規定，無需處理。')) as opinion
  from h left join b a on a.doc_id = h.doc_id and a.status = 'fail' left join b w on w.doc_id = h.doc_id and w.status = 'warn' left join b p on p.doc_id = h.doc_id and p.status = 'pass'""")
def opinion(spark, folder):
    return report.opinion(rows(spark, folder, book.FINDINGS), rows(spark, folder, HEADS)).withColumn("opinion", F.md5("opinion"))


LENGTHS = f"select distinct {book.DOC} as doc_id, 12 as total_pages from orders"


@query(f"""with f as ({book.FINDINGS}), p as (select *, try_cast(regexp_extract(evidence, '第 ([0-9]+) 頁', 1) as int) as page from f where status in ('fail', 'warn')), q as (select *, row_number() over (partition by doc_id, page order by seq) - 1 as n from p where page between 1 and 12)
  select doc_id, page, (6 + n * 30)::int as y0, (32 + n * 30)::int as y1, status, concat('[', rule_id, '] ', rule_name) as title, message as content from q""")
def annotations(spark, folder):
    return report.annotations(rows(spark, folder, book.FINDINGS), rows(spark, folder, LENGTHS)).drop("nth")


@query(f"""with f as ({book.FINDINGS}), p as (select distinct doc_id, try_cast(regexp_extract(evidence, '第 ([0-9]+) 頁', 1) as int) as page from f), q as (select *, row_number() over (partition by doc_id order by page) as n from p where page > 0) select doc_id, page from q where n <= 2 and page <= 12""")
def thumbnails(spark, folder):
    return report.thumbnails(rows(spark, folder, book.FINDINGS), rows(spark, folder, LENGTHS), 2)


ANSWERS = """select o_orderkey as id, concat('{"findings": [{"rule_id": "L1", "error_type": "', case o_orderkey % 3 when 0 then 'typo' when 1 then 'regulatory_violation' else 'odd' end, '", "severity": "', case o_orderkey % 2 when 0 then 'critical' else 'warning' end, '", "detected_text": "a", "reason": "b", "page_number": ', case o_orderkey % 5 when 0 then '"x"' else cast(o_orderkey % 9 as string) end, '},
  {"rule_id": "L2", "error_type": "typo", "severity": "warning", "reason": "no text"}]}') as answer from orders"""


@query("""with t as (select o_orderkey as k from orders) select k as id, case k % 3 when 0 then 'typo' else 'regulatory_violation' end as error_type, case k % 2 when 0 then 'critical' else 'warning' end as severity, (k % 9)::int as page_number from t where k % 3 < 2 and k % 5 <> 0 and not (k % 2 = 0 and k % 7 = 0)""")
def llm_findings(spark, folder):
    found = evidence.parsed_findings(rows(spark, folder, ANSWERS), ["id"])
    said = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 3, F.col("o_orderkey") % 7 != 0).alias("confirmed"))
    said = said.withColumn("confirmed", F.when(F.col("id") % 7 == 0, False).otherwise(F.col("confirmed")))
    return evidence.verified_findings(found, said, ["id"]).select("id", "error_type", "severity", "page_number")


@query("""with t as (select event_id as id, event_type as s, event_id % 3 = 0 as found, case when event_id % 2 = 0 then 'critical' else 'warning' end as severity, event_id % 5 < 2 as cited from events), v as (select *, severity = 'critical' and not found and cited as api from t)
  select id, case when api then 'citations_api' else 'offline' end as evidence_source, found or api as verified, case when api then 'c' else 'q' end as cited_text, concat_ws('|', concat('來源基準 ', s, '（0.50）'), case when found or api then '原文已核對（+0.20）' end, case when severity = 'critical' and not (found or api) or not (found or api) then '信心低於門檻 → 需人工複核' end) as factors from v""")
def evidence_grounding(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), (F.col("event_id") % 3 == 0).alias("found"), F.when(F.col("event_id") % 2 == 0, "critical").otherwise("warning").alias("severity"), F.lit("q").alias("quote"))
    cited = e.where("id % 5 < 2").select("id", F.lit("c").alias("cited_text"))
    out = evidence.grounded_evidence(e, cited, ["id"])
    value = F.lit(0.5) + F.when(F.col("verified"), 0.2).otherwise(0.0)
    listed = evidence.factors(F.col("source"), F.col("verified"), F.lit(False), value, F.col("severity") == "critical")
    return out.select("id", "evidence_source", "verified", "cited_text", F.array_join(listed, "|").alias("factors"))


#: Quotes of documents: with blanks put in, from elsewhere, too short, and none.
QUOTES = """select doc_id, cast(b.seq as int) as seq, case b.seq when 0 then concat(' ', substr(text, cast(1 + doc_id % 40 as int), 25), chr(10)) when 1 then concat('nowhere', cast(doc_id as string)) when 2 then substr(text, 1, 2) when 3 then replace(substr(text, 1, 60), ' ', '  ') end as quote,
  case when b.seq % 2 = 0 then 'warning' else 'critical' end as severity from documents, (values (0), (1), (2), (3), (4)) as b(seq)"""


@query(rf"""with q as ({QUOTES}), f as (select q.*, q.quote is not null and length(regexp_replace(q.quote, '^\s+|\s+$', '', 'g')) >= 3 as asked, regexp_replace(q.quote, '\s+', '', 'g') as n, regexp_replace(d.text, '\s+', '', 'g') as p from q join documents d using (doc_id)),
  g as (select *, asked and contains(p, n) as hit from f), e as (select *, severity = 'critical' and not hit and doc_id % 3 = 0 as api from g)
  select doc_id, seq, hit as found, case when hit then instr(p, n) - 1 end::int as start, case when hit then instr(p, n) - 1 + length(n) end::int as "end", case when api then 'citations_api' else 'offline' end as evidence_source, hit or api as verified, md5(case when api then 'cited' else quote end) as cited_text from e""")
def document_evidence(spark, folder):
    d = table(spark, folder, "documents")
    quotes = spark.sql(QUOTES.replace("from documents", "from {documents}"), documents=d)
    cited = quotes.where("doc_id % 3 = 0").select("doc_id", "seq", F.lit("cited").alias("cited_text"))
    out = evidence.evidence_of(quotes, d.select("doc_id", F.lit(1).alias("page_num"), "text"), cited, ["doc_id", "seq"])
    return out.select("doc_id", "seq", "found", "start", "end", "evidence_source", "verified", F.md5("cited_text").alias("cited_text"))


MODEL = """select o_orderkey as id, concat('{"bonus_items": [{"name": "a", "rate_pct": ', cast(o_orderkey % 30 as string), '}, {"name": "b", "rate_pct": "x"}, {"rate_pct": 3}], "bonus_total_pct": ', case when o_orderkey % 2 = 0 then 'null' else cast(o_orderkey % 50 as string) end, ', "consent_ratio": {"owner_count_pct": ', cast(o_orderkey % 100 as string), '}, "dates": {"application_date": "', case when o_orderkey % 3 = 0 then ' ' else ' 112 ' end, '"}}') as answer from orders"""


@query("""select o_orderkey as id, (o_orderkey % 30)::double as items, case when o_orderkey % 2 <> 0 then (o_orderkey % 50)::double end as total, (o_orderkey % 100)::double as owner_pct, case when o_orderkey % 3 <> 0 then '112' end as application_date from orders""")
def model_fields(spark, folder):
    out = evidence.extracted(rows(spark, folder, MODEL), ["id"])
    return out.select("id", F.aggregate("bonus_items", F.lit(0.0), lambda a, x: a + x["rate_pct"]).alias("items"), F.col("bonus_total_pct").alias("total"), "owner_pct", "application_date")


WIKI_FIELDS = "select distinct cast(year(o_orderdate) as int) as year, concat('f', cast(o_custkey % 50 as string)) as name, case when (year(o_orderdate) + o_custkey % 50) % 3 = 0 then 'new' else 'existing' end as status, 'n' as note from orders where (year(o_orderdate) + o_custkey % 50) % 4 <> 0"
WIKI_RULES = "select distinct cast(year(o_orderdate) as int) as year, concat('k', cast(o_custkey % 40 as string)) as key, case (year(o_orderdate) * 3 + o_custkey % 40) % 5 when 0 then '' when 1 then 'a' else 'b' end as formula from orders where (year(o_orderdate) + o_custkey % 40) % 7 <> 0"
WIKI_PARTS = "select distinct cast(year(o_orderdate) as int) as year, cast(case when year(o_orderdate) % 2 = 0 then 24 end as int) as appendices, cast(floor(year(o_orderdate) / 3) as int) as main_chapters from orders"
NEXT_SQL = "y as (select year, lag(year) over (order by year) as before from (select distinct year(o_orderdate)::int as year from orders)), z as (select * from y where before is not null)"


@query(f"""with f as ({WIKI_FIELDS}), {NEXT_SQL}, n as (select f.* from f join z using (year)), o as (select z.year, f.name, f.status from f join z on z.before = f.year)
  select year, name, o.status as old_status, n.status as new_status, case when o.name is null then 'added' when n.name is null then 'removed' else 'updated' end as change from n full join (select *, name as oname from o) o using (year, name) where n.status is distinct from o.status""".replace("when o.name is null", "when o.oname is null").replace("when n.name is null", "when n.note is null"))
def wiki_fields(spark, folder):
    f = rows(spark, folder, WIKI_FIELDS)
    return templates.field_changes(f, f.select("year")).select("year", "name", "old_status", "new_status", "change")


@query(f"""with r as ({WIKI_RULES}), {NEXT_SQL}, n as (select r.* from r join z using (year)), o as (select z.year, r.key, r.formula from r join z on z.before = r.year)
  select year, key, coalesce(o.formula, '') as prev, coalesce(n.formula, '') as curr from n full join o using (year, key) where coalesce(o.formula, '') <> coalesce(n.formula, '') and coalesce(n.formula, '') <> ''""")
def wiki_rules(spark, folder):
    r = rows(spark, folder, WIKI_RULES)
    return templates.rule_changes(r, rows(spark, folder, WIKI_FIELDS).select("year"))


@query(f"""with p as ({WIKI_PARTS}), w as (select *, lag(appendices) over (order by year) as a, lag(main_chapters) over (order by year) as m, lag(year) over (order by year) as b from p)
  select year, concat('附錄數量：', coalesce(a::varchar, 'None'), ' → ', coalesce(appendices::varchar, 'None')) as change from w where b is not null and a is distinct from appendices union all select year, concat('主文章數：', m, ' → ', main_chapters) from w where b is not null and m is distinct from main_chapters""")
def wiki_structure(spark, folder):
    return templates.structure_changes(rows(spark, folder, WIKI_PARTS)).drop("seq")


@query("""select o_orderkey as seq, year(o_orderdate)::int as year, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 3 else 9 end as impact_order from orders""")
def wiki_revisions(spark, folder):
    o = table(spark, folder, "orders")
    impact = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "major").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") != "5-LOW", "odd")
    return templates.revisions(o.select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("seq"), impact.alias("impact"))).select("seq", "year", "impact_order")


@query("""with t as (select o_orderkey as id, case when o_orderkey % 3 = 0 then 'a1b2c3d4_' else '' end || 'x_y.pdf' as f, case o_orderkey % 4 when 0 then '113年版' when 1 then null else '108年版' end as v, case when o_orderkey % 5 = 0 then 'LaTest.pdf' else 'a.pdf' end as n, case when o_orderkey % 7 = 0 then '測試' else 'TEST' end as c from orders)
  select id, 'x y.pdf' as shown, case when v is null then '111' else left(v, 3) end as reg_year, n = 'LaTest.pdf' or c = '測試' as is_test from t""")
def names(spark, folder):
    k = F.col("o_orderkey")
    t = table(spark, folder, "orders").select(k.alias("id"), F.concat(F.when(k % 3 == 0, "a1b2c3d4_").otherwise(""), F.lit("x_y.pdf")).alias("f"), F.when(k % 4 == 0, "113年版").when(k % 4 > 1, "108年版").alias("v"), F.when(k % 5 == 0, "LaTest.pdf").otherwise("a.pdf").alias("n"), F.when(k % 7 == 0, "測試").otherwise("TEST").alias("c"))
    return t.select("id", history.display_name(F.col("f")).alias("shown"), history.reg_year(F.col("v")).alias("reg_year"), history.is_test(F.col("n"), F.col("c")).alias("is_test"))


CASES = "select cast(o_orderkey as string) as meta_id, o_orderpriority as case_name, cast(o_orderdate as string) as uploaded_at from orders"


@query("select o_orderkey::varchar as meta_id, o_orderpriority as case_name from orders order by o_orderdate desc, o_orderkey::varchar limit 50")
def newest_cases(spark, folder):
    return history.newest_cases(rows(spark, folder, CASES)).select("meta_id", "case_name")


MARKDOWN = """select o_orderkey as id, concat(case when o_orderkey % 2 = 0 then concat('前言 ', cast(o_orderkey as string), chr(10)) else '' end, '# A', cast(o_orderkey as string), chr(10), 'x', chr(10), case when o_orderkey % 3 = 0 then '' else concat('## B ', chr(10)) end, '### C', chr(10), '#### 非標題', chr(10), '## D', chr(10), 'y  ', chr(10), '# E') as text from orders"""


@query("""with t as (select o_orderkey as id from orders), c as (select id, 0 as n, '' as section_title, null::varchar as parent_title, concat('前言 ', id) as text from t where id % 2 = 0 union all select id, 1, concat('A', id), null, concat('# A', id, chr(10), 'x') from t union all select id, 2, 'B', concat('A', id), '## B' from t where id % 3 <> 0
    union all select id, 3, 'C', case when id % 3 <> 0 then 'B' else concat('A', id) end, concat('### C', chr(10), '#### 非標題') from t union all select id, 4, 'D', concat('A', id), concat('## D', chr(10), 'y') from t union all select id, 5, 'E', null, '# E' from t)
  select id, section_title, parent_title, text, length(text)::int as char_count from c""")
def chunks(spark, folder):
    return summaries.chunks(rows(spark, folder, MARKDOWN), "id", "text").drop("chunk_no")


@query(f"""with r as ({book.RUNS}), k as (select *, count(*) over (partition by case_name) as n from r where not (case_name ilike '%e2e_test%' or case_name ilike '%api_test%')), c as (select * from k qualify row_number() over (partition by case_name order by id desc) = 1)
  select case_name, (n + case when id % 2 = 0 then 1 else 0 end)::bigint as n_runs, (n + case when id % 2 = 0 then 1 else 0 end)::bigint as n_ids, case when id % 2 = 0 then 77 else critical_count end::int as critical_count, case when id % 2 = 0 then 'D' else submission_type end as submission_type, id % 2 = 0 as later from c""")
def run_store(spark, folder):
    """A history that is saved, added to, changed in place and read again."""
    path = f"{shared.folder(spark)}/run-store-{uuid.uuid4().hex}"
    runs = rows(spark, folder, book.RUNS)
    store.save(runs, path)
    store.clear_tests(spark, path)
    again = store.read(spark, path)
    newer = again.groupBy("case_name").agg(F.max("id").alias("last")).where("last % 2 = 0").select("case_name")
    most = again.agg(F.max("id")).first()[0]
    store.save(newer.withColumn("submission_type", F.lit("A-1")), path)
    store.update(newer.select("case_name", F.lit("D").alias("submission_type"), F.lit(1.5).alias("bonus_pct"), *[F.lit(77).alias(c) for c in history.METRICS[2:]]), path)
    out = store.read(spark, path).groupBy("case_name").agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("id").alias("n_ids"), F.max_by("critical_count", "id").alias("critical_count"), F.max_by("submission_type", "id").alias("submission_type"), F.max("id").alias("id"))
    return out.select("case_name", "n_runs", "n_ids", "critical_count", "submission_type", (F.col("id") > most).alias("later"))
