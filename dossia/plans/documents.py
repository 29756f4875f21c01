"""Registered queries over audit-shaped pages: front documents, review tables, dates, scans and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossia.functions import dates, scalars
from dossia.operators import front_docs as fronts
from dossia.operators import pages as paging
from dossia.operators import report, review_table, rules, scans
from dossia.plans import book
from dossia.plans.book import query, rows

P = f"p as ({book.PAGES})"


def pages(spark, folder):
    return rows(spark, folder, book.PAGES).drop("k")


FRONT_SQL = f"""{P}, m as (select *, contains(text, '目 錄') as toc, case when contains(text, '都市更新事業計畫申請書') and contains(text, '申請人') then '申請書' when contains(text, '切結書') then '切結書'
    when (contains(text, '委託書') or contains(text, '委  託  書')) and contains(text, '茲委託') then '委託書' when contains(text, '都市更新審議資料表') then '審議資料表' end as dt from p),
  c as (select doc_id, page_num as page, 1 as j, dt as doc_type, case when dt = '委託書' then case when contains(text, '都市更新規劃') then '都更規劃' when contains(text, '建築師') then '建築設計' when contains(text, '地政士') then '地政業務' end end as purpose, false as from_toc, text
    from m where not toc and page_num <= 20 and dt is not null),
  l as (select doc_id, page_num as page, j, name as doc_type, null::varchar as purpose, true as from_toc, '' as text from m, (values (0, '申請書', '都市更新事業計畫申請書'), (1, '切結書', '切結書'), (2, '委託書', '委託書')) t(j, name, w) where toc and contains(text, w)),
  u as (select * from c union all select * from l where not exists (select 1 from c where c.doc_id = l.doc_id and c.doc_type = l.doc_type and c.page < l.page)),
  docs as (select doc_id, (row_number() over (partition by doc_id order by page, j) - 1)::int as seq, doc_type, page, purpose, from_toc, text from u)"""


@query(f"with {FRONT_SQL} select doc_id, seq, doc_type, page, purpose, from_toc from docs")
def front_docs(spark, folder):
    return fronts.front_docs(pages(spark, folder))


#: A date in text as `Y年M月D日`, if its parts are in range, by RE2.
def sql_date(text: str, pattern: str, flag: str = "") -> str:
    part = lambda k: f"try_cast(regexp_replace(regexp_extract({text}, '{pattern}', {k}), '\\s+', '', 'g') as int)"
    y, m, d = part(1), part(2), part(3)
    return f"case when {y} between 100 and 130 and {m} between 1 and 12 and {d} between 1 and 31 then concat({y}, '年', {m}, '月', {d}, '日') end"


SPACED = r"(?:中\s*華\s*民\s*國\s*)?((?:\d\s*){2,4})年\s*((?:\d\s*){1,2})月\s*((?:\d\s*){1,2})日"
SUMMARY_SQL = f"""{FRONT_SQL}, dated as (select doc_id, doc_type, page, {sql_date('text', SPACED)} as date from docs where not from_toc and doc_type in ('申請書', '切結書', '委託書')),
  best as (select * from dated where date is not null qualify row_number() over (partition by doc_id order by case doc_type when '申請書' then 0 when '切結書' then 1 else 2 end, page) = 1),
  near as (select doc_id, page_num, {sql_date('text', r'(\d{3})\.(\d{2})\.(\d{2})')} as date from m where not toc and (dt is null or page_num > 20) and contains(text, '報核 ')),
  nears as (select * from near where date is not null qualify row_number() over (partition by doc_id order by page_num) = 1),
  coded as (select doc_id, page_num, {sql_date('text', r'報核[^\n]*字第(\d{3})(\d{2})(\d{2})\d+\s*號')} as date, concat('申請書文號（', regexp_extract(text, '(\\S{{2,8}}更新會)字第', 1), '字第', regexp_extract(text, '字第(\\d+)', 1), '號）') as source from m),
  codeds as (select * from coded where date is not null qualify row_number() over (partition by doc_id order by page_num) = 1),
  ids as (select distinct doc_id from p),
  s as (select i.doc_id, coalesce(b.date, n.date, q.date) as report_date, b.page as report_date_page, case when b.date is not null then b.doc_type when n.date is not null then '補正回應（謄本日期）' else q.source end as report_date_source
    from ids i left join best b using (doc_id) left join nears n using (doc_id) left join codeds q using (doc_id)),
  f as (select doc_id, count(*) filter (doc_type = '委託書') as poa_count, bool_or(doc_type = '申請書') as a, bool_or(doc_type = '切結書') as b, bool_or(doc_type = '審議資料表') as t,
    string_agg(case when doc_type = '委託書' then coalesce(purpose, '用途未識別') end, '、' order by seq) as purposes from docs group by 1)"""


@query(f"""with {SUMMARY_SQL} select doc_id, coalesce(poa_count, 0) as poa_count, coalesce(purposes, '') as purposes, coalesce(a, false) as has_application, coalesce(b, false) as has_affidavit, coalesce(t, false) as has_review_table, report_date, report_date_page, report_date_source
  from s left join f using (doc_id)""")
def front_summary(spark, folder):
    out = fronts.summary(pages(spark, folder))
    return out.select("doc_id", "poa_count", F.array_join("purposes", "、").alias("purposes"), "has_application", "has_affidavit", "has_review_table", "report_date", "report_date_page", "report_date_source")


@query(f"""with {SUMMARY_SQL}, loc as (select doc_id, doc_type, page, from_toc from docs qualify row_number() over (partition by doc_id, doc_type order by from_toc, seq) = 1),
  e as (select doc_id, doc_type, concat('第 ', page, ' 頁', case when from_toc then '（目錄列出，實際頁面待人工核對）' else '' end) as ev from loc)
  select s.doc_id, t.rule_id, case when ev is not null then 'pass' else 'fail' end as status, case when ev is not null then case when t.rule_id = 'DOC-003' then purposes else ev end end as evidence
  from s cross join (values ('DOC-001', '申請書'), ('DOC-002', '切結書'), ('DOC-003', '委託書'), ('DOC-004', '審議資料表')) t(rule_id, dt) left join e on e.doc_id = s.doc_id and e.doc_type = t.dt left join f on f.doc_id = s.doc_id""")
def doc_rules(spark, folder):
    front = fronts.summary(pages(spark, folder))
    struct = F.struct("poa_count", "purposes", "has_application", "has_affidavit", "has_review_table", "at").cast(rules.INPUT["front"])
    found = rules.evaluate(front.select("doc_id", struct.alias("front"), F.lit(False).alias("has_table")), ["doc_id"], rules=[rules.application_rule, rules.affidavit_rule, rules.poa_rule, rules.table_rule])
    return found.select("doc_id", "rule_id", "status", "evidence")


PAGE_SQL = f"""{P}, g as (select doc_id, page_num, case when text = '' then coalesce(read, '') else text end as t, text = '' as image from p where page_num <= 30),
  r as (select *, case when not image and contains(t, '都市更新審議資料表') and contains(t, '填表日期') and contains(t, '送審類別') then 0 when image and contains(t, '都市更新審議資料表') and contains(t, '送審類別') then 1
    when image and contains(t, '填表耳期') then 2 end as rank from g), found as (select doc_id, page_num, t as text from r where rank is not null qualify row_number() over (partition by doc_id order by rank, rank = 2 and not contains(t, '停車位'), page_num) = 1)"""


@query(f"with {PAGE_SQL} select doc_id, page_num, md5(text) as text from found")
def table_page(spark, folder):
    return review_table.table_page(pages(spark, folder)).withColumn("text", F.md5("text"))


def sql_group(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '{pattern}', 1), '')"


FIELDS_SQL = f"""{PAGE_SQL}, fields as (select doc_id, {sql_group('計畫名稱：(.{10,120}?)（請勾選）')} as case_name, {sql_group('實施者：([^\\n]*有限公司)')} as implementer, {sql_group('統一編號：([0-9]{8})')} as implementer_id,
    case when contains(text, '■B-1') then 'B-1' when contains(text, '■B-2') then 'B-2' end as submission_type, {sql_group('填表日期：中華民國([0-9]+年[0-9]+月[0-9]+日)')} as fill_date,
    try_cast(replace({sql_group('基準容積 ([0-9,.]+) m')}, ',', '') as double) as base_floor_area, try_cast({sql_group('合計獎勵樓地板面積 ([0-9.]+)')} as double) as bonus_floor_area, try_cast({sql_group('容積獎勵上限 ([0-9.]+)')} as double) as bonus_limit,
    try_cast({sql_group('土地所有權人同意 ([0-9.]+)%')} as double) as owner_consent_ratio, try_cast({sql_group('法定汽車停車位.([0-9]+)輛'.replace('.(', '\\s('))} as int) as legal_parking,
    try_cast({sql_group('實設汽車停車位 ([0-9]+) 輛')} as int) as actual_parking, try_cast({sql_group('無障礙([0-9]+)輛')} as int) as accessible_parking, try_cast({sql_group('充電([0-9]+)輛')} as int) as ev_parking, page_num as raw_page,
    {sql_date('text', r'報核 (\d{3})\.(\d{2})\.(\d{2})')} as report_filing_date from found)"""


@query(f"with {FIELDS_SQL} select * from fields")
def review_fields(spark, folder):
    return review_table.parsed(review_table.table_page(pages(spark, folder))).drop("land_area", "actual_parking_detail")


LINES = f"""select o_orderkey as id, concat('報核 102.04.30', chr(10), case when o_orderkey % 4 = 0 then '公聽會 ' else '報核 ' end, {book.DOTTED}, chr(10), '空', chr(10), case when o_orderkey % 5 = 0 then '字第11311140047號' else '公開展覽 113.01.15' end,
  case when o_orderkey % 7 = 0 then concat(chr(10), '報核版', chr(10), {book.DATE}) else '' end) as text from orders"""


@query(f"""with t as ({LINES}), n as (select id, 105 + id % 29 as y, 1 + id % 12 as m, 1 + id % 28 as d from t), c as (
    select id, '1020430' as key, '102年4月30日' as shown from n union all select id, format('{{:03d}}{{:02d}}{{:02d}}', y, m, d), concat(y, '年', m, '月', d, '日') from n where (id % 4 <> 0 or id % 7 = 0) and y <= 130
    union all select id, '1131114', '113年11月14日' from n where id % 5 = 0) select id, max_by(shown, key) as filing_date from c group by 1""")
def filing_date(spark, folder):
    return rows(spark, folder, LINES).select("id", dates.filing_date(F.col("text")).alias("filing_date"))


WRITTEN = f"""select o_orderkey as id, 105 + o_orderkey % 29 as y, 1 + o_orderkey % 14 as m, 1 + o_orderkey % 33 as d,
  concat('中 華 民 國 1 ', cast(o_orderkey % 4 as string), ' 5 年 ', cast(1 + o_orderkey % 14 as string), ' 月 0 ', cast(o_orderkey % 10 as string), ' 日') as spaced,
  concat(case o_orderkey % 3 when 0 then '' when 1 then 'x_' else 'x' end, cast(105 + o_orderkey % 29 as string), lpad(cast(1 + o_orderkey % 14 as string), 2, '0'), lpad(cast(1 + o_orderkey % 33 as string), 2, '0'), '【案】') as filename from orders"""


@query(f"""with t as ({WRITTEN}) select id, case when id % 4 < 4 and 105 + 10 * (id % 4) between 100 and 130 and m <= 12 and id % 10 > 0 then concat(105 + 10 * (id % 4), '年', m, '月', id % 10, '日') end as strict,
  case when id % 3 < 2 and y <= 130 and m <= 12 and d <= 31 then concat(y, '年', m, '月', d, '日') end as of_file, format('{{:04d}}-{{:02d}}-{{:02d}}', y + 1911, m, d) as iso from t""")
def written_dates(spark, folder):
    iso = dates.iso_date(F.format_string("%d年%d月%d日", "y", "m", "d"))
    return rows(spark, folder, WRITTEN).select("id", dates.strict_date(F.col("spaced")).alias("strict"), dates.file_date(F.col("filename")).alias("of_file"), iso.alias("iso"))




def money(c: str) -> str:
    return f"format('{{:,.2f}}', {c})"


@query(f"""with t as (select *, coalesce(bonus_limit, base_floor_area * 0.5) as top, concat('審議資料表第 ', raw_page, ' 頁') as pg, case when legal_parking <= 0 then 0 when legal_parking <= 50 then 1 when legal_parking <= 300 then 1 + ceil((legal_parking - 50) / 50.0) else 6 + ceil((legal_parking - 300) / 100.0) end::int as need from ({book.TABLES})),
  b as (select *, coalesce(nullif(base_floor_area, 0), top * 2) as base, abs(bonus_limit - base_floor_area * 0.5) as off from t), n as (select *, format('{{:.1f}}', case when base > 0 then bonus_floor_area / base * 100 else 0 end) as pc from b)
  select doc_id, 'CALC-001' as rule_id, case when not has_table then '審議資料表未能解析' when bonus_floor_area is null or top is null then '容積獎勵申請額度或上限無法從審議資料表解析，請人工核對' when bonus_floor_area > top + 0.1 then concat('申請額 ', {money('bonus_floor_area')}, 'm² 超過上限 ', {money('top')}, 'm²，差距 ', {money('bonus_floor_area - top')}, 'm²，獎勵比率 ', pc, '%')
      else concat('容積獎勵 ', {money('bonus_floor_area')}, 'm² ≤ 上限 ', {money('top')}, 'm²') end as message, case when has_table then pg end as evidence,
    case when has_table and bonus_floor_area is not null and top is not null then concat('基準容積 ', {money('base')}, ' × 50% = 上限 ', {money('top')}, ' m²', case when bonus_limit is null then '（依基準×50%推算）' else '' end, '（都更條例第65條）') end as expected_calc from n
  union all select doc_id, 'CALC-002', case when not has_table then '審議資料表未能解析' when accessible_parking is null then '無障礙停車位欄位無法從審議資料表解析，請人工確認' when legal_parking > 0 and accessible_parking < need then concat('法定(含無障礙)汽車停車位 ', legal_parking, ' 輛，依建築技術規則應設 ', need, ' 輛無障礙停車位，但填寫為 ', accessible_parking, ' 輛')
      when legal_parking > 0 then concat('無障礙停車位 ', accessible_parking, ' 輛 ≥ 法定要求 ', need, ' 輛（法定停車 ', legal_parking, ' 輛）') when legal_parking is null then concat('無障礙停車位 ', accessible_parking, ' 輛') else concat('無障礙停車位 ', accessible_parking, ' 輛（法定 ', legal_parking, ' 輛）') end,
    case when has_table then pg end, case when has_table and accessible_parking is not null and legal_parking > 0 then concat('法定停車 ', legal_parking, ' 輛 → 依建築技術規則§167-6 應設 ', need, ' 輛') end from n
  union all select doc_id, 'CALC-003', case when not has_table then '審議資料表未能解析' when legal_parking is null or actual_parking is null then '實設或法定(含無障礙)汽車停車位資料不足，建議人工確認' when actual_parking < legal_parking then concat('實設汽車停車位 ', actual_parking, ' 輛低於法定要求 ', legal_parking, ' 輛，差距 ', legal_parking - actual_parking, ' 輛')
      else concat('實設 ', actual_parking, ' 輛 ≥ 法定 ', legal_parking, ' 輛') end, case when has_table and legal_parking is not null and actual_parking is not null then pg end, case when has_table and legal_parking is not null and actual_parking is not null then concat('法定(含無障礙)汽車停車位 ', legal_parking, ' 輛（建築技術規則第59條）') end from n
  union all select doc_id, 'CALC-004', case when not has_table then '審議資料表未能解析' when off is null then '基準樓地板面積或容積獎勵上限資料不足，建議人工確認' when off > 2 then concat('容積獎勵上限 ', {money('bonus_limit')}, 'm² 與計算值 ', {money('base_floor_area * 0.5')}, 'm² （基準 ', {money('base_floor_area')}, 'm² × 50%）差距 ', format('{{:.2f}}', off), 'm²，超過允許誤差')
      else concat('容積獎勵上限 ', {money('bonus_limit')}, 'm² 與計算值一致（', {money('base_floor_area')}, 'm² × 50% = ', {money('base_floor_area * 0.5')}, 'm²）') end, case when has_table and off is not null then pg end, case when has_table and off is not null then concat('基準容積 ', {money('base_floor_area')}, ' × 50% = ', {money('base_floor_area * 0.5')}, ' m²（都更條例第65條）') end from n
  union all select doc_id, 'FORM-001', case when not has_table then '審議資料表未能解析' when submission_type in ('A-1', 'B-1', 'B-2', 'C', 'D') then concat('送審類別：', submission_type) else '送審類別未能從審議資料表識別，請人工確認' end, null, null from n
  union all select doc_id, 'FORM-003', case when not has_table then '審議資料表未能解析' when ev_parking is not null then concat('充電車位欄位已填寫：', ev_parking, ' 輛') else '充電車位欄位未在審議資料表中找到，可能使用舊版格式' end, case when has_table then pg end, null from n""")
def table_findings(spark, folder):
    own = [rules.type_rule, rules.bonus_rule, rules.accessible_rule, rules.parking_rule, rules.limit_rule, rules.ev_rule]
    return rules.evaluate(rows(spark, folder, book.TABLES), ["doc_id"], rules=own).select("doc_id", "rule_id", "message", "evidence", "expected_calc")


#: The three scans of body pages in SQL: personal data, terms and numbers, with order.
SCAN_SQL = f"""{P}, b as (select * from p where text <> '' and (k + 3 * cast(floor(k / 8) as bigint)) % 8 = 7),
  pii as (select doc_id, page_num as page, 1 as seq, 'phone' as risk_type, 'MEDIUM' as severity, concat('(02)2345-', lpad((k % 10000)::varchar, 4, '0')) as value from b union all select doc_id, page_num, 2, 'phone', 'MEDIUM', concat('0912-345-', lpad((k % 1000)::varchar, 3, '0')) from b
    union all select doc_id, page_num, 3, 'residential_address', 'HIGH', concat('巷12弄', k % 9, '號') from b where k % 3 = 0 union all select doc_id, page_num, 4, 'id_number', 'HIGH', concat('A12345', lpad((k % 10000)::varchar, 4, '0')) from b where k % 3 = 0),
  terms as (select doc_id, page_num as page, 1 as seq, '計劃書' as wrong_term, '計畫書' as correct_term from b union all select doc_id, page_num, 2, '更新單位', '更新單元' from b union all select doc_id, page_num, 3, '審儀', '審議' from b where k % 2 = 0)"""


def body_pages(spark, folder):
    """Pages of one kind: running text."""
    return pages(spark, folder).where(F.contains("text", F.lit("本案計劃書"))).withColumn("page", F.col("page_num"))


@query(f"with {SCAN_SQL} select doc_id, page, risk_type, severity, value from pii")
def page_pii(spark, folder):
    return scans.pii(body_pages(spark, folder), ["doc_id", "page"], "text").select("doc_id", "page", "risk_type", "severity", "value")


@query(f"""with {SCAN_SQL}, c as (select p.*, b.text, instr(b.text, p.value) as a, case when risk_type = 'residential_address' then 40 else 25 end as w from pii p join b on b.doc_id = p.doc_id and b.page_num = p.page)
  select doc_id, page, value, trim(replace(substr(text, greatest(1, a - w), a + length(value) + w - greatest(1, a - w)), chr(10), ' ')) as context from c""")
def pii_context(spark, folder):
    return scans.pii(body_pages(spark, folder), ["doc_id", "page"], "text").select("doc_id", "page", "value", "context")


@query(f"""with {SCAN_SQL}, c as (select t.*, b.text, instr(b.text, wrong_term) as a from terms t join b on b.doc_id = t.doc_id and b.page_num = t.page)
  select doc_id, page, wrong_term, correct_term, a::int as "at", trim(replace(substr(text, greatest(1, a - 30), a + length(wrong_term) + 30 - greatest(1, a - 30)), chr(10), ' ')) as context from c""")
def page_terms(spark, folder):
    return scans.terms(body_pages(spark, folder), ["doc_id", "page"], "text").drop("seq")


NUMBER_TAIL = """n as (select doc_id, page_num as page, text from p), nf as (select doc_id, page, 'accessible_parking' as field, unnest(regexp_extract_all(text, '無障礙[停車位\\s（(]*(\\d+)\\s*輛', 1)) as v from n
    union all select doc_id, page, 'legal_parking', unnest(regexp_extract_all(text, '法定[汽車]*停車位[^\\n]*\\n?(\\d+)\\s*輛', 1)) from n union all select doc_id, page, 'bonus_floor_area', unnest(regexp_extract_all(text, '合計獎勵樓地板面積[^\\d]*(\\d[\\d,，.]+)', 1)) from n
    union all select doc_id, page, 'ev_parking', unnest(regexp_extract_all(text, '充電(\\d+)輛', 1)) from n), numbers as (select doc_id, page, field, try_cast(replace(v, ',', '') as double) as value from nf)"""
NUMBER_SQL = f"{P}, {NUMBER_TAIL}"


@query(f"with {NUMBER_SQL} select * from numbers where value is not null")
def number_contexts(spark, folder):
    return scans.numbers(pages(spark, folder).withColumn("page", F.col("page_num")), ["doc_id", "page"], "text").select("doc_id", "page", "field", "value")


@query(f"""with {SCAN_SQL}, ids as (select distinct doc_id from p), hi as (select doc_id, count(*) as n, string_agg(concat('P.', page, ' ', risk_type, '：', value), '; ' order by page, seq) as ev from pii where severity = 'HIGH' group by 1),
  mid as (select doc_id, count(*) as n, string_agg(concat('P.', page, ' ', risk_type, '：', value), '; ' order by page, seq) as ev from pii where severity = 'MEDIUM' group by 1),
  tm as (select doc_id, count(*) as n, string_agg(concat('P.', page, '「', wrong_term, '」應為「', correct_term, '」'), '; ' order by page, seq) as ev from terms group by 1)
  select doc_id, 'PII-001' as rule_id, case when hi.n > 0 then 'fail' when mid.n > 0 then 'warn' else 'pass' end as status, case when hi.n > 0 then concat('偵測到 ', hi.n, ' 處高風險個資（住宅地址/身分證號），上傳雲端版本必須遮蔽')
      when mid.n > 0 then concat('偵測到 ', mid.n, ' 處中風險個資（電話號碼），建議確認上傳版本是否需要遮蔽') else '封面文件未偵測到個資風險' end as message, coalesce(hi.ev, mid.ev) as evidence from ids left join hi using (doc_id) left join mid using (doc_id)
  union all select doc_id, 'TERM-001', case when n > 0 then 'fail' else 'pass' end, case when n > 0 then concat('發現 ', n, ' 處用詞錯誤，請核對後修正') else '未偵測到法定用詞錯誤' end, ev from ids left join tm using (doc_id)""")
def text_findings(spark, folder):
    from dossia.operators.audit import gathered

    body, ids = body_pages(spark, folder), pages(spark, folder).select("doc_id").distinct()
    out = ids.join(gathered(scans.pii(body, ["doc_id", "page"], "text"), "pii", ["page", "seq"], ["page", "risk_type", "value", "severity"]), "doc_id", "left")
    out = out.join(gathered(scans.terms(body, ["doc_id", "page"], "text"), "terms", ["page", "seq"], ["page", "wrong_term", "correct_term"]), "doc_id", "left")
    return rules.evaluate(out, ["doc_id"], rules=[rules.pii_rule, rules.term_rule]).select("doc_id", "rule_id", "status", "message", "evidence")


@query(f"""with {FIELDS_SQL}, {NUMBER_TAIL},
  w as (select doc_id, n.page, n.field, n.value, case n.field when 'accessible_parking' then accessible_parking when 'legal_parking' then legal_parking when 'ev_parking' then ev_parking end as want_i, bonus_floor_area as want_f from numbers n join fields using (doc_id) where n.value is not null),
  o as (select *, concat(case field when 'accessible_parking' then '無障礙停車位' when 'legal_parking' then '法定(含無障礙)汽車停車位' when 'ev_parking' then '充電車位' else '容積獎勵面積' end, '：審議資料表=', case when field = 'bonus_floor_area' then want_f::varchar else want_i::varchar end, '，P.', page, '=', value) as line
    from w where abs(value - case when field = 'bonus_floor_area' then want_f else want_i end) > 0.1),
  oo as (select doc_id, count(*) as n, string_agg(line, '; ' order by page, case field when 'accessible_parking' then 0 when 'legal_parking' then 1 when 'bonus_floor_area' then 2 else 3 end) as ev from o group by 1), any_ as (select distinct doc_id from w), ids as (select distinct doc_id from p)
  select ids.doc_id, case when fields.doc_id is null then 'skip' when any_.doc_id is null then 'warn' when oo.n > 0 then 'fail' else 'pass' end as status, oo.ev as evidence from ids left join fields using (doc_id) left join any_ using (doc_id) left join oo using (doc_id)""")
def number_findings(spark, folder):
    from dossia.operators.audit import gathered

    all_ = pages(spark, folder)
    fields = review_table.parsed(review_table.table_page(all_)).withColumn("has_table", F.lit(True))
    found = scans.numbers(all_.withColumn("page", F.col("page_num")), ["doc_id", "page"], "text")
    out = all_.select("doc_id").distinct().join(fields, "doc_id", "left").join(gathered(found, "numbers", ["page", "seq"], ["page", "field", "value"]), "doc_id", "left")
    return rules.evaluate(out.withColumn("has_table", F.coalesce("has_table", F.lit(False))), ["doc_id"], rules=[rules.number_rule]).select("doc_id", "status", "evidence")


PLAYBOOK = [
    {"rule_id": "PB-1", "rule_name": "充電欄位", "type": "review_field_present", "field": "ev_parking"},
    {"rule_id": "PB-2", "rule_name": "上限公式", "type": "formula_check", "target": "bonus_limit", "ref_field": "base_floor_area", "factor": 0.5},
    {"rule_id": "PB-3", "rule_name": "不逾上限", "type": "threshold", "field": "bonus_floor_area", "op": "<=", "ref_field": "bonus_limit"},
    {"rule_id": "PB-4", "rule_name": "車位", "type": "threshold", "field": "legal_parking", "op": ">=", "value": 30},
    {"rule_id": "PB-5", "rule_name": "怪", "type": "threshold", "field": "legal_parking", "op": "~", "value": 1},
    {"rule_id": "PB-6", "rule_name": "格式", "type": "text_format"},
    {"rule_id": "PB-7", "rule_name": "草稿", "type": "threshold", "field": "legal_parking", "op": ">=", "value": 30, "enabled": False},
]


@query(f"""with t as ({book.TABLES}) select doc_id, 'PB-1' as rule_id, case when not has_table then 'skip' when ev_parking is not null then 'pass' else 'fail' end as status, case when not has_table then '審議資料表未解析' when ev_parking is not null then concat('充電欄位：已具備（值 = ', ev_parking, '）') else '充電欄位：缺欄位或未讀到' end as message from t
  union all select doc_id, 'PB-2', case when not has_table or bonus_limit is null or base_floor_area is null then 'skip' when abs(bonus_limit - base_floor_area * 0.5) <= greatest(0.01, abs(base_floor_area * 0.5) * 0.01) then 'pass' else 'fail' end,
    case when not has_table then '審議資料表未解析' when bonus_limit is null or base_floor_area is null then '缺數值：bonus_limit 或 base_floor_area' when abs(bonus_limit - base_floor_area * 0.5) <= greatest(0.01, abs(base_floor_area * 0.5) * 0.01) then '上限公式：相符' else concat('上限公式：不符（申報 ', format('{{:g}}', bonus_limit), '，應為 ', format('{{:g}}', base_floor_area * 0.5), '）') end from t
  union all select doc_id, 'PB-3', case when not has_table or bonus_floor_area is null or bonus_limit is null then 'skip' when bonus_floor_area <= bonus_limit then 'pass' else 'fail' end,
    case when not has_table then '審議資料表未解析' when bonus_floor_area is null then '缺數值：bonus_floor_area' when bonus_limit is null then '缺對照值：bonus_limit' when bonus_floor_area <= bonus_limit then '不逾上限：符合' else concat('不逾上限：不符（', format('{{:g}}', bonus_floor_area), ' 未 <= ', format('{{:g}}', bonus_limit), '）') end from t
  union all select doc_id, 'PB-4', case when not has_table or legal_parking is null then 'skip' when legal_parking >= 30 then 'pass' else 'fail' end, case when not has_table then '審議資料表未解析' when legal_parking is null then '缺數值：legal_parking' when legal_parking >= 30 then '車位：符合' else concat('車位：不符（', legal_parking, ' 未 >= 30）') end from t
  union all select doc_id, 'PB-5', 'skip', case when not has_table then '審議資料表未解析' when legal_parking is null then '缺數值：legal_parking' else '未支援運算子：~' end from t
  union all select doc_id, 'PB-6', 'skip', '規則型別「text_format」尚未支援（待 extractor/實作）' from t union all select doc_id, 'PB-7', 'skip', '草稿規則（待承辦複核／extractor 支援）：' from t""")
def playbook_findings(spark, folder):
    return rules.evaluate(rows(spark, folder, book.TABLES), ["doc_id"], PLAYBOOK, [], drafts=True).select("doc_id", "rule_id", "status", "message")


@query(f"""with {P}, d as (select doc_id, string_agg(coalesce(text, ''), chr(10) order by page_num) as t from p where page_num <= 20 group by 1), a as (select doc_id, case when trim(replace(t, chr(10), ' ')) <> '' then list_filter([case when contains(t, '實施者證明') then '實施者證明文件' end, case when contains(t, '土地權屬清冊') then '更新單元土地權屬清冊' end, case when contains(t, '公聽會') then '公辦公聽會相關資料' end, case when contains(t, '聽證') then '聽證相關資料' end], lambda x: x is not null) end as a from d)
  select doc_id, coalesce(array_to_string(a, ','), '-') as attachments, case when a is null then 'skip' when list_contains(a, '實施者證明文件') then 'pass' else 'fail' end as status from a""")
def attachment_findings(spark, folder):
    found = scans.attachments(pages(spark, folder))
    spec = [{"rule_id": "PB-A", "rule_name": "附錄一", "type": "attachment_present", "attachment": "實施者證明文件"}]
    return rules.evaluate(found, ["doc_id", "attachments"], spec, []).select("doc_id", F.coalesce(F.array_join("attachments", ","), F.lit("-")).alias("attachments"), "status")


@query(f"""with {P}, t as (select doc_id, page_num, text, read, k from p) select doc_id, page_num, case when length(trim(text)) >= 20 then 'text' when read is not null and k % 2 = 0 then 'vlm' when read is not null then 'ocr' when trim(text) <> '' then 'text' else 'empty' end as source,
  md5(case when length(trim(text)) >= 20 then text when read is not null then read else text end) as text from t""")
def routed_pages(spark, folder):
    all_ = rows(spark, folder, book.PAGES)
    readers = [all_.where(F.col("read").isNotNull() & (F.col("k") % 2 == r)).select("doc_id", "page_num", F.col("read").alias("text")) for r in (0, 1)]
    return paging.routed(all_.select("doc_id", "page_num", "text"), *readers).select("doc_id", "page_num", "source", F.md5("text").alias("text"))


@query(f"with {P} select doc_id, page_num, case when text = '' and read is not null then 'vlm' when text <> '' then 'text' else 'scanned' end as source, text = '' and read is null as is_image from p")
def scanned_pages(spark, folder):
    all_ = paging.native(pages(spark, folder).drop("read"))
    read = pages(spark, folder).where("read is not null").select("doc_id", "page_num", F.col("read").alias("text"))
    return paging.scanned_filled(all_, read).select("doc_id", "page_num", "source", "is_image")


@query(f"with {P} select doc_id, min(page_num)::int as page_num from p where contains(text, '報核版') and page_num <= 30 group by 1")
def keyword_page(spark, folder):
    return paging.keyword_page(pages(spark, folder), "報核版")


@query(f"""with {P}, w as (select distinct doc_id, n as page_num from p, (values (0), (1), (5), (99)) t(n)) select w.doc_id, w.page_num, length(coalesce(p.text, '')) as n from w left join p on p.doc_id = w.doc_id and p.page_num = w.page_num""")
def page_lookup(spark, folder):
    all_ = pages(spark, folder)
    wanted = all_.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 5, 99)))).alias("page_num"))
    return paging.page_text(all_, wanted).select("doc_id", "page_num", F.length("text").cast("long").alias("n"))


BLOCKS = """select o_orderkey as doc_id, b.page_num, b.kind, cast(10 * b.i as double) as x0, cast(5 as double) as y0, cast(10 * b.i + o_orderkey % 50 as double) as x1, cast(25 as double) as y1, case when b.kind = 'text' then concat(' ', substr('abcdefghijklmnopqrstuvwxyz', 1, cast(o_orderkey % 26 as int)), ' ') end as text
  from orders, (values (1, 'text', 0), (1, 'text', 3), (1, 'image', 1), (2, 'image', 2)) as b(page_num, kind, i)"""


@query(f"""with b as ({BLOCKS}), s as (select doc_id, page_num, coalesce(sum(length(trim(text))) filter (kind = 'text'), 0) as c, coalesce(sum((x1 - x0) * (y1 - y0)) filter (kind = 'text'), 0) as t, coalesce(sum((x1 - x0) * (y1 - y0)) filter (kind = 'image'), 0) as i from b group by 1, 2),
  p as (select o_orderkey as doc_id, n as page_num from orders, (values (1), (2), (3)) t(n)) select doc_id, page_num, coalesce(c, 0) < 30 as is_scanned, coalesce(c, 0)::bigint as char_count, round(coalesce(t, 0) / 10000.0, 4) as text_fraction, round(coalesce(i, 0) / 10000.0, 4) as image_fraction from p left join s using (doc_id, page_num)""")
def page_triage(spark, folder):
    whole = rows(spark, folder, "select o_orderkey as doc_id, b.page_num, cast(100 as double) as width, cast(100 as double) as height from orders, (values (1), (2), (3)) as b(page_num)")
    return paging.triage(rows(spark, folder, BLOCKS), whole)


@query(f"""with b as ({BLOCKS}), s as (select doc_id, page_num, coalesce(sum(length(trim(text))) filter (kind = 'text'), 0) as c from b group by 1, 2) select doc_id, c < 30 as scanned, string_agg((page_num - 1)::varchar, ',' order by page_num) as pages from s group by 1, 2""")
def page_parts(spark, folder):
    whole = rows(spark, folder, "select o_orderkey as doc_id, b.page_num, cast(100 as double) as width, cast(100 as double) as height from orders, (values (1), (2)) as b(page_num)")
    found = paging.triage(rows(spark, folder, BLOCKS), whole)
    both = paging.page_indices(found, True).withColumn("scanned", F.lit(True)).unionByName(paging.page_indices(found, False).withColumn("scanned", F.lit(False)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("page_index")), lambda x: x.cast("string")), ",")
    return both.groupBy("doc_id", "scanned").agg(listed.alias("pages"))


@query(f"""with {P}, a as (select doc_id, string_agg(text, chr(10) || chr(10) order by page_num) as a from p where text <> '' and page_num <= 5 group by 1), b as (select doc_id, string_agg(read, chr(10) order by page_num) as b from p where text = '' group by 1)
  select doc_id, md5(case when a is null then b when b is null then a else concat(a, chr(10), chr(10), b) end) as markdown from a full join b using (doc_id)""")
def page_markdown(spark, folder):
    all_ = pages(spark, folder)
    text = all_.where("text <> '' and page_num <= 5").select("doc_id", F.col("page_num").alias("first"), F.col("text").alias("markdown"))
    scans_ = all_.where("text = ''").select("doc_id", "page_num", F.col("read").alias("text"))
    return paging.markdown(text, scans_).withColumn("markdown", F.md5("markdown"))


@query(f"""with {SCAN_SQL} select doc_id, page_num, case when k % 3 = 0 then 2 else 0 end::bigint as masked, md5(case when k % 3 = 0 then replace(replace(text, concat('巷12弄', k % 9, '號'), repeat('█', 6)), concat('A12345', lpad((k % 10000)::varchar, 4, '0')), repeat('█', 10)) else text end) as text from b""")
def masked_pages(spark, folder):
    return scans.masked(body_pages(spark, folder), ["doc_id", "page_num"], "text").select("doc_id", "page_num", "masked", F.md5("text").alias("text"))


DATED = f"""select o_orderkey as doc_id, case when o_orderkey % 2 = 0 then concat({book.DATE}) end as report_filing_date, case when o_orderkey % 3 = 0 then '112年1月2日' end as front_date, cast(o_orderkey % 9 as int) as front_page, '申請書' as front_source,
  case when o_orderkey % 5 = 0 then '111年5月6日' end as fill_date, cast(o_orderkey % 7 as int) as raw_page, case when o_orderkey % 4 = 1 then '1131114案.pdf' else 'x.pdf' end as filename from orders"""


@query(f"""with d as ({DATED}) select doc_id, coalesce(report_filing_date, front_date, fill_date, case when filename like '1131114%' then '113年11月14日' end) as report_date, case when report_filing_date is not null then '審議資料表（辦理過程報核日）' when front_date is not null then front_source
    when fill_date is not null then '審議資料表（填表日期）' when filename like '1131114%' then '檔名日期（自動辨識）' end as report_date_source, case when report_filing_date is not null then raw_page when front_date is not null then front_page when fill_date is not null then raw_page end as report_date_page,
  coalesce(report_filing_date, case when filename like '1131114%' then '113年11月14日' end) as report_date_secondary from d""")
def report_date(spark, folder):
    d = rows(spark, folder, DATED)
    return report.report_dates(d).join(report.secondary_dates(d).drop("report_date_secondary_source"), "doc_id")


@query(f"""with t as ({book.TABLES}), d as ({DATED}), j as (select t.*, d.front_date from t join d using (doc_id)),
  r as (select doc_id, 0 as o, '報核日期' as label, front_date as value from j union all select doc_id, 1, '基準容積', {money('base_floor_area')} || ' m²' from j where has_table union all select doc_id, 2, '容積獎勵申請額度', {money('bonus_floor_area')} || ' m²' from j where has_table
    union all select doc_id, 3, '容積獎勵上限', coalesce({money('bonus_limit')} || ' m²', {money('base_floor_area * 0.5')} || ' m²（依基準×50%推算）') from j where has_table union all select doc_id, 4, '法定(含無障礙)汽車停車位', legal_parking || ' 輛' from j where has_table
    union all select doc_id, 5, '實設汽車停車位', actual_parking || ' 輛（平面1）' from j where has_table union all select doc_id, 6, '無障礙停車位', accessible_parking || ' 輛' from j where has_table union all select doc_id, 7, '充電車位', ev_parking || ' 輛' from j where has_table)
  select doc_id, o as seq, label, value, value is null as missing from r""")
def key_numbers(spark, folder):
    t = rows(spark, folder, book.TABLES).withColumn("actual_parking_detail", F.lit("平面1"))
    d = rows(spark, folder, DATED).select("doc_id", F.col("front_date").alias("report_date"), F.col("front_source").alias("report_date_source"), F.col("front_page").alias("report_date_page"))
    none = [F.lit(None).cast("string").alias(c) for c in ("report_date_secondary", "report_date_secondary_source")]
    return report.key_numbers(t.join(d, "doc_id").select("*", *none)).select("doc_id", "seq", "label", "value", "missing")


@query("""with t as (select o_orderkey as k from orders) select k as id, case k % 5 when 0 then -1.0 * (k + 0.5) else k + 0.5 end::double as number, k % 3 = 0 as same, concat('臺北', k, 'm2') as text, case when k % 3 = 0 then 'B-1' else '其他' end as prefix from t""")
def normalised_values(spark, folder):
    k = F.col("id")
    t = rows(spark, folder, "select o_orderkey as id from orders")
    wide = F.translate(F.concat(F.when(k % 5 == 0, "-").otherwise(""), k.cast("string"), F.lit(".5")), "0123456789.-", "０１２３４５６７８９．－")
    number = scalars.parse_number(F.concat(F.lit("約 "), wide, F.lit(" 坪")))
    same = scalars.values_equal(F.format_string("%d年3月4日", k % 20 + 100), F.format_string("%d-03-%02d", k % 20 + 2011, F.when(k % 3 == 0, 4).otherwise(5)), 0.5)
    prefix = review_table.type_prefix(F.when(k % 3 == 0, "B-1：168專案小組版").otherwise("其他"))
    return t.select("id", number.alias("number"), same.alias("same"), scalars.area_unit(scalars.normalised(F.concat(F.lit("台 北"), k.cast("string"), F.lit("平方公尺")))).alias("text"), prefix.alias("prefix"))


