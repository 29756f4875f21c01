"""The audit as a whole: every rule over documents made of pages, from one pass over the pages."""

from __future__ import annotations

from dossia.operators import audit
from dossia.plans.book import query
from dossia.plans.documents import FIELDS_SQL, FRONT_SQL, SCAN_SQL, P, pages


def tail(sql: str) -> str:
    """A text of common tables without the pages that it begins with."""
    assert sql.startswith(P)
    return sql[len(P) :]


#: Numbers count from page 10 on; fields by number: accessible, legal, bonus area, charging.
NUMBERS = """n as (select doc_id, page_num as page, text from p where page_num >= 10), nf as (select doc_id, page, 0 as field, unnest(regexp_extract_all(text, '無障礙[停車位\\s（(]*(\\d+)\\s*輛', 1)) as v from n
    union all select doc_id, page, 1, unnest(regexp_extract_all(text, '法定[汽車]*停車位[^\\n]*\\n?(\\d+)\\s*輛', 1)) from n union all select doc_id, page, 2, unnest(regexp_extract_all(text, '合計獎勵樓地板面積[^\\d]*(\\d[\\d,，.]+)', 1)) from n
    union all select doc_id, page, 3, unnest(regexp_extract_all(text, '充電(\\d+)輛', 1)) from n), numbers as (select doc_id, page, field, try_cast(replace(v, ',', '') as double) as value from nf)"""
AUDIT_SQL = f"""{P}{tail(FRONT_SQL)}{tail(FIELDS_SQL)}{tail(SCAN_SQL)}, {NUMBERS}, ids as (select distinct doc_id from p),
  loc as (select doc_id, doc_type, page, from_toc from docs qualify row_number() over (partition by doc_id, doc_type order by from_toc, seq) = 1),
  e as (select doc_id, doc_type, concat('第 ', page, ' 頁', case when from_toc then '（目錄列出，實際頁面待人工核對）' else '' end) as ev from loc),
  poa as (select doc_id, string_agg(coalesce(purpose, '用途未識別'), '、' order by seq) as purposes from docs where doc_type = '委託書' group by 1),
  front as (select ids.doc_id, f.seq, f.rule_id, f.severity, case when ev is not null then 'pass' when f.rule_id = 'DOC-004' and fields.doc_id is not null then 'pass' else 'fail' end as status,
      case when ev is not null then case when f.rule_id = 'DOC-003' then purposes else ev end when f.rule_id = 'DOC-004' and fields.doc_id is not null then concat('第 ', raw_page, ' 頁') end as evidence
    from ids cross join (values (0, 'DOC-001', '申請書', 'critical'), (1, 'DOC-002', '切結書', 'critical'), (2, 'DOC-003', '委託書', 'high'), (3, 'DOC-004', '審議資料表', 'critical')) f(seq, rule_id, dt, severity)
    left join e on e.doc_id = ids.doc_id and e.doc_type = f.dt left join poa on poa.doc_id = ids.doc_id left join fields on fields.doc_id = ids.doc_id),
  t as (select ids.doc_id, fields.doc_id is not null as has_table, fields.* exclude (doc_id), coalesce(bonus_limit, base_floor_area * 0.5) as top, abs(bonus_limit - base_floor_area * 0.5) as off, concat('審議資料表第 ', coalesce(raw_page::varchar, 'None'), ' 頁') as pg,
      case when legal_parking <= 0 then 0 when legal_parking <= 50 then 1 when legal_parking <= 300 then 1 + ceil((legal_parking - 50) / 50.0) else 6 + ceil((legal_parking - 300) / 100.0) end as need from ids left join fields using (doc_id)),
  tables as (select doc_id, 4 as seq, 'FORM-001' as rule_id, 'high' as severity, case when not has_table then 'skip' when submission_type in ('A-1', 'B-1', 'B-2', 'C', 'D') then 'pass' else 'warn' end as status, null as evidence from t
    union all select doc_id, 5, 'FORM-002', 'medium', case when not has_table then 'skip' when coalesce(fill_date, '') <> '' then 'pass' else 'warn' end, null from t
    union all select doc_id, 6, 'CALC-001', 'critical', case when not has_table then 'skip' when bonus_floor_area is null or top is null then 'warn' when bonus_floor_area > top + 0.1 then 'fail' else 'pass' end, case when has_table then pg end from t
    union all select doc_id, 7, 'CALC-002', 'critical', case when not has_table then 'skip' when accessible_parking is null then 'warn' when legal_parking > 0 and accessible_parking < need then 'fail' else 'pass' end, case when has_table then pg end from t
    union all select doc_id, 8, 'CALC-003', 'critical', case when not has_table then 'skip' when legal_parking is null or actual_parking is null then 'warn' when actual_parking < legal_parking then 'fail' else 'pass' end, case when has_table and legal_parking is not null and actual_parking is not null then pg end from t
    union all select doc_id, 9, 'CALC-004', 'high', case when not has_table then 'skip' when off is null then 'warn' when off > 2 then 'fail' else 'pass' end, case when has_table and off is not null then pg end from t
    union all select doc_id, 10, 'FORM-003', 'high', case when not has_table then 'skip' when ev_parking is not null then 'pass' else 'fail' end, case when has_table then pg end from t),
  hi as (select doc_id, string_agg(concat('P.', page, ' ', risk_type, '：', value), '; ' order by page, seq) as ev from pii where severity = 'HIGH' group by 1), mid as (select doc_id, string_agg(concat('P.', page, ' ', risk_type, '：', value), '; ' order by page, seq) as ev from pii where severity = 'MEDIUM' group by 1),
  tm as (select doc_id, string_agg(concat('P.', page, '「', wrong_term, '」應為「', correct_term, '」'), '; ' order by page, seq) as ev from terms group by 1),
  w as (select n.doc_id, n.page, n.field, n.value, case n.field when 0 then accessible_parking when 1 then legal_parking when 3 then ev_parking end as want_i, bonus_floor_area as want_f from numbers n left join fields using (doc_id) where n.value is not null),
  o as (select *, coalesce(abs(value - case when field = 2 then want_f else want_i end) > 0.1, false) as off, concat(case field when 0 then '無障礙停車位' when 1 then '法定(含無障礙)汽車停車位' when 3 then '充電車位' else '容積獎勵面積' end, '：審議資料表=', case when field = 2 then want_f::varchar else want_i::varchar end, '，P.', page, '=', value) as line from w),
  num as (select doc_id, string_agg(line, '; ' order by page, field) filter (off) as ev from o group by 1),
  scans as (select ids.doc_id, 11 as seq, 'PII-001' as rule_id, 'high' as severity, case when hi.ev is not null then 'fail' when mid.ev is not null then 'warn' else 'pass' end as status, coalesce(hi.ev, mid.ev) as evidence from ids left join hi using (doc_id) left join mid using (doc_id)
    union all select ids.doc_id, 12, 'TERM-001', 'medium', case when ev is not null then 'fail' else 'pass' end, ev from ids left join tm using (doc_id)
    union all select ids.doc_id, 13, 'CONS-001', 'high', case when fields.doc_id is null then 'skip' when num.doc_id is null then 'warn' when num.ev is not null then 'fail' else 'pass' end, case when fields.doc_id is not null then num.ev end from ids left join fields using (doc_id) left join num using (doc_id))"""
ALL_SQL = "select doc_id, seq, rule_id, severity, status, evidence from front union all select doc_id, seq, rule_id, severity, status, evidence from tables union all select doc_id, seq, rule_id, severity, status, evidence from scans"


@query(f"with {AUDIT_SQL} select doc_id, seq::int as seq, rule_id, severity, status, evidence from ({ALL_SQL})")
def audit_findings(spark, folder):
    """Statuses and evidence of all rules; messages aren't asked for and so aren't built."""
    return audit.findings(None, pages(spark, folder)).select("doc_id", "seq", "rule_id", "severity", "status", "evidence")
