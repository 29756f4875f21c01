"""The registered queries and their SQL, and audit-shaped rows that both are run over.

The driver's tables hold no audit documents, so pages, boxes and fields are written out of `orders` by SQL that Spark and
DuckDB read alike: the same text stands in the query and, as a common table expression, in its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossia.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Names within the rows' SQL: the order's key, and a date that goes with it.
K = "o_orderkey"
DOC = f"cast(floor({K} / 8) as bigint)"
DATE = f"cast(105 + {K} % 29 as string), '年', cast(1 + {K} % 12 as string), '月', cast(1 + {K} % 28 as string), '日'"
DOTTED = f"cast(105 + {K} % 29 as string), '.', lpad(cast(1 + {K} % 12 as string), 2, '0'), '.', lpad(cast(1 + {K} % 28 as string), 2, '0')"
#: Numbers of the review table as texts, with thousands.
BASE = f"concat(cast(1 + {K} % 3 as string), ',', lpad(cast({K} % 1000 as string), 3, '0'), '.50')"
BONUS = f"concat(cast(100 + {K} % 900 as string), '.25')"
LIMIT = f"concat(cast(500 + {K} % 1000 as string), '.25')"
TABLE_TEXT = f"""concat('臺北市都市更新審議資料表', chr(10), '填表日期：中華民國', {DATE}, chr(10), '實施者：甲乙建設股份有限公司', chr(10), '統一編號：', lpad(cast({K} as string), 8, '1'), chr(10),
  '送審類別 ', case {K} % 3 when 0 then '■B-1 □A-1' when 1 then '□A-1 ■B-2' else '□A-1 □B-1' end, chr(10), '計畫名稱：臺北市某段', cast({K} as string), '地號等都市更新案（請勾選）□B-2', chr(10),
  '基準容積 ', {BASE}, ' m2', chr(10), '合計獎勵樓地板面積 ', {BONUS}, 'm2', chr(10), '容積獎勵上限 ', {LIMIT}, 'm2', chr(10), '法定汽車停車位', chr(10), cast({K} % 90 as string), '輛', chr(10),
  '實設汽車停車位 ', cast({K} % 95 as string), ' 輛（無障礙', cast({K} % 4 as string), '輛）（充電', cast({K} % 6 as string), '輛）', chr(10), '土地所有權人同意 ', cast(60 + {K} % 40 as string), '.5%', chr(10),
  '檔名 甲.pdf', chr(10), '辦理過程 報核 ', {DOTTED}, chr(10), '公開展覽 113.01.15')"""
BODY_TEXT = f"""concat('本案計劃書與更新單位說明 ', case when {K} % 2 = 0 then '審儀 ' else '' end, '電話 (02)2345-', lpad(cast({K} % 10000 as string), 4, '0'), chr(10), '手機 0912-345-', lpad(cast({K} % 1000 as string), 3, '0'), chr(10),
  '無障礙停車位 ', cast({K} % 5 as string), ' 輛 充電', cast({K} % 3 as string), '輛', case when {K} % 3 = 0 then concat(' 忠孝巷12弄', cast({K} % 9 as string), '號 A12345', lpad(cast({K} % 10000 as string), 4, '0')) else '' end, ' 完')"""
#: Eight pages a document, of eight kinds in turn; some are blank scans, for which `read` has what a reader made of them.
PAGES = f"""select {DOC} as doc_id, cast({K} % 8 * 2 + 1 as int) as page_num, {K} as k, case when {K} % 23 = 0 then '' else case ({K} + 3 * {DOC}) % 8
  when 0 then concat('目 錄', chr(10), '都市更新事業計畫申請書......1', chr(10), '切結書......2', chr(10), '委託書......3', chr(10), case when {K} % 3 = 0 then '附錄一 實施者證明文件......9' else '附錄 聽證......9' end, chr(10), '土地權屬清冊')
  when 1 then concat('都市更新事業計畫申請書', chr(10), '申請人 王某', chr(10), '中華民國', {DATE})
  when 2 then concat('切結書', chr(10), '中 華 民 國 1 1 ', cast({K} % 10 as string), ' 年 0 ', cast(1 + {K} % 9 as string), ' 月 1 ', cast({K} % 10 as string), ' 日')
  when 3 then concat(case when {K} % 5 = 0 then '委  託  書' else '委託書' end, chr(10), '茲委託 ', case {K} % 4 when 0 then '建築師事務所' when 1 then '地政士' when 2 then '都市更新規劃' else '某甲' end, ' 辦理')
  when 4 then {TABLE_TEXT}
  when 5 then concat('辦理過程', chr(10), '報核     ', {DOTTED}, chr(10), '公開展覽 113.01.15')
  when 6 then concat('報核版 (東湖更新會字第1130430', lpad(cast({K} % 10000 as string), 4, '0'), '號)')
  else {BODY_TEXT} end end as text,
  case when {K} % 23 <> 0 then null when {K} % 2 = 0 then concat('都市更新審議資料表 送審類別 ', cast({K} as string)) else concat('填表耳期 送審 辦理過程 基準容積', case when {K} % 3 = 0 then '' else ' 停車位' end) end as read
  from orders"""
#: Review tables as rows, with every status of every rule.
TABLES = f"""select {K} as doc_id, case when {K} % 6 <> 0 then substr(o_orderpriority, 1, 1) || case when {K} % 2 = 0 then '' else '-1' end end as submission_type, case when {K} % 8 <> 0 then o_orderstatus end as fill_date,
  case when {K} % 7 <> 0 then cast(o_custkey * 400 + {K} % 9 as double) end as base_floor_area, case when {K} % 10 <> 0 then cast(floor(o_totalprice) as double) + cast(0.25 as double) end as bonus_floor_area,
  case when {K} % 5 <> 0 then cast(o_custkey * 200 as double) end as bonus_limit, case when {K} % 11 <> 0 then cast({K} % 400 as int) end as legal_parking, case when {K} % 13 <> 0 then cast({K} % 450 as int) end as actual_parking,
  case when {K} % 3 <> 0 then cast({K} % 9 as int) end as accessible_parking, case when {K} % 4 <> 0 then cast({K} % 6 as int) end as ev_parking, cast(1 + {K} % 30 as int) as raw_page, {K} % 17 <> 0 as has_table from orders"""
#: Findings as rows: a rule's statuses over documents.
FINDINGS = f"""select {DOC} as doc_id, cast({K} % 8 as int) as seq, concat('R-', cast({K} % 8 as string)) as rule_id, concat('規則', cast({K} % 8 as string)) as rule_name, case {K} % 4 when 0 then 'fail' when 1 then 'warn' when 2 then 'pass' else 'skip' end as status,
  case {K} % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'other' end as severity, concat('訊息', cast({K} as string)) as message, case when {K} % 3 = 0 then concat('審議資料表第 ', cast({K} % 20 as string), ' 頁') else '' end as evidence,
  case when {K} % 2 = 0 then '第65條' end as reference, case when {K} % 3 <> 1 then concat('應為', cast({K} as string)) end as expected_calc, case when {K} % 7 <> 1 then concat('實為', cast({K} as string)) end as computed_result from orders"""
#: Saved runs, of which some were tests.
RUNS = f"""select {K} + 1 as id, concat(case {K} % 50 when 0 then 'E2E_test' when 1 then 'apiXtest' else '案' end, cast(o_custkey % 300 as string)) as case_name, case {K} % 4 when 0 then 'A-1' when 1 then 'B-1' when 2 then '' else 'B-2' end as submission_type,
  case when {K} % 3 <> 0 then round(o_totalprice / 10000, 1) end as bonus_pct, case when {K} % 5 <> 0 then cast({K} % 4 as int) end as critical_count, cast({K} % 3 as int) as high_count, cast({K} % 6 as int) as warn_count,
  case when {K} % 7 <> 0 then cast({K} % 2 as int) end as parking_pass, cast({K} % 9 as int) as pii_high_count from orders"""


def rows(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The rows of a text above over a folder's orders."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("from orders", "from {orders}"), orders=table(spark, folder, "orders"))
