"""Registered queries of lookups, caches, views and unions of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossia.functions import convert, scalars
from dossia.operators import evidence, history, pages, rules, templates
from dossia.plans import book
from dossia.plans.book import query, rows
from dossia.plans.cases import QUOTES
from dossia.sources.tables import table

#: What models and comparisons say of documents, and rules that failed for some.
LLM = f"""select q.*, case q.seq when 0 then 'FAR-9' when 1 then 'X-DATE' when 2 then 'PII-7' when 3 then 'TERM-3' else 'Q' end as rule_id, 'typo' as error_type, 'r' as reason, cast(q.seq as int) as page_number from ({QUOTES}) q"""
FIELD = "select doc_id, cast(0 as int) as seq, 'LAW-CON-001' as rule_id, case when doc_id % 2 = 0 then 'critical' else 'warning' end as severity, 'f' as field_name, 'a' as actual_value, 'r' as reason from documents where doc_id % 3 = 0"
CROSS = "select doc_id, cast(1 as int) as seq, 'CONS-AREA-001' as rule_id, 'warning' as severity, 'g' as field_name, '1' as business_plan_value, '2' as rights_exchange_value from documents where doc_id % 7 = 0"
FAILING = "select doc_id, r.rule_id from documents, (values (4, 'CALC-004'), (6, 'LAW-CON-002'), (10, 'CONS-VAL-001'), (5, 'TERM-001'), (2, 'DOC-001')) as r(k, rule_id) where doc_id % r.k = 0"


def of_documents(spark, folder, sql):
    return spark.sql(sql.replace("from documents", "from {documents}"), documents=table(spark, folder, "documents"))


@query(rf"""with l as ({LLM}), t as (select l.doc_id, 'llm' as source, l.seq, l.rule_id, l.severity, l.quote is not null and length(regexp_replace(l.quote, '^\s+|\s+$', '', 'g')) >= 3 and contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(l.quote, '\s+', '', 'g')) as hit, case l.seq when 0 then 'CALC-004' when 3 then 'TERM-001' end as other, case l.seq when 0 then 4 when 3 then 5 end as k
    from l join documents d using (doc_id) union all select doc_id, 'field', seq, rule_id, severity, false, 'LAW-CON-002', 6 from ({FIELD}) union all select doc_id, 'cross', seq, rule_id, severity, false, 'CONS-VAL-001', 10 from ({CROSS})),
  v as (select *, coalesce(hit, false) or (source = 'llm' and severity = 'critical' and not coalesce(hit, false) and doc_id % 3 = 0) as verified, coalesce(doc_id % k = 0, false) as corroborated from t),
  s as (select *, case source when 'llm' then 0.45 else 0.75 end::double + case when verified then 0.2 when source = 'llm' then -0.1 else 0.0 end::double + case when corroborated then 0.15 else 0.0 end::double as m from v)
  select doc_id, source, seq, rule_id, verified, corroborated, round(least(1.0, greatest(0.0, m)), 2) as confidence, least(1.0, greatest(0.0, m)) < 0.6 or (severity = 'critical' and not verified) as needs_review from s""")
def ai_findings(spark, folder):
    llm, field, cross, failing = (of_documents(spark, folder, sql) for sql in (LLM, FIELD, CROSS, FAILING))
    text = table(spark, folder, "documents").select("doc_id", F.lit(1).alias("page_num"), "text")
    cited = of_documents(spark, folder, QUOTES).where("doc_id % 3 = 0").select("doc_id", "seq", F.lit("cited").alias("cited_text"))
    out = evidence.ai_findings(failing, llm.withColumnRenamed("quote", "detected_text"), field, cross, text, cited)
    return out.select("doc_id", "source", "seq", "rule_id", "verified", "corroborated", "confidence", "needs_review")


@query(f"""with f as ({book.FINDINGS}) select doc_id, seq, case when status = 'fail' and severity = 'critical' then 'critical_fails' when status = 'fail' and severity = 'high' then 'high_fails' when status = 'warn' then 'warnings' else 'passes' end as name from f where status in ('warn', 'pass') or (status = 'fail' and severity in ('critical', 'high'))""")
def finding_views(spark, folder):
    found = rows(spark, folder, book.FINDINGS)
    out = [rules.view(found, name).select("doc_id", "seq", F.lit(name).alias("name")) for name in rules.VIEWS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


ANSWER = """select o_orderkey as id, case o_orderkey % 6 when 0 then concat('{"a": ', cast(o_orderkey as string), '}') when 1 then concat('```json', chr(10), '{"a": ', cast(o_orderkey as string), '}', chr(10), '```') when 2 then concat('Answer: {"a": {"b": ', cast(o_orderkey as string), '}} done')
  when 3 then 'no object' when 4 then '[1, 2]' else concat('{"a": ', cast(o_orderkey as string)) end as answer from orders"""


@query("""with t as (select o_orderkey as k from orders) select k as id, case k % 6 when 0 then concat('{"a": ', k, '}') when 1 then concat('{"a": ', k, '}') when 2 then concat('{"a": {"b": ', k, '}}') end as object from t""")
def json_objects(spark, folder):
    return rows(spark, folder, ANSWER).select("id", scalars.json_object(F.col("answer")).alias("object"))


SIMPLE = {"类": "類", "别": "別", "内": "內", "国": "國", "头": "頭", "发": "發", "头发": "頭髮", "面积": "面積", "积": "積"}
_ONE = {k: v for k, v in SIMPLE.items() if len(k) == 1}
SCRIPT = "select o_orderkey as id, concat('送審类别 ', cast(o_orderkey as string), case o_orderkey % 4 when 0 then '头发发头' when 1 then '国内面积' when 2 then '類別 plain' else '发' end, '积') as text from orders"


@query(f"""with t as ({SCRIPT}) select id, translate(replace(replace(text, '头发', '頭髮'), '面积', '面積'), '{''.join(_ONE)}', '{''.join(_ONE.values())}') as text, true as settled from t""")
def traditional_script(spark, folder):
    once = convert.converted(F.col("text"), SIMPLE)
    return rows(spark, folder, SCRIPT).select("id", once.alias("text")).select("id", "text", (convert.converted(F.col("text"), SIMPLE) == F.col("text")).alias("settled"))


@query("""with t as (select o_orderkey as k from orders), w as (select sha256(concat('doc', k % 500)) as sha, (k % 3)::int as page_num, max(k) as k from t group by 1, 2), c as (select sha256(concat('doc', i)) as sha, p::int as page_num, i from range(0, 500) r(i), range(0, 3) s(p) where (i + p) % 2 = 0)
  select w.sha, w.page_num, case when c.i is not null then concat('old', c.i) else concat('new', w.k) end as text, c.i is not null as hit from w left join c using (sha, page_num)""")
def cached_pages(spark, folder):
    """What a cache has of pages, and the cache with what was read besides."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    key = lambda c: pages.file_key(F.concat(F.lit("doc"), c.cast("string")).cast("binary"))
    wanted = o.select(key(F.col("k") % 500).alias("sha"), (F.col("k") % 3).cast("int").alias("page_num"), "k").groupBy("sha", "page_num").agg(F.max("k").alias("k"))
    cache = spark.range(500).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page_num")).where("(id + page_num) % 2 = 0").select(key(F.col("id")).alias("sha"), "page_num", F.concat(F.lit("old"), F.col("id").cast("string")).alias("text"))
    have, missing = pages.cached(wanted, cache, ["sha", "page_num"])
    grown = pages.cache_with(cache, missing.select("sha", "page_num", F.concat(F.lit("new"), F.col("k").cast("string")).alias("text")), ["sha", "page_num"])
    got = pages.cached(wanted, grown, ["sha", "page_num"])[0]
    return got.join(have.select("sha", "page_num", F.lit(True).alias("hit")), ["sha", "page_num"], "left").select("sha", "page_num", "text", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(f"""with p as ({book.PAGES}), w as (select distinct doc_id, n as page_num from p, (values (1), (4), (7), (99)) t(n)), x as (select doc_id, page_num, k from p where k % 3 <> 0)
  select w.doc_id, w.page_num, case when x.k is null then 0 else 1 + x.k % 2 end::int as n_tables, coalesce(x.k % 5, -1)::int as cells from w left join x using (doc_id, page_num)""")
def page_tables(spark, folder):
    all_ = rows(spark, folder, book.PAGES)
    wanted = all_.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, (1, 4, 7, 99)))).alias("page_num"))
    cells = F.array_repeat(F.array((F.col("k") % 5).cast("int")), (1 + F.col("k") % 2).cast("int"))
    out = pages.page_tables(all_.where("k % 3 <> 0").select("doc_id", "page_num", cells.alias("tables")), wanted)
    return out.select("doc_id", "page_num", F.size("tables").alias("n_tables"), F.coalesce(F.get(F.get("tables", F.lit(0)), F.lit(0)), F.lit(-1)).alias("cells"))


@query(f"""with p as ({book.PAGES}) select doc_id, page_num, case when k % 5 = 0 or trim(text) = '' then concat('第二', k) else '' end as second, false as is_image from p""")
def second_reader(spark, folder):
    all_ = rows(spark, folder, book.PAGES).withColumn("text", F.when(F.col("k") % 5 == 0, "  \n").otherwise(F.col("text"))).withColumn("other", F.concat(F.lit("第二"), F.col("k").cast("string")))
    return pages.native(all_, "text", "other").select("doc_id", "page_num", F.when(F.startswith("text", F.lit("第二")), F.col("text")).otherwise("").alias("second"), "is_image")


@query("""select o_orderkey as id, case o_orderkey % 7 when 0 then '事業概要計畫書附件冊' when 1 then '事業概要計畫書' when 2 then '事業計畫書附件冊' when 3 then '事業計畫書' when 4 then '權利變換計畫書附件冊' when 5 then '權利變換計畫書' end as kind from orders""")
def template_kinds(spark, folder):
    name = F.concat(F.lit("111"), F.element_at(F.array(*[F.lit(x) for x in ("事業概要計畫書附件冊", "事業概要計畫書", "事業計畫書附件冊", "事業計畫書", "權利變換計畫書附件冊", "權利變換計畫書", "其他")]), (F.col("o_orderkey") % 7 + 1).cast("int")), F.lit("範本.odt"))
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), templates.doc_kind(name).alias("kind"))


@query(f"""with r as ({book.RUNS}) select id, case_name, null::varchar as audit_time, null::int as warn_count, critical_count, 'kept' as extra from r""")
def migrated_runs(spark, folder):
    """Runs of an older schema with the columns that came later; what only they have stays."""
    old = rows(spark, folder, book.RUNS).select("id", "case_name", "critical_count", F.lit("kept").alias("extra"))
    return history.migrated(old).select("id", "case_name", "audit_time", "warn_count", "critical_count", "extra")
