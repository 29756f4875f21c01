"""Registered queries of the audit operators over the driver's tables, and their SQL.

Driver tables stand in for audit data: orders for review tables and runs, lineitem for numbers in
text, documents for pages, events for detections and findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.scalars import accessible_required, normalize_date, roc_text
from dossia.operators import compare, rules, scans, summaries
from dossia.plans import audits, cases, documents, more  # noqa: F401  their queries are registered too
from dossia.plans.book import ORACLE, QUERIES, query
from dossia.sources.tables import table

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
FLAGSHIP = "rule_findings"

#: Shifted version boundaries, so that the orders' dates fall into every version.
ORDER_VERSIONS = [("A", "1995-01-01"), ("B", "1996-06-01"), ("C", "1998-01-01"), ("D", "2000-01-01")]
#: English stand-ins for term pairs.
ORDER_TERMS = [("License", "Licence"), ("Version", "Edition")]
PLAYBOOK = [
    {"rule_id": "PB-1", "type": "threshold", "field": "bonus_floor_area", "op": "<=", "value": 150000.0, "severity": "high"},
    {"rule_id": "PB-2", "type": "formula_check", "field": "base_floor_area", "target": "bonus_limit", "factor": 0.5, "severity": "high"},
    {"rule_id": "PB-3", "type": "threshold", "field": "legal_parking", "op": "~", "value": 1.0},
    {"rule_id": "PB-4", "type": "review_field_present", "field": "ev_parking", "enabled": False},
]


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Review tables made of orders: every rule's statuses occur."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("doc_id"), F.col("o_totalprice").alias("bonus_floor_area"), F.when(k % 5 != 0, F.col("o_custkey") * 200.0).alias("bonus_limit"), F.when(k % 7 != 0, F.col("o_custkey") * 400.0 + k % 9).alias("base_floor_area"),
        F.when(k % 11 != 0, k % 400).alias("legal_parking"), F.when(k % 13 != 0, k % 450).alias("actual_parking"), F.when(k % 3 != 0, k % 9).alias("accessible_parking"), F.when(k % 4 != 0, k % 6).alias("ev_parking"),
        F.when(k % 6 != 0, F.substring("o_orderpriority", 1, 1)).alias("submission_type"), F.when(k % 8 != 0, F.col("o_orderstatus")).alias("fill_date"),
    )


REVIEWS_SQL = """r as (select o_orderkey as doc_id, o_totalprice as bonus, case when o_orderkey % 5 <> 0 then o_custkey * 200.0::double end as lim,
  case when o_orderkey % 7 <> 0 then o_custkey * 400.0::double + o_orderkey % 9 end as base, case when o_orderkey % 11 <> 0 then o_orderkey % 400 end as legal,
  case when o_orderkey % 13 <> 0 then o_orderkey % 450 end as actual, case when o_orderkey % 3 <> 0 then o_orderkey % 9 end as acc,
  case when o_orderkey % 4 <> 0 then o_orderkey % 6 end as ev, case when o_orderkey % 6 <> 0 then substr(o_orderpriority, 1, 1) end as typ,
  case when o_orderkey % 8 <> 0 then o_orderstatus end as filled from orders),
need as (select *, case when legal <= 0 then 0 when legal <= 50 then 1 when legal <= 300 then 1 + ceil((legal - 50) / 50.0) else 6 + ceil((legal - 300) / 100.0) end as want, coalesce(lim, base * 0.5) as top from r),
f as (
  select doc_id, 0 as seq, 'FORM-001' as rule_id, case when typ in ('A-1', 'B-1', 'B-2', 'C', 'D') then 'pass' else 'warn' end as status, 'high' as severity from need
  union all select doc_id, 1, 'FORM-002', case when coalesce(filled, '') <> '' then 'pass' else 'warn' end, 'medium' from need
  union all select doc_id, 2, 'CALC-001', case when bonus is null or top is null then 'warn' when bonus > top + 0.1 then 'fail' else 'pass' end, 'critical' from need
  union all select doc_id, 3, 'CALC-002', case when acc is null then 'warn' when legal > 0 and acc < want then 'fail' else 'pass' end, 'critical' from need
  union all select doc_id, 4, 'FORM-003', case when ev is null then 'fail' else 'pass' end, 'high' from need
  union all select doc_id, 5, 'CALC-003', case when legal is null or actual is null then 'warn' when actual >= legal then 'pass' else 'fail' end, 'critical' from need
  union all select doc_id, 6, 'CALC-004', case when abs(lim - base * 0.5) is null then 'warn' when abs(lim - base * 0.5) > 2.0 then 'fail' else 'pass' end, 'high' from need
  union all select doc_id, 7, 'PB-1', case when bonus is null then 'skip' when bonus <= 150000 then 'pass' else 'fail' end, 'high' from need
  union all select doc_id, 8, 'PB-2', case when lim is null or base is null then 'skip' when abs(lim - base * 0.5) <= greatest(0.01, abs(base * 0.5) * 0.01) then 'pass' else 'fail' end, 'high' from need
  union all select doc_id, 9, 'PB-3', 'skip', 'medium' from need)"""


def findings(spark: SparkSession, folder: str) -> DataFrame:
    return rules.evaluate(reviews(spark, folder), ["doc_id"], PLAYBOOK)


@query(f"with {REVIEWS_SQL} select doc_id, seq, rule_id, status, severity from f")
def rule_findings(spark, folder):
    return findings(spark, folder).select("doc_id", "seq", "rule_id", "status", "severity")


@query(f"""with {REVIEWS_SQL} select rule_id, count(*) filter (status = 'fail' and severity = 'critical') as critical_count, count(*) filter (status = 'fail' and severity = 'high') as high_count,
  count(*) filter (status = 'warn') as warn_count, count(*) filter (status = 'pass') as pass_count, count(*) filter (status = 'skip') as skip_count from f group by rule_id""")
def finding_counts(spark, folder):
    return rules.counts(findings(spark, folder), ["rule_id"])


@query(f"""with {REVIEWS_SQL} select doc_id, seq, rule_id, status, severity from f
  order by case status when 'fail' then 0 when 'warn' then 1 when 'skip' then 2 when 'pass' then 3 else 9 end, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 9 end, doc_id, seq limit 50""")
def sorted_topk(spark, folder):
    return rules.ordered(findings(spark, folder), "doc_id").select("doc_id", "seq", "rule_id", "status", "severity").limit(50)


@query("""with s as (select p_partkey, p_size from part) select p_partkey, (case when p_size <= 0 then 0 when p_size <= 50 then 1 when p_size <= 300 then 1 + ceil((p_size - 50) / 50.0) else 6 + ceil((p_size - 300) / 100.0) end)::bigint as required from s""")
def tier_rule(spark, folder):
    return table(spark, folder, "part").select("p_partkey", accessible_required(F.col("p_size")).alias("required"))


PII_SQL = r"""m as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as value, 'email' as risk_type, 'HIGH' as severity from documents
  union all select doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')), 'ipv4', 'LOW' from documents
  union all select doc_id, unnest(regexp_extract_all(text, '09[0-9]{2}-?[0-9]{3}-?[0-9]{3}')), 'phone', 'MEDIUM' from documents
  union all select doc_id, unnest(regexp_extract_all(text, '\(0[0-9]{1,2}\)\s*[0-9]{3,4}-?[0-9]{4}')), 'phone', 'MEDIUM' from documents
  union all select doc_id, unnest(regexp_extract_all(text, '巷.{0,15}弄.{0,8}號')), 'residential_address', 'HIGH' from documents
  union all select doc_id, unnest(regexp_extract_all(text, '[A-Z][0-9]{9}')), 'id_number', 'HIGH' from documents)"""
MORE = [*fixed.PII_PATTERNS, *fixed.PII_MORE]


@query(f"with {PII_SQL} select doc_id, risk_type, severity, value from m")
def pii_scan(spark, folder):
    return scans.pii(table(spark, folder, "documents"), "doc_id", "text", MORE).select("doc_id", "risk_type", "severity", "value")


@query(f"""with {PII_SQL}, s as (select doc_id, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium from m group by 1)
  select doc_id, case when high > 0 then 'fail' when medium > 0 then 'warn' else 'pass' end as status, coalesce(high, 0) as high from (select distinct doc_id from documents) left join s using (doc_id)""")
def pii_rule(spark, folder):
    d = table(spark, folder, "documents")
    return scans.pii_status(d, scans.pii(d, "doc_id", "text", MORE), "doc_id")


@query("""with p(w, c) as (values ('License', 'Licence'), ('Version', 'Edition'))
  select doc_id, w as wrong_term, c as correct_term, instr(text, w)::int as "at" from documents, p where instr(text, w) > 0""")
def term_scan(spark, folder):
    return scans.terms(table(spark, folder, "documents"), "doc_id", "text", ORDER_TERMS).drop("context", "seq")


@query("""select page_id, generate_subscripts(x, 1) - 1 as item_no, trim(regexp_replace(unnest(x), '<[^>]+>', '', 'g')) as item from (select page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) as x from pages)""")
def html_cells(spark, folder):
    return scans.html_items(table(spark, folder, "pages"), "page_id", "html")


@query("""with n as (select l_orderkey as k, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by 1)
  select o_orderkey, case when o_totalprice is null then 'skip' when low is null then 'warn' when greatest(abs(low - o_totalprice), abs(high - o_totalprice)) > 60000 then 'fail' else 'pass' end as status from orders left join n on o_orderkey = k""")
def number_consistency(spark, folder):
    want = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    got = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("value"))
    return compare.number_consistency(want, got, ["o_orderkey"], 60000.0).select("o_orderkey", "status")


@query("select o_custkey, o_orderkey, nth from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as nth from orders) where nth <= 1")
def latest_run(spark, folder):
    return summaries.latest(table(spark, folder, "orders"), "o_custkey", [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "nth")


@query("select o_custkey, o_orderkey, nth from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as nth from orders) where nth <= 10")
def run_history(spark, folder):
    return summaries.latest(table(spark, folder, "orders"), "o_custkey", [F.desc("o_orderkey")], 10).select("o_custkey", "o_orderkey", "nth")


@query("""with v(label, since) as (values ('A', date '1995-01-01'), ('B', date '1996-06-01'), ('C', date '1998-01-01'), ('D', date '2000-01-01'))
  select version, count(*) as n from (select coalesce(v.label, 'A') as version from orders o asof left join v on o.o_orderdate::date >= v.since) group by 1""")
def version_asof(spark, folder):
    o = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"))
    return compare.version_asof(o, "day", ORDER_VERSIONS, "C").groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso from orders")
def roc_dates(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", normalize_date(roc_text(F.to_date("o_orderdate"))).alias("iso"))


@query("""with c as (select year(o_orderdate) as y, o_orderpriority as k, count(*) // 100 as x from orders group by 1, 2), o as (select y, lead(y) over (order by y) as n from (select distinct y from c)),
  a as (select o.n as v, k, x as old from c join o using (y) where o.n is not null), b as (select c.y as v, k, x as new from c join o on o.n = c.y)
  select v, k, old, new, case when old is null then 'added' when new is null then 'removed' else 'updated' end as change from a full join b using (v, k) where old is distinct from new""")
def schema_diff(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("k")).agg(F.expr("count(*) div 100").alias("x"))
    return compare.consecutive_diff(o, "y", "k", "x")


@query("""with e as (select event_id, case event_type when 'error' then 'llm' when 'click' then 'field' else 'cross' end as source, 'CALC-00' || (event_id % 5) as rule_id, case when event_id % 4 = 0 then 'critical' else 'high' end as severity, event_id % 3 = 0 as verified from events),
  s as (select *, rule_id in ('CALC-001', 'CALC-004') as cor, case source when 'llm' then 0.45 else 0.75 end::double + case when verified then 0.2 when source = 'llm' then -0.1 else 0.0 end::double + case when rule_id in ('CALC-001', 'CALC-004') then 0.15 else 0.0 end::double as m from e)
  select event_id, cor as corroborated, least(1.0, greatest(0.0, m)) < 0.6 or (severity = 'critical' and not verified) as needs_review, round(least(1.0, greatest(0.0, m)), 2) as confidence from s""")
def confidence(spark, folder):
    e = table(spark, folder, "events")
    source = F.when(F.col("event_type") == "error", "llm").when(F.col("event_type") == "click", "field").otherwise("cross")
    f = e.select("event_id", source.alias("source"), F.concat(F.lit("CALC-00"), (F.col("event_id") % 5).cast("string")).alias("rule_id"), F.when(F.col("event_id") % 4 == 0, "critical").otherwise("high").alias("severity"), (F.col("event_id") % 3 == 0).alias("verified"))
    failing = spark.sql("select 'CALC-001' as rule_id")
    return compare.confidence(f, failing).select("event_id", "corroborated", "needs_review", "confidence")


@query(r"""with b as (select item_id, regexp_replace(text, '\s+', '', 'g') as q from benchmark), d as (select doc_id, regexp_replace(text, '\s+', '', 'g') as p from documents) select doc_id, item_id from d, b where length(q) >= 3 and contains(p, q)""")
def quote_grounding(spark, folder):
    return compare.grounded(table(spark, folder, "benchmark").select("item_id", F.col("text").alias("quote")), table(spark, folder, "documents").select("doc_id", "text"), "quote", "text").select("doc_id", "item_id")


@query("""with b as (select l_orderkey as doc, l_linenumber as seq, (l_suppkey % 7) * 60.0 as x0, (l_suppkey % 7) * 60.0 + 50 as x1, (l_partkey % 5) * 12.0 as yc, 14.0 as h from lineitem)
  select a.doc, a.seq as l_seq, b.seq, row_number() over (partition by a.doc, a.seq order by b.x0, b.seq) as nth from b a join b on a.doc = b.doc and abs(b.yc - a.yc) <= 0.6 * greatest(a.h, b.h) and b.x0 - a.x1 >= -a.h and a.seq <> b.seq where a.seq = 1""")
def neighbours(spark, folder):
    li = table(spark, folder, "lineitem")
    b = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 7 * 60.0).alias("x0"), (F.col("l_suppkey") % 7 * 60.0 + 50).alias("x1"), (F.col("l_partkey") % 5 * 12.0).alias("yc"), F.lit(14.0).alias("h"))
    return compare.right_neighbours(b, ["doc"], "seq = 1").select("doc", "l_seq", "seq", "nth")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as c from events where value is not null)
  select event_type, count(*) as n, round(avg(value), 6) as mean, median(value) as median, max(case when k - 1 = round_even(0.95 * (c - 1), 0)::int then value end) as p95, min(value) as least, max(value) as most, round(coalesce(stddev_samp(value), 0), 6) as deviation from r group by 1""")
def timing_stats(spark, folder):
    out = summaries.timing(table(spark, folder, "events"), "event_type", "value")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query("""with c as (select count(*) filter (n_chars > 500 and quality = 1) as tp, count(*) filter (n_chars > 500 and quality = 0) as fp, count(*) filter (n_chars <= 500 and quality = 1) as fn from documents join labels using (doc_id))
  select tp, fp, fn, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) as f1 from c""")
def eval_micro(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    said, good = F.col("n_chars") > 500, F.col("quality") == 1
    c = d.select((said & good).cast("long").alias("tp"), (said & ~good).cast("long").alias("fp"), (~said & good).cast("long").alias("fn"))
    return summaries.micro_average(c).select("tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query("""with d as (select distinct user_id, date_diff('day', date '1970-01-01', ts::date) as d from events), g as (select *, d - row_number() over (partition by user_id order by d) as i from d)
  select user_id, min(d) as first, max(d) as last, count(*) as length from g group by user_id, i""")
def page_islands(spark, folder):
    d = table(spark, folder, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("d"))
    return summaries.islands(d, ["user_id"], "d")


@query("""with m as (select *, event_type = 'view' as flag from events), s as (select *, case when flag and not coalesce(lag(flag) over (partition by user_id order by ts, event_id), false) then 1 else 0 end as st from m),
  g as (select *, sum(st) over (partition by user_id order by ts, event_id rows unbounded preceding) as group_no from s) select user_id, group_no::bigint as group_no, count(*) as members from g where flag group by 1, 2""")
def choose_one_groups(spark, folder):
    return summaries.flag_groups(table(spark, folder, "events").withColumn("flag", F.col("event_type") == "view"), "user_id", ["ts", "event_id"], "flag")


@query("""with l as (select doc_id, string_split(text, chr(10)) as s from documents), e as (select doc_id, unnest(s) as line, generate_subscripts(s, 1) - 1 as line_no from l)
  select doc_id, line_no, md5(line) as line, md5(coalesce(lag(line) over (partition by doc_id order by line_no), '')) as previous from e""")
def line_context(spark, folder):
    return summaries.lines_with_previous(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "line_no", F.md5("line").alias("line"), F.md5("previous").alias("previous"))


@query("""select source, doc_id from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as k from documents) where k = 1""")
def best_page(spark, folder):
    d = table(spark, folder, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))
    return d


@query("""select event_type, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1""")
def props_json(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("select doc_id, n_chars from documents where length(text) < 30")
def triage(spark, folder):
    return table(spark, folder, "documents").where(F.length("text") < 30).select("doc_id", "n_chars")


@query("select doc_id, coalesce(quality, 0) as quality, case when quality is null then 0.5 else 1.0 end::double as coverage from documents left join labels using (doc_id)")
def fill_merge(spark, folder):
    d = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.when(F.col("quality").isNull(), 0.5).otherwise(1.0).alias("coverage"))


@query("select md5(regexp_replace(text, '\\s+', '', 'g')) as h, min(doc_id) as doc_id, count(*) as n from documents group by 1 having count(*) > 1")
def dedupe_norm(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.md5(F.regexp_replace("text", r"\s+", "")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' except select o_custkey from orders where year(o_orderdate) = 1996")
def set_ops(spark, folder):
    c = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return c.subtract(table(spark, folder, "orders").where(F.year("o_orderdate") == 1996).select("o_custkey"))


@query("""select source, count(*) as n from (select 'llm' as source from events where event_type = 'error' union all select 'field' from events where event_type = 'click' union all select 'cross' from orders) group by 1""")
def finding_union(spark, folder):
    e, o = table(spark, folder, "events"), table(spark, folder, "orders")
    tag = lambda df, s: df.select(F.lit(s).alias("source"))
    return tag(e.where("event_type = 'error'"), "llm").unionByName(tag(e.where("event_type = 'click'"), "field")).unionByName(tag(o, "cross")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
