"""What the report shows: key numbers, the opinion's text, pages to mark, banners and thumbnails, and how rules are documented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.dates import file_date
from dossia.functions.scalars import rank_of
from dossia.functions.text import fixed_point


def evidence_page(evidence: Column) -> Column:
    """The page that an evidence text names; null if none."""
    return F.regexp_extract(evidence, r"(?U)第\s*(\d+)\s*頁", 1).try_cast("int")


def report_dates(rows: DataFrame) -> DataFrame:
    """The date that counts, with its source and page: the process table's, the front documents', the fill date, the file name's.

    rows: doc_id, report_filing_date, fill_date, raw_page, front_date, front_page, front_source, filename.
    """
    table = F.lit("審議資料表（辦理過程報核日）")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    name, none = file_date(F.col("filename")), F.lit(None)
    tries = [
        (some("report_filing_date"), table, F.col("raw_page")), (some("front_date"), F.col("front_source"), F.col("front_page")),
        (some("fill_date"), F.lit("審議資料表（填表日期）"), F.col("raw_page")), (name, F.lit("檔名日期（自動辨識）"), none.cast("int")),
    ]
    pick = F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("date"), s.cast("string").alias("source"), p.cast("int").alias("page"))) for d, s, p in tries])
    return rows.select("doc_id", pick["date"].alias("report_date"), pick["source"].alias("report_date_source"), pick["page"].alias("report_date_page"))


def secondary_dates(rows: DataFrame) -> DataFrame:
    """The second document's date: of its own process table, else of its file name. rows: doc_id, report_filing_date, filename."""
    own, name = F.nullif(F.col("report_filing_date"), F.lit("")), file_date(F.col("filename"))
    source = F.when(own.isNotNull(), "審議資料表（辦理過程報核日）").when(name.isNotNull(), "檔名日期（自動辨識）")
    return rows.select("doc_id", F.coalesce(own, name).alias("report_date_secondary"), source.alias("report_date_secondary_source"))


def key_numbers(rows: DataFrame) -> DataFrame:
    """The numbers that drive the rules: `doc_id, seq, label, value, source, page, missing`.

    rows: doc_id, has_table, the review table's fields, report_date, report_date_source, report_date_page, and the secondary date's.
    """
    second = F.col("report_date_secondary").isNotNull()
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))

    def line(label, value, source, page, missing):
        return F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in (("label", label), ("value", value), ("source", source), ("page", page), ("missing", missing))])

    area = lambda c: F.concat(fixed_point(F.col(c)), F.lit(" m²"))
    count = lambda c: F.concat(F.col(c).cast("string"), F.lit(" 輛"))
    detail = F.nullif(F.col("actual_parking_detail"), F.lit(""))
    actual = F.when(detail.isNotNull(), F.concat(count("actual_parking"), F.lit("（"), detail, F.lit("）"))).otherwise(count("actual_parking"))
    derived = F.concat(fixed_point(F.col("base_floor_area") * 0.5), F.lit(" m²（依基準×50%推算）"))
    table = [
        ("基準容積", area("base_floor_area")), ("容積獎勵申請額度", area("bonus_floor_area")), ("容積獎勵上限", F.coalesce(area("bonus_limit"), derived)),
        ("法定(含無障礙)汽車停車位", count("legal_parking")), ("實設汽車停車位", actual), ("無障礙停車位", count("accessible_parking")), ("充電車位", count("ev_parking")),
    ]
    none = F.lit(None).cast("int")
    date_page = F.col("report_date_page").cast("int")
    dates = [line(F.when(second, "事業計畫書 報核日期").otherwise("報核日期"), F.col("report_date"), dash("report_date_source"), date_page, F.col("report_date").isNull())]
    dates += [F.when(second, line("權利變換計畫書 報核日期", F.col("report_date_secondary"), dash("report_date_secondary_source"), none, F.lit(False)))]
    dates += [F.when(F.col("has_table"), line(name, value, "審議資料表", F.col("raw_page").cast("int"), value.isNull())) for name, value in table]
    return rows.select("doc_id", F.posexplode(F.array_compact(F.array(*dates))).alias("seq", "x")).select("doc_id", "seq", "x.*")


def opinion(findings: DataFrame, heads: DataFrame) -> DataFrame:
    """The opinion's text of each document, a block of lines for each finding to act on: `doc_id, opinion`.

    heads: doc_id, case_name, report_date, report_date_source, report_date_page, rule_version, audit_time. A document's findings
    are as many as there are rules, so they fit in one row.
    """
    order = F.struct(rank_of(F.col("severity"), fixed.SEVERITY_RANK).alias("r"), "seq")
    own = F.struct(order.alias("order"), "status", "rule_id", "rule_name", "message", "expected_calc", "computed_result", "reference")
    grouped = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("all"))
    rows = heads.join(grouped, "doc_id", "left").withColumn("all", F.coalesce("all", F.array().cast(grouped.schema["all"].dataType)))
    blank = F.lit("")

    def block(f, i, advice):
        calc = F.concat_ws("；", F.nullif(f["expected_calc"], blank), F.nullif(f["computed_result"], blank))
        return F.concat_ws(
            "\n", F.concat((i + 1).cast("string"), F.lit(". 【"), f["rule_id"], F.lit("】"), f["rule_name"]), F.concat(F.lit("　現況："), f["message"]), F.when(calc != "", F.concat(F.lit("　核算："), calc)),
            F.when(F.coalesce(f["reference"], blank) != "", F.concat(F.lit("　法源："), f["reference"])), F.lit(f"　建議：{advice}"),
        )

    def section(status, heading, advice):
        items = F.filter("all", lambda f: f["status"] == status)
        body = F.when(F.size(items) == 0, F.array(F.lit("　（無）"))).otherwise(F.transform(items, lambda f, i: block(f, i, advice)))
        return F.concat(F.array(F.lit(heading)), body, F.array(blank))

    page = F.when(F.coalesce(F.col("report_date_page"), F.lit(0)) != 0, F.concat(F.lit(" 第"), F.col("report_date_page").cast("string"), F.lit("頁"))).otherwise("")
    dated = F.concat(F.lit("報核日期："), F.col("report_date"), F.lit("（來源："), F.coalesce("report_date_source", blank), page, F.lit("）→ 適用 "), F.col("rule_version"))
    head = F.array(
        F.lit("臺北市都市更新審議 自動審查意見"), F.concat(F.lit("案名："), F.col("case_name")), F.when(F.coalesce("report_date", blank) != "", dated).otherwise(F.concat(F.lit("適用版次："), F.col("rule_version"))),
        F.concat(F.lit("審查時間："), F.col("audit_time")), blank,
    )
    passed = F.size(F.filter("all", lambda f: f["status"] == "pass")).cast("string")
    last = F.array(F.concat(F.lit("三、通過項目：共 "), passed, F.lit(" 項，符合規定，無需處理。")))
    return rows.select("doc_id", F.array_join(F.concat(head, *[section(*x) for x in fixed.OPINION], last), "\n").alias("opinion"))


def annotations(findings: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Boxes to draw for failures and warnings that name a page of the document, stacked from the page's top in rule order.

    `doc_id, page, nth, y0, y1, status, title, content`; page_counts: doc_id, total_pages.
    """
    rows = findings.where(F.col("status").isin("fail", "warn")).withColumn("page", evidence_page(F.col("evidence"))).join(page_counts, "doc_id")
    rows = rows.where((F.col("page") > 0) & (F.col("page") <= F.col("total_pages")))
    nth = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("seq")) - 1
    title = F.concat(F.lit("["), "rule_id", F.lit("] "), "rule_name")
    return rows.withColumn("nth", nth).select("doc_id", "page", "nth", (F.lit(6) + F.col("nth") * 30).alias("y0"), (F.lit(32) + F.col("nth") * 30).alias("y1"), "status", title.alias("title"), F.col("message").alias("content"))


def thumbnails(findings: DataFrame, page_counts: DataFrame, most: int = fixed.THUMBNAILS) -> DataFrame:
    """Pages of each document to show: the first `most` distinct ones that evidence names, then those that exist (a report's limit)."""
    pages = findings.select("doc_id", evidence_page(F.col("evidence")).alias("page")).where("page > 0").distinct()
    first = pages.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("page"))).where(F.col("nth") <= most)
    return first.join(page_counts, "doc_id").where(F.col("page") <= F.col("total_pages")).select("doc_id", "page")


def methods(spark: SparkSession) -> DataFrame:
    """The catalogue of rules: `rule_id, rule_name, severity, reference, topic`, in rule order."""
    topics = {"DOC": "doc", "FORM": "form", "CALC": "calc", "PII": "pii", "TERM": "term", "CONS": "cons"}
    rows = [(k, i, n, s, r, topics[i.split("-")[0]]) for k, (i, (n, s, r)) in enumerate(fixed.RULES.items())]
    return spark.createDataFrame(rows, "seq int, rule_id string, rule_name string, severity string, reference string, topic string")
