"""The audit as one plan over many documents: pages in, findings, dates, numbers, opinion and comparisons out.

Each page is read once and told all at once: what front document it is, whether it may be the review table, and what scans find in
it. One grouping by document gathers this, and no text goes there but the table's and what may hold a filing date. The rows of
documents are kept as a table, from which everything else follows. Results of models (detections, cells, transcriptions, model
findings) are optional tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.dates import iso_date
from dossia.operators import compare, front_docs, history, report, review_table, rules, scans
from dossia.sources.shared import kept


def gathered(rows: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows of a document as one array of structs, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("x")))), lambda r: r["x"])
    return rows.groupBy("doc_id").agg(listed.alias(name))


def with_page(found: Column, fields: list[str]) -> Column:
    """The structs of a page's array with these fields, the page's number first."""
    return F.transform(found, lambda x: F.struct(F.col("page_num").cast("int").alias("page"), *[x[f].alias(f) for f in fields]))


def page_facts(pages: DataFrame) -> DataFrame:
    """All that the audit reads of a page, in one row: see front_docs.page_docs, and `candidate, pii, terms, numbers, names`."""
    if "read" not in pages.columns:
        pages = pages.withColumn("read", F.lit(None).cast("string"))
    text, page = F.col("text"), F.col("page_num")
    within = lambda span, found: F.when(page.between(*span), found)
    numbers = F.filter(scans.numbers_found(text), lambda x: x["value"].isNotNull())
    return front_docs.page_docs(
        pages, review_table.candidate(text, F.col("read"), page).alias("candidate"), with_page(within((1, fixed.FRONT_SCAN), scans.pii_found(text)), ["risk_type", "value", "severity"]).alias("pii"),
        with_page(within(fixed.TERM_PAGES, scans.terms_found(text)), ["wrong_term", "correct_term"]).alias("terms"), with_page(within(fixed.NUMBER_PAGES, numbers), ["field", "value"]).alias("numbers"),
        scans.page_attachments(text, page).alias("names"),
    )


def documents(docs: DataFrame | None, pages: DataFrame, **tiers: DataFrame | None) -> DataFrame:
    """One row a document with all that the rules read. docs: doc_id, filename; without it, documents are those that have pages."""
    def in_order(name: str) -> Column:
        some = F.when(F.size(name) > 0, F.struct("page_num", F.col(name).alias("x")))
        all_ = F.flatten(F.transform(F.array_sort(F.collect_list(some)), lambda r: r["x"]))
        return F.when(F.size(all_) > 0, all_).alias(name)

    told = ["candidate", "pii", "terms", "numbers", "attachments", "total_pages"]
    got = page_facts(pages).groupBy("doc_id").agg(
        *front_docs.aggregates(), F.min("candidate").alias("candidate"), *map(in_order, ("pii", "terms", "numbers")), scans.gathered_attachments(F.col("names")).alias("attachments"), F.max("page_num").alias("total_pages"),
    )
    out = front_docs.summarised(front_docs.told(got, *told), *told)
    # the rules' view of the front documents, as one struct
    at = F.transform_values("at", lambda _, v: F.struct(v["page"].cast("int").alias("page"), v["from_toc"].alias("from_toc")))
    fields = F.struct("poa_count", "purposes", "has_application", "has_affidavit", "has_review_table", at.alias("at")).cast(rules.INPUT["front"])
    out = out.select(
        "doc_id", *told[1:], fields.alias("front"), F.col("report_date").alias("front_date"), F.col("report_date_page").alias("front_page"), F.col("report_date_source").alias("front_source"),
        F.col("candidate.page_num").alias("page_num"), F.col("candidate.text").alias("text"), F.col("candidate").isNotNull().alias("has_table"),
    )
    own = [*told[1:], "front", "front_date", "front_page", "front_source", "has_table"]
    out = review_table.verified(review_table.cascade(review_table.parsed(out, *own), ["doc_id"], **tiers), ["doc_id"])
    out = out.withColumn("residual", F.when(F.col("has_table"), F.col("residual")))
    if docs is None:
        return out.withColumn("filename", F.lit(None).cast("string"))
    return docs.select("doc_id", "filename").join(out, "doc_id", "left").withColumn("has_table", F.coalesce("has_table", F.lit(False)))


def findings(docs: DataFrame | None, pages: DataFrame, playbook: list[dict] = (), **tiers: DataFrame | None) -> DataFrame:
    """Every rule's finding on every document: `doc_id, seq, rule_id, ...`, in one pass over the pages and one shuffle of what they tell."""
    return rules.evaluate(documents(docs, pages, **tiers), ["doc_id"], playbook)


def audit(docs: DataFrame, pages: DataFrame, playbook: list[dict] = (), runs: DataFrame | None = None, audit_time: str | None = None, **tiers: DataFrame | None) -> dict[str, DataFrame]:
    """Every table of an audit by name. docs: doc_id, filename; pages: doc_id, page_num, text (and `read` of image pages).

    The documents' rows are written once to the shared folder, which whoever asked for the audit clears.
    """
    rows = kept(documents(docs, pages, **tiers), "audit")
    findings = rules.evaluate(rows, ["doc_id"], playbook)
    dates = report.report_dates(rows)
    dated = compare.version_asof(dates.withColumn("iso", iso_date(F.col("report_date"))), "iso")
    now = F.lit(audit_time) if audit_time else F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "Asia/Taipei"), "yyyy-MM-dd HH:mm")
    heads = rows.select("doc_id", F.coalesce(F.nullif("case_name", F.lit("")), "filename").alias("case_name"), "filename").join(dated, "doc_id")
    heads = heads.withColumnRenamed("version", "rule_version").withColumn("audit_time", now)
    none = [F.lit(None).cast("string").alias(c) for c in ("report_date_secondary", "report_date_secondary_source")]
    counts = rows.select("doc_id", "total_pages").where("total_pages is not null")
    pii = rows.select("doc_id", F.explode("pii").alias("p")).select("doc_id", "p.*")
    encoded = history.encoded(findings).join(heads, "doc_id").where(~history.is_test(F.col("filename"), F.col("case_name")))
    out = {
        "documents": rows, "findings": findings, "dates": heads, "key_numbers": report.key_numbers(rows.join(dates, "doc_id").select("*", *none)), "opinion": report.opinion(findings, heads),
        "annotations": report.annotations(findings, counts), "thumbnails": report.thumbnails(findings, counts), "metrics": history.metrics(findings, rows, pii),
        "runs": encoded.select("case_name", "audit_time", F.col("rule_version").alias("rule_ver"), "findings"),
    }
    if runs is not None:
        last = runs.groupBy("case_name").agg(F.max_by("findings", "id").alias("findings"))
        before = history.decoded(last.join(heads.select("doc_id", "case_name"), "case_name"), ["doc_id"])
        out["diff"] = history.finding_diff(findings.select("doc_id", "seq", "rule_id", "rule_name", "status", "message"), before, ["doc_id"])
        out["peers"] = history.peer_stats(history.migrated(runs))
    return out
