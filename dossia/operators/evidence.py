"""Findings of models as tables: malformed ones out, critical ones verified, quotes grounded, and two documents compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.text import fixed_point
from dossia.operators import compare

LLM = "array<struct<rule_id:string,error_type:string,severity:string,detected_text:string,suggested_text:string,reason:string,page_number:string>>"


def parsed_findings(answers: DataFrame, by: list[str], column: str = "answer") -> DataFrame:
    """Findings in a model's JSON answers: an object's `findings`, an array or an array as a string, without those that lack a field, name
    an unknown type or severity, or have a page that is no number. A missing page is 0."""
    text = F.coalesce(F.get_json_object(column, "$.findings"), F.col(column))
    rows = answers.select(*by, F.posexplode(F.from_json(text, LLM)).alias("seq", "x")).select(*by, "seq", "x.*")
    page = F.when(F.col("page_number").isNull(), 0).otherwise(F.col("page_number").try_cast("int"))
    needed = F.lit(True)
    for c in ("rule_id", "detected_text", "reason"):
        needed = needed & F.col(c).isNotNull()
    ok = needed & F.col("error_type").isin(fixed.LLM_ERROR_TYPES) & F.col("severity").isin(fixed.LLM_SEVERITIES)
    kept = rows.where(F.coalesce(ok & page.isNotNull(), F.lit(False)))
    return kept.withColumn("page_number", page).withColumn("suggested_text", F.coalesce("suggested_text", F.lit("")))


def verified_findings(findings: DataFrame, verdicts: DataFrame | None, key: list[str]) -> DataFrame:
    """Critical findings that a second model refuted go; those without a verdict, or where it failed, stay.

    verdicts: key, confirmed (null: the call failed). Rows of a key stand together, by page, critical ones last; keys have no order.
    """
    if verdicts is not None:
        said = verdicts.select(*key, F.col("confirmed").alias("confirmed_"))
        refuted = (F.col("severity") == "critical") & ~F.coalesce("confirmed_", F.lit(True))
        findings = findings.join(said, key, "left").where(~refuted).drop("confirmed_")
    return findings.repartition(*key).sortWithinPartitions(*key, "page_number", F.col("severity") == "critical", "seq")


def grounded_evidence(findings: DataFrame, citations: DataFrame | None, key: list[str]) -> DataFrame:
    """Evidence of each finding: the quote if it was found in the text (`found`), else what was cited elsewhere for a critical one.

    `cited_text, verified, evidence_source`; citations: key, cited_text.
    """
    out = findings
    cited = F.lit(None).cast("string")
    if citations is not None:
        out = out.join(citations.select(*key, F.col("cited_text").alias("api_text")), key, "left")
        cited = F.when((F.col("severity") == "critical") & ~F.col("found"), F.nullif(F.col("api_text"), F.lit("")))
    by_api = cited.isNotNull()
    out = out.withColumn("evidence_source", F.when(by_api, "citations_api").otherwise("offline")).withColumn("verified", F.col("found") | by_api).withColumn("cited_text", F.coalesce(cited, "quote"))
    return out.drop("api_text")


def evidence_of(findings: DataFrame, pages: DataFrame, citations: DataFrame | None, key: list[str], quote: str = "quote") -> DataFrame:
    """Findings with their evidence: each quote is looked for in its own document's pages, and what isn't found may be cited (see grounded_evidence)."""
    return grounded_evidence(compare.quote_places(findings, pages, key, quote).withColumnRenamed(quote, "quote"), citations, key)


def extracted(answers: DataFrame, by: list[str], column: str = "answer") -> DataFrame:
    """Fields of a model's JSON answer: bonus items (those without name or rate go), shares, dates, name and area; what doesn't parse is null."""
    item = "array<struct<name:string,rate_pct:string,legal_basis:string>>"
    items = F.from_json(F.get_json_object(column, "$.bonus_items"), item)
    items = F.transform(items, lambda x: F.struct(x["name"].alias("name"), x["rate_pct"].try_cast("double").alias("rate_pct"), F.coalesce(x["legal_basis"], F.lit("")).alias("legal_basis")))
    items = F.coalesce(F.filter(items, lambda x: x["name"].isNotNull() & x["rate_pct"].isNotNull()), F.array().cast("array<struct<name:string,rate_pct:double,legal_basis:string>>"))
    number = lambda p: F.get_json_object(column, p).try_cast("double")
    text = lambda p: F.nullif(F.trim(F.get_json_object(column, p)), F.lit(""))
    return answers.select(
        *by, items.alias("bonus_items"), number("$.bonus_total_pct").alias("bonus_total_pct"), number("$.consent_ratio.owner_count_pct").alias("owner_pct"), number("$.consent_ratio.land_area_pct").alias("area_pct"),
        text("$.dates.application_date").alias("application_date"), text("$.dates.affidavit_date").alias("affidavit_date"), text("$.dates.power_of_attorney_date").alias("power_of_attorney_date"),
        text("$.implementer_name").alias("implementer_name"), number("$.land_area_sqm").alias("land_area_sqm"),
    )


def field_findings(rows: DataFrame) -> DataFrame:
    """What the extracted fields violate, with values and reasons: `id, seq, field_name, rule_id, severity, actual_value, expected, reason`.

    rows: id, reg_year, bonus_total_pct, bonus_items array<double>, owner_pct, area_pct and the three dates.
    """
    none = F.lit(None)
    f = lambda c, d: fixed_point(c, d, False)
    stated, cap = F.col("bonus_total_pct"), f"{fixed.BONUS_CAP_PCT:.0f}"
    total = F.aggregate(F.coalesce("bonus_items", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    owner_least = F.when(F.col("reg_year") == "113", fixed.CONSENT["113"][0]).otherwise(fixed.CONSENT_DEFAULT[0])
    area_least = F.when(F.col("reg_year") == "113", fixed.CONSENT["113"][1]).otherwise(fixed.CONSENT_DEFAULT[1])

    def hit(test, *values):
        names = ("field_name", "rule_id", "severity", "actual_value", "expected", "reason")
        return F.when(test, F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, values)]))

    dates = [("申請書", "application_date"), ("切結書", "affidavit_date"), ("委託書", "power_of_attorney_date")]
    known = F.array_distinct(F.array_compact(F.array(*[F.col(c) for _, c in dates])))
    shown = F.concat_ws("、", *[F.concat(F.lit(f"{n}="), F.col(c)) for n, c in dates])
    law, consent = f"≤ {cap}%（都更條例第65條）", "%（都更條例第22條第1項）"
    hits = [
        hit(stated > fixed.BONUS_CAP_PCT, "容積獎勵合計", "LAW-FAR-001", "critical", F.concat(f(stated, 1), F.lit("%")), law, F.concat(F.lit("容積獎勵合計 "), f(stated, 1), F.lit(f"% 超過法定上限 {cap}%。請重新核算各獎勵項目比率。"))),
        hit(stated.isNull() & (total > fixed.BONUS_CAP_PCT), "容積獎勵合計（推算）", "LAW-FAR-001", "critical", F.concat(f(total, 1), F.lit("%（各項合計）")), law, F.concat(F.lit("各獎勵項目加總 "), f(total, 1), F.lit("% 超過法定上限，且文件未列合計欄位，可能有漏報。"))),
        hit(F.col("owner_pct") < owner_least, "土地所有權人同意比率", "LAW-CON-001", "critical", F.concat(f(F.col("owner_pct"), 2), F.lit("%")), F.concat(F.lit("≥ "), f(owner_least, 2), F.lit(consent)), F.concat(F.lit("土地所有權人同意比率 "), f(F.col("owner_pct"), 2), F.lit("% 未達法定門檻 "), f(owner_least, 2), F.lit("%。"))),
        hit(F.col("area_pct") < area_least, "土地面積同意比率", "LAW-CON-002", "critical", F.concat(f(F.col("area_pct"), 2), F.lit("%")), F.concat(F.lit("≥ "), f(area_least, 0), F.lit(consent)), F.concat(F.lit("土地面積同意比率 "), f(F.col("area_pct"), 2), F.lit("% 未達法定門檻 "), f(area_least, 0), F.lit("%。"))),
        hit(F.size(known) > 1, "報核日期一致性", "CONS-DATE-001", "warning", shown, "三份文件日期應相同", "申請書、切結書、委託書的報核日期不一致。依審議慣例三份文件應填寫同一日期。"),
    ]
    del none
    return rows.select("id", F.posexplode(F.array_compact(F.array(*hits))).alias("seq", "x")).select("id", "seq", "x.*")


def cross_document(plans: DataFrame, exchanges: DataFrame, by: str = "case_id") -> DataFrame:
    """What two documents of a case say differently: area by more than 0.5, owners at all, values by more than 1.0, names trimmed.

    `by, seq, field_name, rule_id, severity, business_plan_value, rights_exchange_value`; fields that one document lacks are left out.
    """
    fields = [c for c, *_ in fixed.SHARED] + ["implementer_name"]
    both = plans.select(by, *[F.col(c).alias(f"a_{c}") for c in fields]).join(exchanges.select(by, *[F.col(c).alias(f"b_{c}") for c in fields]), by)

    def hit(test, name, rule, severity, a, b):
        values = (("field_name", F.lit(name)), ("rule_id", F.lit(rule)), ("severity", F.lit(severity)), ("business_plan_value", a), ("rights_exchange_value", b))
        return F.when(test, F.struct(*[v.alias(n) for n, v in values]))

    hits = []
    for column, name, rule, severity, unit, tolerance, decimals in fixed.SHARED:
        a, b = F.col(f"a_{column}"), F.col(f"b_{column}")
        shown = lambda c, d=decimals, u=unit: F.concat(fixed_point(c, d, False), F.lit(f" {u}"))
        hits.append(hit(F.abs(a - b) > tolerance, name, rule, severity, shown(a), shown(b)))
    a, b = F.nullif(F.col("a_implementer_name"), F.lit("")), F.nullif(F.col("b_implementer_name"), F.lit(""))
    hits.append(hit(F.trim(a) != F.trim(b), "實施者名稱", "CONS-IMP-001", "critical", a, b))
    return both.select(by, F.posexplode(F.array_compact(F.array(*hits))).alias("seq", "x")).select(by, "seq", "x.*")


def ai_findings(failing: DataFrame, llm: DataFrame | None = None, fields: DataFrame | None = None, cross: DataFrame | None = None, pages: DataFrame | None = None, citations: DataFrame | None = None) -> DataFrame:
    """The findings of all three sources as one table, with evidence, confidence and what made it up.

    llm: doc_id, seq and what parsed_findings gives; with pages (doc_id, page_num, text) their quotes are looked for there, without they
    count as unverified. fields: doc_id, seq and what field_findings gives. cross: doc_id, seq and what cross_document gives. failing: doc_id and
    rule_id of the rules that failed; a finding is corroborated by those of its own document.

    `doc_id, source, seq, rule_id, severity, field_name, detected_text, reason, page_number, evidence_text, evidence_source, verified, topic,
    corroborated, confidence, needs_review, factors`.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def shaped(rows, source, field_name, text, reason, page, evidence=None, kind=None, verified=None):
        return rows.select(
            "doc_id", F.lit(source).alias("source"), F.col("seq").cast("int").alias("seq"), "rule_id", "severity", field_name.alias("field_name"), text.alias("detected_text"), reason.alias("reason"), page.cast("int").alias("page_number"),
            (none("string") if evidence is None else evidence).alias("evidence_text"), (none("string") if kind is None else kind).alias("evidence_source"), (F.lit(False) if verified is None else verified).alias("verified"),
        )

    parts = []
    if llm is not None:
        found = llm.select("*", F.col("detected_text").alias("quote"))
        if pages is None:
            found = found.withColumns({"cited_text": none("string"), "evidence_source": none("string"), "verified": F.lit(False)})
        else:
            found = evidence_of(found, pages.select("doc_id", F.col("page_num"), "text"), citations, ["doc_id", "seq"])
        parts.append(shaped(found, "llm", F.col("error_type"), F.col("detected_text"), F.col("reason"), F.col("page_number"), F.col("cited_text"), F.col("evidence_source"), F.col("verified")))
    if fields is not None:
        page = F.col("page_number") if "page_number" in fields.columns else F.lit(0)
        parts.append(shaped(fields, "field", F.col("field_name"), F.col("actual_value"), F.col("reason"), page))
    if cross is not None:
        both = F.concat(F.lit("事業計畫書："), "business_plan_value", F.lit("／權利變換計畫書："), "rights_exchange_value")
        parts.append(shaped(cross, "cross", F.col("field_name"), both, F.col("reason") if "reason" in cross.columns else none("string"), F.lit(0)))
    if not parts:
        raise ValueError("give the findings of one source at least")
    out = compare.confidence(reduce(DataFrame.unionByName, parts), failing, ["doc_id"])
    return out.withColumn("factors", factors(F.col("source"), F.col("verified"), F.col("corroborated"), F.col("confidence"), F.col("severity") == "critical"))


def factors(source: Column, verified: Column, corroborated: Column, value: Column, critical: Column) -> Column:
    """What made up a confidence, as text, in order."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fixed.CONFIDENCE_BASE.items() for x in kv]), source), F.lit(fixed.CONFIDENCE_OTHER))
    low = value < fixed.REVIEW_BELOW
    return F.array_compact(F.array(
        F.concat(F.lit("來源基準 "), source, F.lit("（"), fixed_point(base), F.lit("）")),
        F.when(verified, f"原文已核對（+{fixed.EVIDENCE_BOOST:.2f}）").when(source == "llm", f"原文未核對（-{-fixed.UNVERIFIED_LLM:.2f}）"),
        F.when(corroborated, f"與規則引擎一致（+{fixed.CORROBORATED:.2f}）"),
        F.when(low, "信心低於門檻 → 需人工複核").when(critical & ~verified, "critical 且原文未核對 → 需人工複核"),
    ))
