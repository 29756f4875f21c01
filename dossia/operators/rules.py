"""The rule catalogue: each rule is a list of cases, compiled into one pass over the rows.

What is compiled comes apart: which case of each rule holds is one array of numbers; status, name, severity and reference
are looked up by it; and each text of a finding is a column of its own, built only where the case holds. A query for statuses
so builds no messages: Catalyst drops the columns that nothing asks for.

A finding says what a rule found: status (pass, warn, fail or skip), message, evidence, the three parts of a calculation
as text, and the numbers compared. A row is one document: the review table's fields (`has_table` false or null fields where
there is none), `front` (what front_docs.summary gives), and arrays of personal data, wrong terms, numbers in text and
attachments. Columns that a caller doesn't have count as not extracted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.scalars import accessible_required, first_of, rank_of, within
from dossia.functions.text import fixed_point, python_number, shortest

#: Columns of a document row, with the value of those that a caller leaves out.
INPUT = {
    **{c: "string" for c in ("submission_type", "fill_date")}, **{c: "double" for c in ("base_floor_area", "bonus_floor_area", "bonus_limit")},
    **{c: "int" for c in ("legal_parking", "actual_parking", "accessible_parking", "ev_parking", "raw_page")},
    "front": "struct<poa_count:bigint,purposes:array<string>,has_application:boolean,has_affidavit:boolean,has_review_table:boolean,at:map<string,struct<page:int,from_toc:boolean>>>",
    "pii": "array<struct<page:int,risk_type:string,value:string,severity:string>>", "terms": "array<struct<page:int,wrong_term:string,correct_term:string>>",
    "numbers": "array<struct<page:int,field:string,value:double>>", "attachments": "array<string>",
}
TABLE_PAGE = lambda: F.concat(F.lit("審議資料表第 "), F.coalesce(F.col("raw_page").cast("string"), F.lit("None")), F.lit(" 頁"))


def said(*parts) -> Column:
    """Texts and values in a row; a null value reads as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


@dataclass(frozen=True)
class Outcome:
    """What a case says: a status and texts."""

    status: str
    message: Column
    evidence: Column | None = None
    applied_value: Column | None = None
    expected_calc: Column | None = None
    computed_result: Column | None = None


@dataclass(frozen=True)
class Rule:
    """A rule's cases in order, the last without a condition, and the numbers that it compares."""

    rule_id: str
    rule_name: str
    severity: str
    reference: str
    conditions: list[Column]
    outcomes: list[Outcome]
    computed: Column | None
    expected: Column | None


outcome = Outcome
TEXTS = ["message", "evidence", "applied_value", "expected_calc", "computed_result"]
NUMBERS = ["computed", "expected"]


def finding(rule_id: str, cases: list[tuple[Column, Outcome]], other: Outcome, computed: Column | None = None, limit: Column | None = None, spec: dict | None = None) -> Rule:
    """A rule that gives the outcome of the first case that holds; passes and failures carry its reference."""
    name, severity, reference = fixed.RULES.get(rule_id, ("", "medium", "")) if spec is None else (spec.get("rule_name", ""), spec.get("severity", "medium"), spec.get("reference", ""))
    return Rule(rule_id, name, severity, reference, [c for c, _ in cases], [*(o for _, o in cases), other], computed, limit)


def case_of(rule: Rule) -> Column:
    """The number of the first case that holds."""
    return first_of([(c, F.lit(i)) for i, c in enumerate(rule.conditions)], F.lit(len(rule.conditions)))


def text_of(rule: Rule, case: Column, name: str) -> Column:
    """One text of the case that holds; cases without it give null."""
    own = [(case == i, t) for i, o in enumerate(rule.outcomes) if (t := getattr(o, name)) is not None]
    return first_of(own) if own else F.lit(None).cast("string")


def compiled(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """`keys, seq` and a finding of every rule on every row."""
    none = not rules
    rules = rules or [finding("", [(F.lit(True), outcome("skip", F.lit("")))], outcome("skip", F.lit("")))]
    case = "\0case"  # columns of this name are nobody else's
    told = rows.withColumn(case, F.array(*map(case_of, rules)))
    texts = [F.array(*[text_of(r, F.get(case, i), t) for i, r in enumerate(rules)]).alias(f"\0{t}") for t in TEXTS]
    numbers = [F.array(*[(F.lit(None) if getattr(r, n) is None else getattr(r, n)).cast("double") for r in rules]).alias(f"\0{n}") for n in NUMBERS]
    # there is a case for each rule: `outer` spares the test for none, which would work all of them out twice
    each = told.select(*keys, *texts, *numbers, case).select("*", F.posexplode_outer(case).alias("seq", "\0n"))
    of_rule = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("seq"))
    status = F.get(F.get(F.array(*[F.array(*[F.lit(o.status) for o in r.outcomes]) for r in rules]), F.col("seq")), F.col("\0n"))
    cited = F.get(F.get(F.array(*[F.array(*[F.lit((r.reference or None) if o.status in ("pass", "fail") else None).cast("string") for o in r.outcomes]) for r in rules]), F.col("seq")), F.col("\0n"))
    out = each.select(
        *keys, "seq", of_rule([r.rule_id for r in rules]).alias("rule_id"), of_rule([r.rule_name for r in rules]).alias("rule_name"), status.alias("status"), of_rule([r.severity for r in rules]).alias("severity"),
        F.get("\0message", "seq").alias("message"), F.get("\0evidence", "seq").alias("evidence"), cited.alias("reference"), *[F.get(f"\0{t}", "seq").alias(t) for t in [*TEXTS[2:], *NUMBERS]],
    )
    return out.where("false") if none else out


def no_table(message: str = "審議資料表未能解析") -> tuple[Column, Outcome]:
    return ~F.coalesce(F.col("has_table"), F.lit(False)), outcome("skip", F.lit(message))


def page_evidence(place: Column) -> Column:
    return F.concat(said("第 ", place["page"], " 頁"), F.when(place["from_toc"], "（目錄列出，實際頁面待人工核對）").otherwise(""))


def present_rule(rule_id: str, doc: str, flag: str, found: str, missing: str, table_too: bool = False):
    """A front document is there; the message tells if only the table of contents lists it."""
    def rule() -> Rule:
        place = F.element_at(F.col("front.at"), doc)
        listed = F.coalesce(place["from_toc"], F.lit(False))
        cases = [
            (F.col("front").isNull(), outcome("skip", F.lit("封面文件未能解析"))),
            (F.col(f"front.{flag}"), outcome("pass", F.concat(F.lit(found), F.when(listed, "（僅目錄列出，實際頁面待人工核對）").otherwise("")), page_evidence(place))),
        ]
        if table_too:
            cases.append((F.col("has_table"), outcome("pass", F.lit(found), said("第 ", F.coalesce(F.col("raw_page").cast("string"), F.lit("None")), " 頁"))))
        return finding(rule_id, cases, outcome("fail", F.lit(missing)))

    return rule


application_rule = present_rule("DOC-001", "申請書", "has_application", "申請書已找到", "未找到申請書（都市更新事業計畫申請書）")
affidavit_rule = present_rule("DOC-002", "切結書", "has_affidavit", "切結書已找到", "未找到切結書")
table_rule = present_rule("DOC-004", "審議資料表", "has_review_table", "臺北市都市更新審議資料表已找到", "未找到臺北市都市更新審議資料表", True)


def poa_rule() -> Rule:
    n = F.col("front.poa_count")
    cases = [(F.col("front").isNull(), outcome("skip", F.lit("封面文件未能解析"))), (n >= 1, outcome("pass", said("找到 ", n, " 份委託書"), F.array_join("front.purposes", "、")))]
    return finding("DOC-003", cases, outcome("fail", F.lit("未找到任何委託書")), n)


def type_rule() -> Rule:
    t = F.col("submission_type")
    return finding("FORM-001", [no_table(), (t.isin(fixed.SUBMISSION_TYPES), outcome("pass", said("送審類別：", t)))], outcome("warn", F.lit("送審類別未能從審議資料表識別，請人工確認")))


def fill_date_rule() -> Rule:
    d = F.col("fill_date")
    return finding("FORM-002", [no_table(), (F.coalesce(d, F.lit("")) != "", outcome("pass", said("填表日期：", d)))], outcome("warn", F.lit("填表日期未能識別，請人工確認")))


def bonus_rule() -> Rule:
    bonus, limit, own_base = F.col("bonus_floor_area"), F.col("bonus_limit"), F.col("base_floor_area")
    top = F.coalesce(limit, own_base * fixed.BONUS_SHARE)
    base = F.coalesce(F.nullif(own_base, F.lit(0.0)), top * 2)
    ratio = F.when(base > 0, bonus / base * 100).otherwise(0.0)
    a, p = fixed_point, fixed_point(ratio, 1, False)
    over = a(bonus - top)
    applied = said("獎勵樓地板面積 ", a(bonus), " m²")
    expected = said("基準容積 ", a(base), " × 50% = 上限 ", a(top), " m²", F.when(limit.isNull(), "（依基準×50%推算）").otherwise(""), "（都更條例第65條）")
    fail = outcome(
        "fail", said("申請額 ", a(bonus), "m² 超過上限 ", a(top), "m²，差距 ", over, "m²，獎勵比率 ", p, "%"), TABLE_PAGE(), applied, expected,
        said("超出上限 ", over, " m²，獎勵比率 ", p, "% ＞ 50%"),
    )
    ok = outcome("pass", said("容積獎勵 ", a(bonus), "m² ≤ 上限 ", a(top), "m²"), TABLE_PAGE(), applied, expected, said("未超上限，獎勵比率 ", p, "% ≤ 50%"))
    unknown = outcome("warn", F.lit("容積獎勵申請額度或上限無法從審議資料表解析，請人工核對"), TABLE_PAGE())
    return finding("CALC-001", [no_table(), (bonus.isNull() | top.isNull(), unknown), (bonus > top + fixed.BONUS_SLACK, fail)], ok, F.when(top.isNotNull(), ratio), top)


def accessible_rule() -> Rule:
    legal, own = F.col("legal_parking"), F.col("accessible_parking")
    need = accessible_required(legal)
    applied = said("無障礙停車位 ", own, " 輛")
    expected = said("法定停車 ", legal, " 輛 → 依建築技術規則§167-6 應設 ", need, " 輛")
    fail = outcome(
        "fail", said("法定(含無障礙)汽車停車位 ", legal, " 輛，依建築技術規則應設 ", need, " 輛無障礙停車位，但填寫為 ", own, " 輛"), TABLE_PAGE(), applied, expected,
        said("短少 ", need - own, " 輛（", own, " ＜ ", need, "）"),
    )
    ok = outcome("pass", said("無障礙停車位 ", own, " 輛 ≥ 法定要求 ", need, " 輛（法定停車 ", legal, " 輛）"), TABLE_PAGE(), applied, expected, said("符合（", own, " ≥ ", need, "）"))
    free = outcome("pass", said("無障礙停車位 ", own, " 輛", F.when(legal.isNotNull(), said("（法定 ", legal, " 輛）")).otherwise("")), TABLE_PAGE())
    cases = [no_table(), (own.isNull(), outcome("warn", F.lit("無障礙停車位欄位無法從審議資料表解析，請人工確認"), TABLE_PAGE())), ((legal > 0) & (own < need), fail), (legal > 0, ok)]
    return finding("CALC-002", cases, free, own, need)


def parking_rule() -> Rule:
    legal, own = F.col("legal_parking"), F.col("actual_parking")
    applied, expected = said("實設汽車停車位 ", own, " 輛"), said("法定(含無障礙)汽車停車位 ", legal, " 輛（建築技術規則第59條）")
    fail = outcome("fail", said("實設汽車停車位 ", own, " 輛低於法定要求 ", legal, " 輛，差距 ", legal - own, " 輛"), TABLE_PAGE(), applied, expected, said("短少 ", legal - own, " 輛（", own, " ＜ ", legal, "）"))
    ok = outcome("pass", said("實設 ", own, " 輛 ≥ 法定 ", legal, " 輛"), TABLE_PAGE(), applied, expected, said("符合（", own, " ≥ ", legal, "）"))
    cases = [no_table(), (legal.isNull() | own.isNull(), outcome("warn", F.lit("實設或法定(含無障礙)汽車停車位資料不足，建議人工確認"))), (own < legal, fail)]
    return finding("CALC-003", cases, ok, own, legal)


def limit_rule() -> Rule:
    limit, base = F.col("bonus_limit"), F.col("base_floor_area")
    want, a = base * fixed.BONUS_SHARE, fixed_point
    off = F.abs(limit - want)
    applied = said("容積獎勵上限（填報）", a(limit), " m²")
    expected = said("基準容積 ", a(base), " × 50% = ", a(want), " m²（都更條例第65條）")
    fail = outcome(
        "fail", said("容積獎勵上限 ", a(limit), "m² 與計算值 ", a(want), "m² （基準 ", a(base), "m² × 50%）差距 ", fixed_point(off, 2, False), "m²，超過允許誤差"), TABLE_PAGE(), applied, expected,
        said("與計算值差距 ", a(off), f" m²，超過允許誤差 {fixed.LIMIT_TOLERANCE} m²"),
    )
    ok = outcome(
        "pass", said("容積獎勵上限 ", a(limit), "m² 與計算值一致（", a(base), "m² × 50% = ", a(want), "m²）"), TABLE_PAGE(), applied, expected,
        said("與計算值一致（差 ", a(off), f" m² ≤ 允許誤差 {fixed.LIMIT_TOLERANCE} m²）"),
    )
    return finding("CALC-004", [no_table(), (off.isNull(), outcome("warn", F.lit("基準樓地板面積或容積獎勵上限資料不足，建議人工確認"))), (off > fixed.LIMIT_TOLERANCE, fail)], ok, limit, want)


def ev_rule() -> Rule:
    ev = F.col("ev_parking")
    page = F.when(F.coalesce(F.col("raw_page"), F.lit(0)) != 0, TABLE_PAGE())
    cases = [no_table(), (ev.isNotNull(), outcome("pass", said("充電車位欄位已填寫：", ev, " 輛"), TABLE_PAGE()))]
    return finding("FORM-003", cases, outcome("fail", F.lit("充電車位欄位未在審議資料表中找到，可能使用舊版格式"), page), ev)


def pii_rule() -> Rule:
    """Any HIGH fails, any MEDIUM warns; the first five are the evidence."""
    all_ = F.coalesce("pii", F.array().cast(INPUT["pii"]))
    of = lambda s: F.filter(all_, lambda x: x["severity"] == s)
    items = lambda s: F.array_join(F.transform(F.slice(of(s), 1, 5), lambda x: F.concat(F.lit("P."), x["page"].cast("string"), F.lit(" "), x["risk_type"], F.lit("："), x["value"])), "; ")
    n = lambda s: F.size(of(s))
    cases = [
        (F.size(all_) == 0, outcome("pass", F.lit("封面文件未偵測到個資風險"))),
        (n("HIGH") > 0, outcome("fail", said("偵測到 ", n("HIGH"), " 處高風險個資（住宅地址/身分證號），上傳雲端版本必須遮蔽"), items("HIGH"))),
        (n("MEDIUM") > 0, outcome("warn", said("偵測到 ", n("MEDIUM"), " 處中風險個資（電話號碼），建議確認上傳版本是否需要遮蔽"), items("MEDIUM"))),
    ]
    return finding("PII-001", cases, outcome("pass", F.lit("未偵測到高風險個資")), n("HIGH"))


def term_rule() -> Rule:
    all_ = F.coalesce("terms", F.array().cast(INPUT["terms"]))
    items = F.array_join(F.transform(all_, lambda x: F.concat(F.lit("P."), x["page"].cast("string"), F.lit("「"), x["wrong_term"], F.lit("」應為「"), x["correct_term"], F.lit("」"))), "; ")
    cases = [(F.size(all_) == 0, outcome("pass", F.lit("未偵測到法定用詞錯誤")))]
    return finding("TERM-001", cases, outcome("fail", said("發現 ", F.size(all_), " 處用詞錯誤，請核對後修正"), items), F.size(all_))


def number_rule() -> Rule:
    """Numbers in the text against the review table's: one that is off fails, none at all warns."""
    all_ = F.coalesce("numbers", F.array().cast(INPUT["numbers"]))
    pick = lambda x, of: F.coalesce(*[F.when(x["field"] == f, of(f)) for f in fixed.NUMBER_LABELS])
    want = lambda x: pick(x, lambda f: F.col(f).cast("double"))
    off = F.filter(all_, lambda x: F.abs(x["value"] - want(x)) > fixed.NUMBER_TOLERANCE)
    shown = lambda x: pick(x, lambda f: python_number(F.col(f)) if f in fixed.FLOAT_FIELDS else F.col(f).cast("string"))
    line = lambda x: F.concat(pick(x, lambda f: F.lit(fixed.NUMBER_LABELS[f])), F.lit("：審議資料表="), shown(x), F.lit("，P."), x["page"].cast("string"), F.lit("="), python_number(x["value"]))
    cases = [
        no_table("審議資料表未能解析，無法執行一致性檢查"),
        (F.size(all_) == 0, outcome("warn", F.lit("未能從主文取得數字資料，建議人工核對審議資料表與各章節數字是否一致"))),
        (F.size(off) > 0, outcome("fail", said("發現 ", F.size(off), " 處數字不一致，請核對後修正"), F.array_join(F.transform(off, line), "; "))),
    ]
    return finding("CONS-001", cases, outcome("pass", F.lit("審議資料表關鍵數字與主文一致")), F.size(off))


#: All rules in their order, and those of the review table alone.
BUILTIN = [application_rule, affidavit_rule, poa_rule, table_rule, type_rule, fill_date_rule, bonus_rule, accessible_rule, parking_rule, limit_rule, ev_rule, pii_rule, term_rule, number_rule]
TABLE_RULES = [type_rule, fill_date_rule, bonus_rule, accessible_rule, ev_rule, parking_rule, limit_rule]

#: Comparisons that a configured rule may name; another name makes the rule skip.
COMPARE = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}


def configured(spec: dict, columns: set[str] = frozenset(INPUT)) -> Rule:
    """A rule given as data: review_field_present, formula_check, threshold or attachment_present; drafts and others skip."""
    kind, rule, name = spec.get("type"), spec["rule_id"], spec.get("rule_name", "")
    skip = lambda *parts: outcome("skip", said(*parts))
    own = lambda f: F.col(f) if f in columns else F.lit(None).cast("double")
    shown = lambda f: F.when(own(f) == F.floor(own(f)), F.format_string("%d", own(f).cast("long"))).otherwise(own(f).cast("string")) if f in fixed.INT_FIELDS else own(f).cast("string") if f in fixed.TEXT_FIELDS else python_number(own(f))
    missing = no_table("審議資料表未解析")
    always = F.lit(True)
    if not spec.get("enabled", True):
        cases, other, a, b = [(always, skip(f"草稿規則（待承辦複核／extractor 支援）：{spec.get('source_clause', '')}"))], skip(""), None, None
    elif kind == "review_field_present":
        cases = [missing, (own(spec["field"]).isNotNull(), outcome("pass", said(f"{name}：已具備（值 = ", shown(spec["field"]), "）")))]
        other, a, b = outcome("fail", F.lit(f"{name}：缺欄位或未讀到")), None, None
    elif kind == "formula_check":
        ref, factor = spec.get("ref_field") or spec["field"], float(spec["factor"])
        a, base = own(spec["target"]).cast("double"), own(ref).cast("double")
        b = base * factor
        applied, calc, result = said(f"{spec['target']} 申報 ", shortest(a)), said(f"{ref}(", shortest(base), ") × ", shortest(F.lit(factor)), " = ", shortest(b)), shortest(b)
        ok = outcome("pass", F.lit(f"{name}：相符"), None, applied, calc, result)
        cases = [missing, (a.isNull() | b.isNull(), skip(f"缺數值：{spec['target']} 或 {ref}")), (within(a, b, float(spec.get("tolerance", fixed.PLAYBOOK_TOLERANCE))), ok)]
        other = outcome("fail", said(f"{name}：不符（申報 ", shortest(a), "，應為 ", shortest(b), "）"), None, applied, calc, result)
    elif kind == "threshold":
        op, a = spec.get("op"), own(spec["field"]).cast("double")
        b = own(spec["ref_field"]).cast("double") if spec.get("ref_field") else F.lit(float(spec["value"]))
        label = spec.get("ref_field") or str(float(spec["value"]))
        applied, calc = said(f"{spec['field']} = ", shortest(a)), said(f"需 {op} {label}(", shortest(b), ")")
        cases = [missing, (a.isNull(), skip(f"缺數值：{spec['field']}"))]
        if op in COMPARE:
            cases += [(b.isNull(), skip(f"缺對照值：{label}")), (COMPARE[op](a, b), outcome("pass", F.lit(f"{name}：符合"), None, applied, calc, shortest(b)))]
            other = outcome("fail", said(f"{name}：不符（", shortest(a), f" 未 {op} ", shortest(b), "）"), None, applied, calc, shortest(b))
        else:
            other = skip(f"未支援運算子：{op}")
    elif kind == "attachment_present":
        cases = [(F.col("attachments").isNull(), skip("附錄清單未偵測（extractor 未回傳）")), (F.array_contains("attachments", spec["attachment"]), outcome("pass", F.lit(f"{name}：已檢附")))]
        other, a, b = outcome("fail", F.lit(f"{name}：未檢附（111年版必附）")), None, None
    else:
        cases, other, a, b = [(always, skip(f"規則型別「{kind}」尚未支援（待 extractor/實作）"))], skip(""), None, None
    return finding(rule, cases, other, a, b, spec)


def evaluate(rows: DataFrame, keys: list[str], playbook: list[dict] = (), rules: list | None = None, drafts: bool = False) -> DataFrame:
    """`keys, seq` and a finding: every rule on every row, in rule order, without a join.

    rules: all by default, those of the review table where the rows have no front documents. drafts: also gives the configured
    rules that aren't enabled, as skips.
    """
    if rules is None:
        rules = BUILTIN if "front" in rows.columns else TABLE_RULES
    if "has_table" not in rows.columns:
        rows = rows.withColumn("has_table", F.lit(True))
    columns = {*rows.columns, *INPUT}
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in INPUT.items() if c not in rows.columns])
    built = [r() for r in rules] + [configured(s, columns) for s in playbook if drafts or s.get("enabled", True)]
    return compiled(rows, keys, built)


def consent_rules(rows: DataFrame) -> DataFrame:
    """`id, rule_ids` of extracted fields: LAW-FAR-001, LAW-CON-001/002 and CONS-DATE-001 where they are violated."""
    total = F.coalesce(F.col("bonus_total_pct"), F.aggregate("bonus_items", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
    pair = F.when(F.col("reg_year") == "113", F.array(*map(F.lit, fixed.CONSENT["113"]))).otherwise(F.array(*map(F.lit, fixed.CONSENT_DEFAULT)))
    hits = F.array_compact(F.array(
        F.when(total > fixed.BONUS_CAP_PCT, "LAW-FAR-001"), F.when(F.col("owner_pct") < pair[0], "LAW-CON-001"), F.when(F.col("area_pct") < pair[1], "LAW-CON-002"),
        F.when(F.size(F.array_distinct(F.array_compact(F.col("dates")))) > 1, "CONS-DATE-001"),
    ))
    return rows.select("id", hits.alias("rule_ids"))


def ordered(findings: DataFrame, *more: str) -> DataFrame:
    """By status, then severity, then the order of the rules."""
    return findings.orderBy(rank_of(F.col("status"), fixed.STATUS_RANK), rank_of(F.col("severity"), fixed.SEVERITY_RANK), *more, "seq")


def counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Critical and high failures, warnings, passes and skips."""
    n = lambda test, name: F.count_if(test).alias(name)
    fail = F.col("status") == "fail"
    of = lambda s: F.col("status") == s
    return findings.groupBy(*by).agg(
        n(fail & (F.col("severity") == "critical"), "critical_count"), n(fail & (F.col("severity") == "high"), "high_count"), n(of("warn"), "warn_count"), n(of("pass"), "pass_count"), n(of("skip"), "skip_count"),
    )


#: Views of findings, by name.
VIEWS = {
    "critical_fails": lambda: (F.col("status") == "fail") & (F.col("severity") == "critical"), "high_fails": lambda: (F.col("status") == "fail") & (F.col("severity") == "high"),
    "warnings": lambda: F.col("status") == "warn", "passes": lambda: F.col("status") == "pass",
}


def view(findings: DataFrame, name: str) -> DataFrame:
    return findings.where(VIEWS[name]())
