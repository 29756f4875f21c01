"""Operators on small audit fixtures: cases that the SQL over whole tables doesn't reach."""

import io
import json
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from dossia.functions import dates, text
from dossia.operators import audit, compare, evidence, history, pages, report, review_table, rules, scans, summaries, templates
from dossia.sources import files

BOX = "doc_id int, page_num int, seq int, text string, conf double, x0 double, x1 double, yc double, h double"


def each(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(f(F.col("v")).alias("x"))
    return [r.x for r in rows.collect()]


def test_nfkc(spark):
    texts = ["２，８１２㎡", "①②㈱", "ｶﾞｷﾞ", "e\u0301a\u030a", "…", "plain", "", None, "臺北　市", "ﬁn", "\u0419"]
    assert each(spark, texts, text.nfkc) == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_number_formats(spark):
    values = [480.0, 0.5, 33.333333333, 999999.5, 1234567.0, -5.25, 0.0, 91283.25, 1e-5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(text.shortest(F.col("v")).alias("g"), text.fixed_point(F.col("v")).alias("f")).collect()
    assert [r.g for r in rows] == [f"{v:g}" for v in values] and [r.f for r in rows] == [f"{v:,.2f}" for v in values]


def test_dates(spark):
    assert each(spark, ["中 華 民 國 1 1 2 年 1 2 月 2 6 日", "113年4月30日", "99年1月1日", "中華民國113年4月30日"], dates.strict_date) == ["112年12月26日", None, None, "113年4月30日"]
    assert each(spark, ["1 1 3 年 0 4 月 3 0 日", "113年4月30日"], dates.spaced_date) == ["113年4月30日"] * 2
    tables = ["報核 102.04.30\n報核 112.09.08\n公開展覽 113.01.15", "申請事業計畫報核 112年9月8日", "公告 112.01.02\n公開展覽 113.01.15", "字第11311140047號\n報核 102.04.30", "報核版\n112.01.02"]
    assert each(spark, tables, dates.filing_date) == ["112年9月8日", "112年9月8日", None, "113年11月14日", "112年1月2日"]
    assert each(spark, ["依據114年5月28日謄本", "x\n送件        112.09.08", "謄本 報核 112.09.08", "none"], dates.near_keyword_date) == ["114年5月28日", "112年9月8日", "112年9月8日", None]
    assert each(spark, ["1131114【案】", "x_1131114 b", "x1131114", "1131314"], dates.file_date) == ["113年11月14日", "113年11月14日", None, None]


def boxes(spark, rows):
    """Pages of boxes: (text, x0, x1, yc); a page a list."""
    data = [(k, 1, n, t, 1.0, *(float(z) if z is not None else None for z in (a, b, y)), 10.0) for k, page in enumerate(rows) for n, (t, a, b, y) in enumerate(page)]
    return {r.doc_id: r for r in review_table.from_detections(spark.createDataFrame(data, BOX)).collect()}


def test_detections(spark):
    got = boxes(spark, [
        [("法定汽車停車位", 0, 100, 50), ("58", 110, 140, 50), ("無障礙停車位", 200, 300, 50), ("2", 310, 330, 50)], [("基準容積 3755.25", 0, 100, 50)], [("法定汽車停車位", 0, 100, 50), ("充電車位", 110, 200, 50)],
        [("法定汽車停車位", 0, 100, 50), ("58", 110, 140, 400)], [("實設汽車停車位", 0, 100, 50), ("平面", 0, 30, 80), ("25", 40, 60, 80), ("機械", 0, 30, 110), ("13", 40, 60, 110)], [("平面", 0, 30, 80), ("25", 40, 60, 80), ("機械", 0, 30, 110), ("13", 40, 60, 110)],
        [("送審類別", 0, 50, 50), ("■B-1：168專案小組版", 60, 200, 50)], [("送審類別", 0, 50, 50), ("□A-1", 60, 100, 50), ("■B-2", 110, 150, 50), ("□C", 160, 200, 50)], [("送審類別", 0, 50, 50), ("□A-1□B-1", 60, 100, 50)],
        [("基準容積+中", 0, 50, 50), ("15", 60, 80, 50)], [("基準容積", 0, 50, 50), ("1,", 60, 70, 50), ("406.00", 80, 120, 50)], [("法定(含無障礙)汽車停車位", 0, 50, 50), ("46", 60, 80, 50)], [("法定無障礙汽車停車位", 0, 50, 50), ("2", 60, 80, 50)], [("#12無障礙環境設計", 0, 50, 50), ("84.36", 60, 80, 50)],
        [("法定汽車停車位", None, None, None), ("基地面積", 0, 50, 50), ("703.", 60, 80, 50)],
    ])
    assert (got[0].legal_parking, got[0].accessible_parking) == (58, 2) and 1 in got and got[1].base_floor_area == 3755.25
    assert all(k not in got or got[k].legal_parking is None for k in (2, 3))
    assert got[4].actual_parking == 38 and got[4].actual_parking_detail == "平面25機械13無障礙0充電-" and (5 not in got or got[5].actual_parking is None)
    assert [got[k].submission_type for k in (6, 7, 8)] == ["B-1", "B-2", None]
    assert 9 not in got or got[9].base_floor_area is None
    assert got[10].base_floor_area == 1406.0 and (got[11].legal_parking, got[11].accessible_parking) == (46, None) and got[12].accessible_parking == 2
    assert (13 not in got or got[13].accessible_parking is None) and got[14].land_area == 703.0


def test_predicted(spark):
    rows = [(1, 1, ["a", "b", "c"], [0.4, None], [[[0.0, 0.0], [2.0, 0.0], [2.0, 4.0], [0.0, 4.0]], [], [[1.0]]])]
    got = pages.detections(spark.createDataFrame(rows, "doc_id int, page_num int, texts array<string>, scores array<double>, polygons array<array<array<double>>>")).collect()
    assert [(r.seq, r.text, r.conf, r.x0) for r in got] == [(1, "b", 1.0, None), (2, "c", 1.0, None)]


def test_findings(spark):
    table = "doc_id int, submission_type string, fill_date string, base_floor_area double, bonus_floor_area double, bonus_limit double, legal_parking int, actual_parking int, accessible_parking int, ev_parking int, raw_page int"
    rows = [(1, "B-1", "113年9月2日", 2000.0, 1928.58, 1877.63, 33, 35, 0, 0, 6), (2, "B-1", "x", None, 1020.0, 1000.0, 58, 35, 2, None, 6), (3, None, None, None, None, None, None, None, None, None, None)]
    got = {(r.doc_id, r.rule_id): r for r in rules.evaluate(spark.createDataFrame(rows, table), ["doc_id"]).collect()}
    over = got[1, "CALC-001"]
    assert over.status == "fail" and "1,928.58" in over.message and "1,877.63" in over.message and over.evidence == "審議資料表第 6 頁" and over.reference
    assert "51.0%" in got[2, "CALC-001"].message and got[3, "CALC-001"].status == "warn" and got[3, "CALC-001"].reference is None
    assert got[1, "CALC-002"].status == "fail" and got[2, "CALC-002"].status == "pass" and got[2, "CALC-003"].computed_result == "短少 23 輛（35 ＜ 58）"


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Count 2 /Type /Page x /Type/Page y")
    assert [(r.filename, r.total_pages, r.file_size_mb) for r in files.pdf_metadata(spark, str(tmp_path)).collect()] == [("a.pdf", 2, 0.0)]
    paths = spark.createDataFrame([("/in/a.PDF",), ("/in/../x.pdf",), ("/out/a.pdf",), ("/in/a.txt",)], "path string")
    assert [r.path for r in files.valid_pdf_paths(paths, "/in").collect()] == ["/in/a.PDF"]
    ns = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    heads = "".join(f'<text:h text:outline-level="{n}">{t}</text:h>' for n, t in ((1, "壹、<text:span>計畫</text:span>"), (2, "貳、小"), (1, "附錄一、乙（若無則免附）"), (1, "說明")))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("content.xml", f"<d {ns}>{heads}</d>")
    (tmp_path / "t.odt").write_bytes(raw.getvalue())
    found = templates.sections(files.odt_headings(spark, str(tmp_path)), ["path"])
    assert [(r.marker, r.title, r.kind, r.requirement, r.order) for r in found.orderBy("order").collect()] == [("壹", "計畫", "chapter", "required", 1), ("附錄一", "乙（若無則免附）", "appendix", "optional", 2)]
    own = found.select(F.lit("事業計畫書").alias("doc_type"), F.lit("113").alias("version"), F.lit("s").alias("source"), "marker", "title", "kind", "requirement", "order")
    files.write_schemas(own, str(tmp_path / "schemas"))
    (tmp_path / "schemas" / "bad.json").write_text("{not json")
    assert sorted(map(tuple, files.read_schemas(spark, str(tmp_path / "schemas")).collect())) == sorted(map(tuple, own.collect()))
    gold = {"cases": [{"id": "a", "fields": {"bonus_total_pct": 45}, "expected_rule_ids": ["LAW-FAR-001"]}, {"id": "b", "reg_year": "113", "fields": {"bonus_items": [{"name": "x", "rate_pct": 20}, {"name": "y", "rate_pct": 22}]}}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    cases = files.read_gold(spark, str(tmp_path / "gold.json"))
    assert {r.id: r.rule_ids for r in rules.consent_rules(cases).collect()} == {"a": ["LAW-FAR-001"], "b": ["LAW-FAR-001"]}
    (tmp_path / "law.md").write_text("x" * 4000)
    assert len(files.regulation_text(spark, str(tmp_path / "law.md"))) == 3000 and files.regulation_text(spark, str(tmp_path / "none.md")) == files.DEFAULT_REGULATION
    case = [(None, "案", "k", "a1b2c3d4_x_y.pdf", None, None, None)]
    files.write_cases(spark.createDataFrame(case, "meta_id string, case_name string, bp_key string, bp_filename string, re_key string, re_filename string, annotated_key string"), str(tmp_path / "cases"))
    assert [(r.bp_filename, len(r.meta_id)) for r in history.newest_cases(files.read_cases(spark, str(tmp_path / "cases"))).collect()] == [("x y.pdf", 12)]


def test_wiki(spark, tmp_path):
    pytest.importorskip("yaml")
    for year, extra in ((111, "  appendices: 24\n"), (113, "  appendices: 25\n")):
        (tmp_path / f"{year}.yaml").write_text(f"version: {year}年版\nyear: {year}\nform_fields:\n  - name: a{year}\n    status: new\n  - name: b\n    status: {'new' if year == 111 else 'existing'}\ntechnical_rules:\n  k:\n    formula: f{year}\n  t: plain\nkey_revisions:\n  - title: r\n    impact: odd\n  - title: s\n    impact: major\ndoc_structure:\n{extra}")
    wiki = files.read_wiki(spark, str(tmp_path))
    assert sorted((r.name, r.change) for r in templates.field_changes(wiki["fields"], wiki["versions"]).collect()) == [("a111", "removed"), ("a113", "added"), ("b", "updated")]
    assert [tuple(r) for r in templates.rule_changes(wiki["rules"], wiki["versions"]).collect()] == [(113, "k", "f111", "f113")]
    assert [r.change for r in templates.structure_changes(wiki["structures"]).collect()] == ["附錄數量：24 → 25"]
    assert [(r.year, r.title) for r in templates.revisions(wiki["revisions"]).collect()][:2] == [(111, "s"), (111, "r")]


def test_history(spark, tmp_path):
    old = spark.createDataFrame([(1, "案", "t1", "111", "[]"), (2, "e2E_TEST", "t1", "111", "x")], "id long, case_name string, audit_time string, rule_ver string, findings string")
    new = spark.createDataFrame([(3, "案", "t2", "111", '[{"rule_id":"R","status":"fail"},{"rule_id":"R","status":"warn"}]', 7)], "id long, case_name string, audit_time string, rule_ver string, findings string, critical_count int")
    history.append(old, str(tmp_path / "runs"))
    history.append(new, str(tmp_path / "runs"))
    runs = history.without_tests(history.read(spark, str(tmp_path / "runs")))
    assert sorted((r.id, r.critical_count, r.bonus_pct) for r in runs.collect()) == [(1, None, None), (3, 7, None)]
    before = history.decoded(runs.where("id = 3"), ["case_name"])
    now = spark.createDataFrame([("案", 0, "R", "pass"), ("案", 1, "S", "skip"), ("別", 0, "R", "pass")], "case_name string, seq int, rule_id string, status string")
    assert sorted((r.rule_id, r.change, r.prev_status) for r in history.finding_diff(now, before, ["case_name"]).collect()) == [("R", "improved", "warn"), ("S", "new", None)]
    assert history.decoded(old, ["case_name"]).count() == 0


def test_cache(spark):
    have = spark.createDataFrame([("a", 1, "x")], "key string, page int, text string")
    wanted = spark.createDataFrame([("a", 1), ("b", 1)], "key string, page int")
    known, todo = pages.cached(wanted, have, ["key", "page"])
    assert known.count() == 1 and [r.key for r in todo.collect()] == ["b"]
    new = spark.createDataFrame([("a", 1, "y", 2)], "key string, page int, text string, version int")
    assert [r.text for r in pages.cache_with(have.limit(0), new, ["key", "page"]).collect()] == ["y"]
    assert spark.range(1).select(pages.file_key(F.lit(b"x" * 70000)) == F.sha2(F.lit(b"x" * 65536), 256)).first()[0]


def test_scans(spark):
    own = spark.createDataFrame([(1, "a\nA123456789 巷1弄2號", "B123456789"), (2, "", "A123456789"), (3, None, None)], "id int, text string, seen string")
    assert [(r.id, r.masked, r.banner) for r in scans.masked(own, ["id"], "text").orderBy("id").collect()] == [(1, 2, True), (2, 0, True), (3, 0, False)]
    assert [r.context for r in scans.pii(own, "id", "text").collect()] == ["a A123456789 巷1弄2號"] * 2
    assert spark.range(1).select(pages.image_scale(F.lit(5950.0), F.lit(100.0)), pages.image_scale(F.lit(10.0), F.lit(10.0))).first()[0] == pytest.approx(2000 / 5950)


def test_model_answers(spark):
    answers = spark.createDataFrame([(1, '{"findings": "[{\\"rule_id\\":\\"a\\",\\"error_type\\":\\"typo\\",\\"severity\\":\\"critical\\",\\"detected_text\\":\\"t\\",\\"reason\\":\\"r\\"}]"}'), (2, "no json"), (3, None)], "id int, answer string")
    found = evidence.parsed_findings(answers, ["id"])
    assert [(r.id, r.page_number, r.suggested_text) for r in found.collect()] == [(1, 0, "")]
    assert evidence.verified_findings(found, None, ["id"]).count() == 1


def test_audit(spark):
    table = "臺北市都市更新審議資料表\n填表日期：中華民國113年9月2日\n送審類別 ■B-1\n計畫名稱：臺北市某某段一二三地號等都市更新案\n基準容積 2,000.00 m2\n合計獎勵樓地板面積 1,020.00m2\n容積獎勵上限 1,000.00m2\n法定汽車停車位\n30 輛\n實設汽車停車位 35 輛（無障礙1輛）（充電0輛）\n報核 112.09.08"
    text_ = [(1, 1, "目錄\n都市更新事業計畫申請書......2\n切結書......3"), (1, 2, "都市更新事業計畫申請書\n申請人\n中華民國112年12月26日"), (1, 3, ""), (1, 5, table), (1, 12, "計劃書 無障礙停車位 3 輛")]
    docs = spark.createDataFrame([(1, "1131114【案】.pdf"), (2, "b.pdf")], "doc_id int, filename string")
    pages_ = spark.createDataFrame(text_ + [(2, 1, "")], "doc_id int, page_num int, text string")
    playbook = [{"rule_id": "PB", "rule_name": "n", "type": "attachment_present", "attachment": "聽證相關資料"}, {"rule_id": "PB-2", "type": "x", "enabled": False}]
    out = audit.audit(docs, pages_, playbook, audit_time="2024-01-02 03:04")
    got = {(r.doc_id, r.rule_id): r for r in out["findings"].collect()}
    assert len(got) == 2 * 15 and {r.seq for k, r in got.items() if k[0] == 1} == set(range(15))
    status = {k[1]: r.status for k, r in got.items() if k[0] == 1}
    assert status["DOC-001"] == "pass" and status["DOC-003"] == "fail" and status["CALC-001"] == "fail" and status["TERM-001"] == "fail" and status["CONS-001"] == "fail" and status["PB"] == "fail"
    assert got[1, "DOC-002"].evidence == "第 1 頁（目錄列出，實際頁面待人工核對）" and got[1, "CONS-001"].evidence == "無障礙停車位：審議資料表=1，P.12=3.0"
    assert got[2, "FORM-001"].status == "skip" and got[2, "PB"].status == "skip"
    heads = {r.doc_id: r for r in out["dates"].collect()}
    assert (heads[1].report_date, heads[1].rule_version, heads[1].report_date_page) == ("112年9月8日", "111年版", 5) and heads[2].rule_version == "111年版"
    opinion = {r.doc_id: r.opinion for r in out["opinion"].collect()}
    assert "1. 【CALC-001】" in opinion[1] and "　法源：都更條例第65條" in opinion[1] and "報核日期：112年9月8日（來源：審議資料表（辦理過程報核日） 第5頁）→ 適用 111年版" in opinion[1]
    assert [r.page for r in out["annotations"].where("doc_id = 1").collect()] and out["key_numbers"].where("doc_id = 1").count() == 8
    runs = out["runs"].withColumn("id", F.monotonically_increasing_id())
    assert audit.audit(docs, pages_, playbook, runs, "t")["diff"].count() == 0


def test_report_limits(spark):
    found = spark.createDataFrame([(1, k, f"第 {p} 頁") for k, p in enumerate([*range(20, 0, -1), 3, 0])], "doc_id int, seq int, evidence string")
    assert [r.page for r in report.thumbnails(found, spark.createDataFrame([(1, 10)], "doc_id int, total_pages int")).orderBy("page").collect()] == list(range(1, 11))
    assert report.methods(spark).count() == 14


def test_micro_average(spark):
    none = summaries.micro_average(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert (none.precision, none.recall, none.f1) == (1.0, 1.0, 1.0)
    wrong = summaries.micro_average(spark.createDataFrame([(0, 1, 1)], "tp long, fp long, fn long")).first()
    assert wrong.f1 == 0.0


def test_grounding_against_plain(spark):
    quotes = ["abc", "ab", "漢 字 漢", "x" * 60, "y" * 30 + "z", "ＡＢＣ"]
    texts = ["zz a b\nc", "漢字漢字", "x" * 70, "y" * 40 + "z", None, "", "ABC"]
    squeeze = lambda t: "".join(unicodedata.normalize("NFKC", t or "").split())
    want = sorted((i, j) for i, q in enumerate(quotes) for j, t in enumerate(texts) if len(squeeze(q)) >= 3 and squeeze(q) in squeeze(t))
    q = spark.createDataFrame(list(enumerate(quotes)), "item int, quote string")
    p = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    assert sorted((r.item, r.doc) for r in compare.grounded(q, p, "quote", "text").collect()) == want
