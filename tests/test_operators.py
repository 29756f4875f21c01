from pyspark.sql import functions as F

from dossia.functions import scalars
from dossia.operators import compare, rules, scans, summaries

REVIEW = "doc_id string, submission_type string, fill_date string, base_floor_area double, bonus_floor_area double, bonus_limit double, legal_parking int, actual_parking int, accessible_parking int, ev_parking int"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_rules(spark):
    rows = [
        ("ok", "B-1", "113年9月2日", 2000.0, 1000.0, 1000.0, 30, 35, 1, 0),
        ("over", "B-1", "x", 3755.25, 1928.58, 1877.63, 51, 10, 0, None),
        ("null", None, None, None, None, None, None, None, None, None),
        ("zero", "C", "x", 0.0, 1.0, 0.0, 0, 0, 0, 1),
    ]
    got = {(r.doc_id, r.rule_id): r.status for r in rules.evaluate(spark.createDataFrame(rows, REVIEW), ["doc_id"]).collect()}
    assert {s for (d, _), s in got.items() if d == "ok"} == {"pass"}
    assert got["over", "CALC-001"] == "fail" and got["over", "CALC-002"] == "fail" and got["over", "CALC-003"] == "fail"
    assert got["null", "CALC-001"] == "warn" and got["null", "FORM-003"] == "fail" and got["null", "CALC-003"] == "warn"
    assert got["zero", "CALC-002"] == "pass"


def test_accessible_tiers(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 33, 50, 51, 58, 300, 301)], "n int").select(scalars.accessible_required(F.col("n"))).collect()]
    assert got == [0, 1, 1, 2, 2, 6, 7]


def test_scalars(spark):
    assert one(spark, "112年3月24日", scalars.normalize_date) == "2023-03-24"
    assert one(spark, "112年13月24日", scalars.normalize_date) is None
    assert [one(spark, v, scalars.parse_number) for v in ("２，８１２", "約 2,812.5 坪", "2 812", "-3", "NaN", "", None)] == [2812.0, 2812.5, 2812.0, -3.0, None, None, None]
    pairs = [("2,812", "2812", True), ("台北市", "臺北市", True), ("100㎡", "100平方公尺", True), ("112年3月24日", "2023-03-24", True), ("100.0", "100.4", True), ("123", "124", False), (None, "", True), ("2812", None, False)]
    got = [r[0] for r in spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(scalars.values_equal(F.col("a"), F.col("b"), 0.5)).collect()]
    assert got == [p[2] for p in pairs]
    assert one(spark, 'so ```json\n{"a": 1}\n``` end', scalars.json_object) == '{"a": 1}'
    assert one(spark, "[1]", scalars.json_object) is None


def test_consent(spark):
    rows = [("cap", "111", 45.0, [], 90.0, 90.0, []), ("items", "111", None, [20.0, 22.0], 90.0, 90.0, []), ("113", "113", 30.0, [], 70.0, 78.0, ["a", "a"]), ("dates", "111", 30.0, [], 85.0, 85.0, ["a", "b", None])]
    df = spark.createDataFrame(rows, "id string, reg_year string, bonus_total_pct double, bonus_items array<double>, owner_pct double, area_pct double, dates array<string>")
    got = {r[0]: r[1] for r in rules.consent_rules(df).collect()}
    assert got == {"cap": ["LAW-FAR-001"], "items": ["LAW-FAR-001"], "113": ["LAW-CON-001", "LAW-CON-002"], "dates": ["CONS-DATE-001"]}


def test_scans(spark):
    df = spark.createDataFrame([(1, "電話 (02)2345-6789 與 0912-345-678，計劃書 計劃書，充電3輛"), (2, None)], "id int, text string")
    assert [(r.risk_type, r.severity, r.value) for r in scans.pii(df, "id", "text").collect()] == [("phone", "MEDIUM", "(02)2345-6789"), ("phone", "MEDIUM", "0912-345-678")]
    assert {r.id: r.status for r in scans.pii_status(df, scans.pii(df, "id", "text"), "id").collect()} == {1: "warn", 2: "pass"}
    assert [(r.wrong_term, r.correct_term) for r in scans.terms(df, "id", "text").collect()] == [("計劃書", "計畫書")]
    assert [(r.field, r.value) for r in scans.numbers(df, "id", "text").collect()] == [("ev_parking", 3.0)]


def test_versions_and_timing(spark):
    df = spark.createDataFrame([("2010-01-01",), ("2022-03-24",), ("2025-01-01",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert [r.version for r in compare.version_asof(df, "d").collect()] == ["107年版", "111年版", "113年版", "111年版"]
    t = summaries.timing(spark.range(1, 101).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v")), "k", "v").first()
    assert (t.p95, t.median, t.most) == (95.0, 50.5, 100.0)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "# A\nx\n## B\n### C\n## D"), (2, ""), (3, None)], "id int, text string")
    assert [(r.section_title, r.parent_title) for r in summaries.chunks(df, "id", "text").collect()] == [("A", None), ("B", "A"), ("C", "B"), ("D", "A")]


def test_grounding(spark):
    q = spark.createDataFrame([(1, "ab cd"), (2, "x")], "item int, quote string")
    p = spark.createDataFrame([(7, "zz abc\nd")], "doc int, text string")
    assert [(r.doc, r.item) for r in compare.grounded(q, p, "quote", "text").collect()] == [(7, 1)]
