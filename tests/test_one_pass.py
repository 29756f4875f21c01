"""The audit in one pass over pages, rules without unused texts, and places of matches in time in proportion to the text."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from dossia.functions import convert, dates
from dossia.functions.text import located, nfkc, pieces, running, stretch
from dossia.operators import audit, compare, evidence, pages, rules, scans, summaries
from dossia.plans import documents, more, registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_reads_pages_once(spark):
    plan = plan_of(registry.QUERIES["audit_findings"](spark, SF))
    assert plan.count("FileScan") == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_rules_build_only_what_is_asked_for(spark):
    reviews = registry.reviews(spark, SF)
    few = plan_of(rules.evaluate(reviews, ["doc_id"], registry.PLAYBOOK).select("doc_id", "rule_id", "status"))
    assert "transform(array(0)" not in few and "送審類別" not in few and "format_number" not in few
    assert "format_number" in plan_of(rules.evaluate(reviews, ["doc_id"], registry.PLAYBOOK))
    assert rules.evaluate(reviews, ["doc_id"], [], []).count() == 0


def test_facts_of_pages(spark):
    """One row a page; blank, missing and repeated pages; numbers only from their pages on."""
    rows = [(1, 1, "目 錄\n切結書......2\n附錄 聽證"), (1, 2, "切結書\n114年5月28日"), (1, 12, "充電3輛 無障礙停車位 2 輛"), (1, 3, None), (1, 9, "充電3輛"), (2, 1, " "), (2, 2, None), (3, 1, "手機 0912-345-678"), (3, 1, "手機 0912-345-678")]
    got = {r.doc_id: r for r in audit.documents(None, spark.createDataFrame(rows, "doc_id int, page_num int, text string")).collect()}
    assert [x.value for x in got[1].numbers] == [2.0, 3.0] and got[1].numbers[0].page == 12 and got[1].attachments == ["聽證相關資料"] and got[1].total_pages == 12
    assert got[2].attachments is None and got[2].pii is None and not got[2].has_table and [x.page for x in got[3].pii] == [1, 1]
    assert (got[1].front.has_affidavit, got[1].front.has_application, got[1].front_date) == (True, False, "114年5月28日")


def dated_plainly(text):
    for word in ["謄本", "報核", "送件", "申請日", "報核日"]:
        for m in re.finditer(word, text):
            line = text[text.rfind("\n", 0, m.start()) + 1 :].split("\n")[0]
            snippet = text[max(0, m.start() - 30) : m.end()] + line
            for p in (r"(\d{3})年(\d{1,2})月(\d{1,2})日", r"(\d{3})\.(\d{2})\.(\d{2})"):
                if found := re.search(p, snippet):
                    y, mo, d = map(int, found.groups())
                    if 100 <= y <= 130 and 1 <= mo <= 12 and 1 <= d <= 31:
                        return f"{y}年{mo}月{d}日"
    return None


def test_near_keyword_date(spark):
    rng = random.Random(3)
    bits = ["報核", "送件", "謄本", "報核日", "113年4月30日", "112.09.08", "999.99.99", "\n", " ", "xx", "一二三四五六七八九十" * 2]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", dates.near_keyword_date(F.col("t")).alias("d")).collect()
    assert {r.k: r.d for r in rows} == {k: dated_plainly(t) for k, t in enumerate(texts)}


def test_front_text_is_cut_without_loss(spark):
    """What goes to the grouping of a page without a keyword is its end; the date before the next page's keyword is still found."""
    rows = [(1, 1, "x" * 500 + "112.09.08"), (1, 2, "報核\n無"), (2, 1, "112.09.08" + "x" * 40), (2, 2, "報核")]
    got = {r.doc_id: r.front_date for r in audit.documents(None, spark.createDataFrame(rows, "doc_id int, page_num int, text string")).collect()}
    assert got == {1: "112年9月8日", 2: None}


PATTERN = r"(09\d{2})-(\d{3})"


def matches_plainly(text, group, around):
    return [(m.group(group), text[max(0, m.start() - around) : m.end() + around].replace("\n", " ").strip(" ")) for m in re.finditer(PATTERN, text)]


@pytest.mark.parametrize("n", [0, 1, 7, 700])
def test_matches(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice(["x", "漢", "😀", "\n", " "]) * rng.randint(0, 60) + f"09{rng.randint(0, 99):02d}-{rng.randint(0, 999):03d}" for _ in range(n)) + "end"
    for group, around in ((0, 25), (1, 300)):
        got = spark.createDataFrame([(text,)], "t string").select(scans.matches(F.col("t"), PATTERN, group, around).alias("m")).first().m
        assert [tuple(x) for x in got] == matches_plainly(text, group, around)


def test_matches_take_time_in_proportion(spark):
    def seconds(n):
        text = "電話 0912-345 " * n
        df = spark.createDataFrame([(text,)], "t string").cache()
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            assert df.select(F.size(scans.matches(F.col("t"), PATTERN, 0, 25)).alias("n")).first().n == n
            best = min(best, time.perf_counter() - began)
        return best

    seconds(100)
    assert seconds(16000) < 3 * seconds(4000) + 1


def test_running_and_stretch(spark):
    sums = spark.range(1).select(running(F.array(*map(F.lit, range(1, 38)))).alias("a"), running(F.array(F.lit(3), F.lit(1), F.lit(2)), F.greatest).alias("b"), running(F.array().cast("array<int>")).alias("c")).first()
    assert sums.a == [k * (k + 1) // 2 for k in range(1, 38)] and sums.b == [3, 3, 3] and sums.c == []
    text = "".join(chr(0x4E00 + k % 700) if k % 5 else "\n" for k in range(1500))
    for a, b in ((-5, 10), (0, 256), (250, 260), (511, 1025), (1490, 1600), (7, 7)):
        assert spark.createDataFrame([(text,)], "t string").select(stretch(pieces(F.col("t")), F.lit(a), F.lit(b)).alias("s")).first().s == text[max(0, a) : b]
    found = spark.createDataFrame([("aXbXX",)], "t string").select(located(F.col("t"), "X").alias("m")).first().m
    assert [(m.start, m.end) for m in found] == [(1, 2), (3, 4), (4, 5)]
    assert documents.pages(spark, SF).count() > 0


def chunked_plainly(text):
    out, one, two = [["", None, ""]], None, None
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        m = re.match(r"^(#{1,3})\s+(.+)$", re.sub(r"\r?\n$", "", line))
        if m:
            level, title = len(m[1]), m[2].strip()
            out.append([title, {1: None, 2: one, 3: two or one}[level], ""])
            one, two = (title, None) if level == 1 else (one, title) if level == 2 else (one, two)
        out[-1][2] += line
    return [(k, t, p, s.strip(), len(s.strip())) for k, (t, p, s) in enumerate(out) if s.strip()]


def test_chunks(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["# A\n", "## B\n", "### C\n", "#### no\n", "#no\n", "text\n", "\n", "  x", "## D\r\n", "# 漢 \n"]) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    got = {}
    for r in summaries.chunks(rows, "id", "t").collect():
        got.setdefault(r.id, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t in enumerate(texts) if (v := chunked_plainly(t))}


def test_chunks_carry_only_their_own_lines(spark):
    text = "".join(f"# H{k}\nbody {k}\n" for k in range(8000))
    began = time.perf_counter()
    out = summaries.chunks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("c")).first()
    assert out.n == 8000 and out.c == len(text) - 8000 and time.perf_counter() - began < 60


def test_quote_places(spark):
    text = [(1, 1, "目錄 本案 計畫書"), (1, 2, "ＡＢＣ　def\n計畫書 第二"), (2, 1, "別的"), (3, 1, None), (2, 2, "計畫書")]
    quotes = [(1, 0, "計 畫書"), (1, 1, "ABCdef計"), (1, 2, "沒有這句"), (1, 3, "AB"), (1, 4, None), (2, 0, "本案計"), (2, 1, "計畫書"), (3, 0, "計畫書"), (9, 0, "計畫書"), (None, 0, "計畫書"), (1, None, "第二 "), (1, 6, "C d")]
    df = spark.createDataFrame(quotes, "doc_id int, seq int, quote string")
    got = {(r.doc_id, r.seq): (r.found, r.page_num, r.start, r.end) for r in compare.quote_places(df, spark.createDataFrame(text, "doc_id int, page_num int, text string"), ["doc_id", "seq"]).collect()}
    no = (False, None, None, None)
    assert got == {
        (1, 0): (True, 1, 4, 7), (1, 1): (True, 2, 0, 7), (1, 2): no, (1, 3): no, (1, 4): no, (2, 0): no, (2, 1): (True, 2, 0, 3), (3, 0): no, (9, 0): no, (None, 0): no, (1, None): no, (1, 6): (True, 2, 2, 4),
    }


def test_converted(spark):
    """The longest phrase from left to right, against a walk; what is converted stays so."""
    rng = random.Random(6)
    table = {"a": "A", "ab": "X", "abc": "", "b": "BB", "cd": "Y", "漢": "汉", ".": "。", "d*": "Z"}

    def walked(text):
        out, k = "", 0
        while k < len(text):
            best = max((p for p in table if text.startswith(p, k)), key=len, default=None)
            out, k = (out + text[k], k + 1) if best is None else (out + table[best], k + len(best))
        return out

    texts = ["", "abcabab", *("".join(rng.choice("abcd漢.*x\n") for _ in range(rng.randint(0, 30))) for _ in range(300))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", convert.converted(F.col("t"), table).alias("c"), convert.converted(F.col("t"), {"a": "A"}).alias("one")).collect()
    assert {r.k: r.c for r in rows} == {k: walked(t) for k, t in enumerate(texts)} and all(r.one == texts[r.k].replace("a", "A") for r in rows)
    twice = spark.createDataFrame([("头发国内",), (None,)], "t string").select(convert.converted(convert.converted(F.col("t"), more.SIMPLE), more.SIMPLE).alias("c")).collect()
    assert [r.c for r in twice] == ["頭髮國內", None]
    box = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]]
    seen = spark.createDataFrame([(1, 1, ["类别"], [0.9], box)], "doc_id int, page_num int, texts array<string>, scores array<double>, polygons array<array<array<double>>>")
    assert pages.detections(seen, script=more.SIMPLE).first().text == "類別" and pages.detections(seen).first().text == "类别"


def test_nfkc_of_the_basic_plane(spark):
    """Every assigned character alone, with marks that must be ordered and composed, and jamo, as unicodedata has them."""
    known = [chr(c) for c in range(0x80, 0xFFFE) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = known + [c + "̣́x" for c in known] + ["각", "Ǻ", "́", None, "", "ascii"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", nfkc(F.col("t")).alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: None if t is None else unicodedata.normalize("NFKC", t) for k, t in enumerate(texts)}
    assert len(plan_of(registry.QUERIES["normalised_values"](spark, SF))) < 50_000


def test_ai_findings(spark):
    """Three sources in one table: quotes looked for in their own document, corroboration by its own rules."""
    llm = spark.createDataFrame([(1, 0, "R-FAR", "critical", "typo", "甲乙丙", "why", 3), (2, 0, "R-FAR", "warning", "typo", "甲乙丙", "why", 4)], "doc_id int, seq int, rule_id string, severity string, error_type string, detected_text string, reason string, page_number int")
    fields = spark.createDataFrame([(1, 0, "LAW-CON-001", "critical", "f", "v", "r")], "doc_id int, seq int, rule_id string, severity string, field_name string, actual_value string, reason string")
    cross = spark.createDataFrame([(2, 0, "CONS-AREA-001", "warning", "g", "1", "2")], "doc_id int, seq int, rule_id string, severity string, field_name string, business_plan_value string, rights_exchange_value string")
    failing = spark.createDataFrame([(1, "CALC-001"), (2, "CONS-VAL-001")], "doc_id int, rule_id string")
    text = spark.createDataFrame([(1, 1, "甲 乙 丙 丁"), (2, 1, "別的")], "doc_id int, page_num int, text string")
    got = {(r.doc_id, r.source): r for r in evidence.ai_findings(failing, llm, fields, cross, text).collect()}
    assert {k: (r.verified, r.corroborated, r.confidence, r.needs_review) for k, r in got.items()} == {
        (1, "llm"): (True, True, 0.8, False), (2, "llm"): (False, False, 0.35, True), (1, "field"): (False, False, 0.75, True), (2, "cross"): (False, True, 0.9, False),
    }
    assert got[2, "cross"].detected_text == "事業計畫書：1／權利變換計畫書：2" and len(got[1, "llm"].factors) == 3 and got[1, "llm"].page_number == 3
    assert [r.verified for r in evidence.ai_findings(failing, llm).collect()] == [False, False]
    with pytest.raises(ValueError):
        evidence.ai_findings(failing)
