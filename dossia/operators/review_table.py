"""The review table: its page, its fields in text, in cells and in detections, the cascade that fills gaps, and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.dates import filing_date
from dossia.functions.scalars import any_word, first_of
from dossia.functions.text import let, nfkc
from dossia.operators.pages import PAGE, filled, page_range

FIELDS = [*fixed.TEXT_FIELDS, *fixed.FLOAT_FIELDS, *fixed.INT_FIELDS, "raw_page", "report_filing_date", "actual_parking_detail"]


def n_words(text: Column, words: list[str]) -> Column:
    """How many of the words a text has."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def candidate(text: Column, read: Column, page_num: Column) -> Column:
    """How a page ranks as the review table's, with its text: `struct<rank, page_num, text>`; null if it can't be.

    First a page with the title and two markers in its own text, then an image page with title and one marker in what was read
    of it, then the image page with most of the robust markers (four at least; the first on a tie).
    """
    own = F.coalesce(text, F.lit(""))

    def ranked(read):
        title = lambda c: any_word(c, fixed.TABLE_TITLES)
        image = filled(own).isNull()
        score = n_words(read, fixed.ROBUST_MARKERS)
        rank = first_of([
            (title(own) & (n_words(own, fixed.TABLE_MARKERS) >= 2), F.struct(F.lit(0).alias("k"), F.lit(0).alias("s"))),
            (image & title(read) & (n_words(read, fixed.TABLE_MARKERS) >= 1), F.struct(F.lit(1).alias("k"), F.lit(0).alias("s"))),
            (image & (score >= fixed.ROBUST_LEAST), F.struct(F.lit(2).alias("k"), (-score).alias("s"))),
        ])
        return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), page_num.alias("page_num"), F.when(image, read).otherwise(own).alias("text")))

    return F.when(page_num.between(1, fixed.TABLE_PAGES), let(nfkc(F.coalesce(read, F.lit(""))), ranked))


def table_page(pages: DataFrame) -> DataFrame:
    """The page of each document's review table and its text: `doc_id, page_num, text`.

    pages: doc_id, page_num, text, and read (what OCR or vision read of an image page, null elsewhere); see `candidate`.
    """
    rows = page_range(pages, 1, fixed.TABLE_PAGES).select("doc_id", candidate(F.col("text"), F.col("read"), F.col("page_num")).alias("x")).where("x is not null")
    best = rows.groupBy("doc_id").agg(F.min("x").alias("x"))
    return best.select("doc_id", "x.page_num", "x.text")


def group(text: Column, pattern: str) -> Column:
    """The first group of a pattern's first match, trimmed; null if there is none."""
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def area(c: Column) -> Column:
    return F.regexp_replace(c, "[,，\\s平方公尺m²㎡]", "").try_cast("double")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d]", "").try_cast("int")


def checked_type(text: Column) -> Column:
    """The first submission type, in their order, with a mark near its first place."""
    def near(code: str) -> Column:
        at = F.instr(text, code)
        window = F.substr(text, F.greatest(F.lit(1), at - 6), F.least(at - 1, F.lit(6)) + 3)
        return F.when((at > 0) & window.rlike(f"[{fixed.CHECK_MARKS}]"), F.lit(code))

    return F.coalesce(*[near(c) for c in fixed.CHECKED_TYPES])


def parsed(found: DataFrame, *more: str) -> DataFrame:
    """The fields of the review table in its page's text (page_num, text): one row a document, what isn't found is null; with `more` columns."""
    t = F.col("text")
    name = group(t, r"(?U)(?:計畫名稱|案\s*名)[：:\s]*([^\n\r]{10,120})")
    number = r"[^\d\n]*(\d[\d,，.]+)"
    first = lambda *patterns: F.coalesce(*[digits(group(t, p)) for p in patterns])
    return found.select(
        "doc_id", *more, F.trim(F.regexp_replace(name, r"(?U)(?:\s*[（(]請勾選[）)]|\s*□).*$", "")).alias("case_name"),
        group(t, r"(?U)實施者[：:\s]*([^\n\r\t　]{4,40}(?:股份有限公司|有限公司|更新會|協會|開發))").alias("implementer"),
        group(t, r"(?U)統一編號[：:\s]*(\d{8})").alias("implementer_id"), checked_type(t).alias("submission_type"),
        group(t, r"(?U)填表日期[：:\s]*(?:中華民國\s*)?(\d+\s*年\s*\d+\s*月\s*\d+\s*日)").alias("fill_date"), F.lit(None).cast("double").alias("land_area"),
        area(group(t, r"(?U)基準容積\s+(\d[\d,，.]+)\s*m")).alias("base_floor_area"), area(group(t, f"(?:申請額度|合計獎勵樓地板面積|獎勵面積合計|獎勵合計){number}")).alias("bonus_floor_area"),
        area(group(t, f"(?:獎勵上限|容積上限|容積獎勵上限){number}")).alias("bonus_limit"),
        group(t, r"(?U)土地所有權人[^%\d]*(\d+\.?\d*)\s*%").try_cast("double").alias("owner_consent_ratio"),
        first(r"(?U)法定汽車停車位[^\n]*\n(\d+)\s*輛", r"(?U)法定[汽車]*停車位[：:\s]*(\d+)\s*輛").alias("legal_parking"),
        first(r"(?U)實設汽車停車[位\s]*(\d+)\s*輛").alias("actual_parking"), first(r"無障礙(\d+)輛", r"(?U)無障礙[停車位\s：:]*(\d+)\s*輛").alias("accessible_parking"),
        first(r"充電(\d+)輛", r"(?U)充電[停車位\s：:]*(\d+)\s*輛").alias("ev_parking"), F.col("page_num").cast("int").alias("raw_page"),
        filing_date(t).alias("report_filing_date"), F.lit(None).cast("string").alias("actual_parking_detail"),
    )


def leading_number(c: Column) -> Column:
    """The first number of a text, with thousands and decimals."""
    return F.regexp_replace(F.regexp_extract(c, r"\d[\d,，]*(?:\.\d+)?", 0), "[,，]", "").try_cast("double")


def leading_int(c: Column) -> Column:
    """The first whole number of a text: what is before a decimal point."""
    return F.regexp_replace(F.regexp_extract(c, r"\d[\d,，]*", 0), "[,，]", "").try_cast("int")


def coerced(field: str, c: Column) -> Column:
    """A raw text as its field's type; null if it can't be."""
    if field in fixed.FLOAT_FIELDS:
        return leading_number(c)
    return leading_int(c) if field in fixed.INT_FIELDS else F.nullif(F.trim(c), F.lit(""))


def coverage(fields: list[str] = fixed.CRITICAL_FIELDS) -> Column:
    """Share of fields that aren't null; 1 of none."""
    return reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in fields]) / len(fields) if fields else F.lit(1.0)


def label_matches(text: Column, words: list, excludes: list[str]) -> Column:
    """Any word, or all of a tuple's words, and none that vetoes."""
    hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(text, F.lit(p)) for p in w]) if isinstance(w, tuple) else F.contains(text, F.lit(w)) for w in words])
    return hit & ~any_word(text, excludes) if excludes else hit


def labelled(text: Column) -> Column:
    """Fields whose label a text has, in the order of LABELS."""
    return F.array_compact(F.array(*[F.when(label_matches(text, w, x), F.lit(f)) for w, f, x in fixed.LABELS]))


def claimed(listed: Column) -> Column:
    """Of an array of struct<..., fields, value> in scan order, a map of fields: an entry claims the first of its fields that none before has.

    An entry has few fields and a page few labels, so the walk is a fold over the page's array.
    """
    empty = F.create_map().cast("map<string,string>")

    def walk(done, x):
        free = F.get(F.filter(x["fields"], lambda f: ~F.map_contains_key(done, f)), 0)
        return F.when(free.isNull(), done).otherwise(F.map_concat(done, F.create_map(F.coalesce(free, F.lit("")), F.coalesce(x["value"], F.lit("")))))

    return F.aggregate(F.transform(listed, lambda x: F.struct(x["fields"].alias("fields"), x["value"].alias("value"))), empty, walk)


def typed(rows: DataFrame, by: list[str], column: str = "fields", more: list[str] = ()) -> DataFrame:
    """A map of raw texts as the columns of the review table."""
    have = [f for f in FIELDS if f not in ("raw_page", "report_filing_date")]
    return rows.select(*by, *more, *[coerced(f, F.element_at(F.col(column), f)).alias(f) for f in have])


def from_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Fields of table cells (by, row, col, text): the cell right of a label, else the label's own text.

    Cells are walked in reading order; the first label of a field takes it, even with an empty neighbour.
    """
    right = F.lead(F.struct("col", "text")).over(W.partitionBy(*by, "row").orderBy("col"))
    text = F.trim("text")
    value = F.coalesce(F.when(F.col("next.col") == F.col("col") + 1, filled(F.trim("next.text"))), text)
    rows = cells.withColumn("next", right).select(*by, "row", "col", labelled(text).alias("fields"), value.alias("value")).where(F.size("fields") > 0)
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", "col", "fields", "value"))).alias("listed"))
    return typed(grouped.select(*by, claimed(F.col("listed")).alias("fields")), by)


def stitched(texts: Column) -> Column:
    """The nearest value, with number fragments added while it ends in a thousands comma."""
    number, open_ = r"^[0-9][0-9,，.\s]*$", r"[0-9][,，]\s*$"
    first = F.trim(F.get(texts, 0))
    start = F.struct(first.alias("value"), (~first.rlike(number)).alias("stopped"))

    def add(done, x):
        go = ~done["stopped"] & done["value"].rlike(open_) & F.trim(x).rlike(number)
        return F.struct(F.when(go, F.concat(done["value"], F.trim(x))).otherwise(done["value"]).alias("value"), (~go).alias("stopped"))

    return F.when(F.size(texts) > 0, F.aggregate(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), start, add)["value"])


def checked_code(text: Column) -> Column:
    """The first submission type with a filled mark within five characters before one of its words."""
    return F.coalesce(*[F.when(text.rlike("|".join(f"[{fixed.FILLED_MARKS}].{{0,4}}{w}" for w in words)), F.lit(code)) for code, words in fixed.TYPE_WORDS])


def named_code(text: Column) -> Column:
    """The submission type of which a text has a word; null if there are several."""
    found = F.array_compact(F.array(*[F.when(any_word(text, words), F.lit(code)) for code, words in fixed.TYPE_WORDS]))
    return F.when(F.size(found) == 1, F.get(found, 0))


#: Fields of labels whose value is a number, in the order of labels, and a bit for each.
NUMERIC = [(words, field, excludes) for words, field, excludes in fixed.LABELS if field in (*fixed.FLOAT_FIELDS, *fixed.INT_FIELDS)]
PARTS = {"平面": 1, "機械": 2}


def label_bits(text: Column) -> Column:
    """The numeric fields whose label a text has, as bits: a number is cheaper to work out and to move than names."""
    return reduce(lambda a, b: a + b, [F.when(label_matches(text, w, x), 1 << i).otherwise(0) for i, (w, _, x) in enumerate(NUMERIC)])


def from_detections(boxes: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Fields of recognised texts with places (by, seq, text, x0, x1, yc, h): the nearest number right of a label on its row.

    Texts without a place are left out. Only numbers that can be read claim a field; a label without neighbour takes the number
    at its own end. Actual parking is the sum of its four parts where both main ones are there.

    What a text is a label of is told before the boxes are grouped by page, once; each label then looks along its row among the boxes
    of its page, which are as many as a page has.
    """
    text = F.trim("text")
    part = reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(w)), bit).otherwise(0) for w, bit in PARTS.items()])
    has = lambda w: F.contains("text", F.lit(w))
    own = [F.col("seq"), F.col("yc"), F.col("x0"), F.col("x1"), F.coalesce("h", F.lit(0.0)).alias("h"), F.col("text"), label_bits(text).alias("bits"), part.alias("part"), has("送審類別").alias("is_type"), has("實設").alias("anchor")]
    pages = boxes.where("x0 is not null and x1 is not null and yc is not null").select(*by, F.struct(*own).alias("b")).groupBy(*by).agg(F.collect_list("b").alias("boxes"))
    is_label = lambda b: (b["bits"] > 0) | (b["part"] > 0) | b["is_type"]

    def along(label):
        """What is on the label's row to its right, nearest first."""
        near = lambda b: (F.abs(b["yc"] - label["yc"]) <= 0.6 * F.greatest(b["h"], label["h"])) & (b["x0"] - label["x1"] >= -label["h"]) & (b["seq"] != label["seq"])
        found = F.array_sort(F.transform(F.filter("boxes", near), lambda b: F.struct(b["x0"].alias("x0"), b["seq"].alias("seq"), b["text"].alias("text"))))
        return F.transform(found, lambda b: b["text"])

    def met(label):
        def read(texts):
            def valued(near):
                value = F.coalesce(near, F.nullif(F.regexp_extract(label["text"], r"([0-9][0-9,.]*)\s*$", 1), F.lit("")))
                places = leading_int(near)
                return F.struct(
                    label["seq"].alias("seq"), label["bits"].alias("bits"), label["part"].alias("part"), label["is_type"].alias("is_type"), value.alias("value"),
                    F.when(places.between(0, fixed.PARKING_MOST), places).alias("places"), F.when(label["is_type"], F.array_join(texts, "")).alias("joined"),
                )

            return let(stitched(texts), valued)

        return let(along(label), read)

    rows = pages.where(F.exists("boxes", is_label)).withColumn("met", F.array_sort(F.transform(F.filter("boxes", is_label), met)))
    names = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(f).alias("field")) for i, (_, f, _) in enumerate(NUMERIC)])
    fields = lambda bits: F.transform(F.filter(names, lambda n: n["bit"].bitwiseAND(bits) > 0), lambda n: n["field"])
    claims = F.filter("met", lambda m: (m["bits"] > 0) & leading_number(m["value"]).isNotNull())
    listed = F.transform(claims, lambda m: F.struct(fields(m["bits"]).alias("fields"), m["value"].alias("value")))
    first = lambda name, test: F.get(F.filter("met", test), 0)[name].alias(name)
    of_part = lambda k: first("places", lambda m: (m["part"].bitwiseAND(k) > 0) & m["places"].isNotNull())
    rows = rows.select(
        *by, claimed(listed).alias("fields"), of_part(1).alias("surface"), of_part(2).alias("mech"), first("joined", lambda m: m["is_type"]).alias("said"), F.exists("boxes", lambda b: b["anchor"]).alias("anchor"),
    )
    out = typed(rows, by, "fields", ["surface", "mech", "said", "anchor"])
    both = F.col("anchor") & F.col("surface").isNotNull() & F.col("mech").isNotNull()
    acc = F.coalesce("accessible_parking", F.lit(0))
    detail = F.concat(F.lit("平面"), F.col("surface").cast("string"), F.lit("機械"), F.col("mech").cast("string"), F.lit("無障礙"), acc.cast("string"), F.lit("充電"), F.coalesce(F.col("ev_parking").cast("string"), F.lit("-")))
    total = F.col("surface") + F.col("mech") + acc + F.coalesce("ev_parking", F.lit(0))
    out = out.withColumn("actual_parking_detail", F.when(both, detail)).withColumn("actual_parking", F.when(both, total).otherwise(F.col("actual_parking")))
    return out.withColumn("submission_type", F.coalesce(checked_code(F.col("said")), named_code(F.col("said")))).drop("surface", "mech", "said", "anchor")


def filled_from(base: DataFrame, tier: DataFrame, by: list[str], gate: Column | None = None) -> DataFrame:
    """The gaps of `base` filled from another table of fields, where `gate` holds; what is there stays."""
    have = [f for f in base.columns if f in tier.columns and f not in by]
    open_ = F.lit(True) if gate is None else gate
    other = tier.select(*by, *[F.col(f).alias(f"t_{f}") for f in have])
    out = base.withColumn("open_", open_).join(other, by, "left")
    return out.select(*[F.coalesce(F.col(c), F.when(F.col("open_"), F.col(f"t_{c}"))).alias(c) if c in have else F.col(c) for c in base.columns])


def aligned_base(regions: DataFrame, by: list[str]) -> DataFrame:
    """The base floor area of a template's region, if the template's bonus area agrees with the known one and the value can be.

    regions: by, known (bonus area), bonus_text, base_text.
    """
    number = lambda c: leading_number(F.regexp_replace(c, r"(?U)\s+", ""))
    bonus, base, known = number(F.col("bonus_text")), number(F.col("base_text")), F.col("known")
    fits = (known != 0) & (bonus != 0) & (F.abs(bonus - known) <= F.greatest(F.lit(1.0), known * 0.01))
    can = (base > known) & (base <= known * 20) & (base <= 1_000_000)
    return regions.where(fits & can).select(*by, base.alias("base_floor_area"))


def cascade(base: DataFrame, by: list[str], vlm: DataFrame | None = None, cells: DataFrame | None = None, boxes: DataFrame | None = None, regions: DataFrame | None = None, vision: DataFrame | None = None) -> DataFrame:
    """The text's fields with gaps filled by tier: vision model on site, cells, detections while a critical field is
    missing, the template's base area, and a hosted vision model while coverage is under 0.6. Rows without a page stay."""
    known = F.col("raw_page").isNotNull() & (F.col("raw_page") != 0)
    out = base
    for tier, gate in ((vlm, known), (cells, known), (boxes, known & (coverage() < 1.0))):
        if tier is not None:
            out = filled_from(out, tier, by, gate)
    if regions is not None:
        anchored = regions.join(out.select(*by, F.col("bonus_floor_area").alias("known")), by)
        out = filled_from(out, aligned_base(anchored, by), by, known & F.col("base_floor_area").isNull())
    return out if vision is None else filled_from(out, vision, by, known & (coverage() < fixed.VISION_BELOW))


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(0.01), F.abs(b) * 0.01)


#: Checks of the fields: (name, the field to read again, the check; null if it can't be made).
CONSTRAINTS = [
    ("衍生獎勵上限 = 基準容積 × 50%", "bonus_limit", lambda: close_to(F.col("bonus_limit"), F.col("base_floor_area") * 0.5)),
    ("合計獎勵樓地板 ≤ 獎勵上限", "bonus_floor_area", lambda: F.col("bonus_floor_area") <= F.col("bonus_limit") * 1.01),
]


def verified(rows: DataFrame, by: list[str], again: list[DataFrame] = ()) -> DataFrame:
    """The fields after at most three rounds of reading suspects again, and `residual`, the checks that still fail.

    again: for each round, a table (by, bonus_limit, bonus_floor_area) of what reading again gives. A suspect is replaced if its
    check failed at the round's start; a row where nothing moves is done with.
    """
    out = rows.withColumn("going", F.lit(True))
    for table in again[:3]:
        new = table.select(*by, *[F.col(s).alias(f"n_{s}") for _, s, _ in CONSTRAINTS])
        out = out.join(new, by, "left")
        for _, s, check in CONSTRAINTS:
            out = out.withColumn(f"u_{s}", F.col("going") & ~F.coalesce(check(), F.lit(True)) & F.col(f"n_{s}").isNotNull() & (F.col(f"n_{s}") != F.col(s)))
        moved = reduce(lambda a, b: a | b, [F.col(f"u_{s}") for _, s, _ in CONSTRAINTS])
        out = out.withColumn("going", moved)
        for _, s, _ in CONSTRAINTS:
            out = out.withColumn(s, F.when(F.col(f"u_{s}"), F.col(f"n_{s}")).otherwise(F.col(s)))
        out = out.drop(*[f"{p}_{s}" for p in "nu" for _, s, _ in CONSTRAINTS])
    residual = F.array_compact(F.array(*[F.when(~check(), F.lit(name)) for name, _, check in CONSTRAINTS]))
    return out.withColumn("residual", residual).drop("going")


def type_prefix(c: Column) -> Column:
    """A submission type cut to its code, if it begins with one."""
    return F.coalesce(*[F.when(F.startswith(F.trim(c), F.lit(p)), F.lit(p)) for p in fixed.TYPE_PREFIXES], c)
