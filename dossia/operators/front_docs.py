"""Front documents: which pages hold them, what they are for, and the date that counts as the filing date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.dates import NEAR, coded_date, near_keyword_date, spaced_date
from dossia.functions.scalars import any_word
from dossia.functions.text import let
from dossia.operators.pages import filled, page_range


def is_toc(text: Column) -> Column:
    return any_word(text, fixed.TOC_MARKERS)


def doc_type(text: Column) -> Column:
    """The first document whose words a text has, with a word of its contents where one is asked for."""
    cases = [any_word(text, words) & (any_word(text, gate) if gate else F.lit(True)) for _, words, gate in fixed.FRONT_DOCS]
    return F.coalesce(*[F.when(c, F.lit(name)) for c, (name, _, _) in zip(cases, fixed.FRONT_DOCS)])


def poa_purpose(text: Column) -> Column:
    return F.coalesce(*[F.when(any_word(text, words), F.lit(name)) for name, words in fixed.POA_PURPOSES])


def page_docs(pages: DataFrame, *more: Column) -> DataFrame:
    """What each page holds: `doc_id, page_num, toc, listed (of a table of contents), doc_type, purpose, date, coded, rest`, and `more` of the page.

    `rest` is what a page without a document adds to the text in which a filing date is looked for: all of it if it has a filing
    keyword, else its end, which may stand before the next page's keyword. Pages after FRONT_SCAN hold nothing.
    """
    t = F.when(F.col("page_num").between(1, fixed.FRONT_SCAN), F.coalesce("text", F.lit("")))
    rows = pages.select("doc_id", "page_num", *more, t.alias("front_text")).withColumn("toc", F.coalesce(is_toc(F.col("front_text")), F.lit(False)))
    text = F.col("front_text")
    listed = lambda x: F.array_compact(F.array(*[F.when(any_word(x, words), F.lit(name)) for name, words, _ in fixed.FRONT_DOCS]))
    front = ~F.col("toc") & (F.col("page_num") <= fixed.FRONT_PAGES)

    def content(kind):
        dated = F.when(kind.isin(fixed.DATE_SOURCES), spaced_date(text))
        return F.struct(kind.alias("doc_type"), F.when(kind == "委託書", poa_purpose(text)).alias("purpose"), dated.alias("date"))

    # worked out once a page, within lambdas
    found = F.when(front, let(text, lambda x: let(doc_type(x), content)))
    rows = rows.withColumn("listed", F.when(F.col("toc"), let(text, listed))).withColumn("c", found).withColumn("coded", coded_date(text))
    other = ~F.col("toc") & F.col("c.doc_type").isNull() & filled(text).isNotNull()
    rest = F.when(other, F.when(any_word(text, fixed.FILED_KEYWORDS), text).otherwise(F.right(text, F.lit(NEAR))))
    kept = [c for c in rows.columns if c not in ("front_text", "toc", "listed", "c", "coded")]
    return rows.select(*kept, "toc", "listed", "c.doc_type", "c.purpose", "c.date", "coded", rest.alias("rest"))


def aggregates() -> list[Column]:
    """What a document's pages (of page_docs) add up to, for one grouping by document; `told` reads it."""
    page = F.struct("page_num", "listed", "doc_type", "purpose")
    first = lambda value, test, name: F.min_by(value, F.when(test, F.col("page_num"))).alias(name)
    dated = [first(F.struct("date", "page_num"), (F.col("doc_type") == s) & F.col("date").isNotNull(), f"d{k}") for k, s in enumerate(fixed.DATE_SOURCES)]
    return [
        F.array_sort(F.collect_list(F.when(F.col("toc") | F.col("doc_type").isNotNull(), page))).alias("found"), *dated,
        F.array_sort(F.collect_list(F.when(F.col("rest").isNotNull(), F.struct("page_num", F.col("rest").alias("text"))))).alias("rest"), first(F.col("coded"), F.col("coded").isNotNull(), "coded"),
    ]


def told(got: DataFrame, *more: str) -> DataFrame:
    """One row a document, of `aggregates`: `docs` (what was found, in the order of pages), the first dates by type, the text in which to
    look for a filing date, a date coded in a document number, and `more`."""
    none = F.lit(None).cast("string")

    def entry(kind, page_num, purpose, from_toc):
        return F.struct(kind.alias("doc_type"), page_num.alias("page"), purpose.alias("purpose"), F.lit(from_toc).alias("from_toc"))

    def of_page(p):
        # a table of contents adds the types that no page before it has shown
        before = F.filter("found", lambda q: q["page_num"] < p["page_num"])
        new = F.filter(p["listed"], lambda t: ~F.exists(before, lambda q: F.coalesce(q["doc_type"] == t, F.lit(False)) | F.coalesce(F.array_contains(q["listed"], t), F.lit(False))))
        return F.when(p["listed"].isNotNull(), F.transform(new, lambda t: entry(t, p["page_num"], none, True))).otherwise(F.array(entry(p["doc_type"], p["page_num"], p["purpose"], False)))

    docs = F.flatten(F.transform("found", of_page))
    return got.select("doc_id", *more, docs.alias("docs"), *(f"d{k}" for k in range(len(fixed.DATE_SOURCES))), F.array_join(F.transform("rest", lambda x: x["text"]), "\n").alias("rest"), "coded")


def by_document(pages: DataFrame) -> DataFrame:
    """One row a document, from one pass over its front pages (see `told`)."""
    return told(page_docs(page_range(pages, 1, fixed.FRONT_SCAN)).groupBy("doc_id").agg(*aggregates()))


def front_docs(pages: DataFrame) -> DataFrame:
    """Documents found, in the order of pages: `doc_id, seq, doc_type, page, purpose, from_toc`.

    A table of contents adds the types that no page before it has shown.
    """
    return by_document(pages).select("doc_id", F.posexplode("docs").alias("seq", "d")).select("doc_id", "seq", "d.*").select("doc_id", "seq", "doc_type", "page", "purpose", "from_toc")


def dated(rows: DataFrame) -> Column:
    """`struct<date, page, source>`: of the application, affidavit or power of attorney (the first page of each that has a date),
    else near a filing word in the other pages, else coded in a document number. rows: of by_document."""
    kind = rows.schema["docs"].dataType.elementType["page"].dataType
    pick = lambda date, page, source: F.struct(date.alias("date"), page.cast(kind).alias("page"), source.alias("source"))
    of_type = [F.when(F.col(f"d{k}").isNotNull(), pick(F.col(f"d{k}.date"), F.col(f"d{k}.page_num"), F.lit(s))) for k, s in enumerate(fixed.DATE_SOURCES)]
    none = F.lit(None)
    near = let(near_keyword_date(F.col("rest")), lambda d: F.when(d.isNotNull(), pick(d, none, F.lit("補正回應（謄本日期）"))))
    coded = F.when(F.col("coded").isNotNull(), pick(F.col("coded.shown"), none, F.col("coded.source")))
    return F.coalesce(*of_type, near, coded)


def report_date(pages: DataFrame) -> DataFrame:
    """`doc_id, report_date, report_date_page, report_date_source` of each document (see `dated`)."""
    rows = by_document(pages)
    rows = rows.select("doc_id", dated(rows).alias("x"))
    return rows.select("doc_id", F.col("x.date").alias("report_date"), F.col("x.page").alias("report_date_page"), F.col("x.source").alias("report_date_source"))


def summary(pages: DataFrame) -> DataFrame:
    """One row a document: flags, number of powers of attorney with their purposes, where each type stands (the first content page,
    else the first page that lists it), and the report date."""
    return summarised(by_document(pages))


def summarised(rows: DataFrame, *more: str) -> DataFrame:
    """The summary of rows of `told`, with `more` of their columns."""
    of = lambda t: F.filter("docs", lambda d: d["doc_type"] == t)
    place = lambda d: F.struct(d["page"].alias("page"), d["from_toc"].alias("from_toc"))

    def located(t):
        own = of(t)
        best = F.coalesce(F.get(F.filter(own, lambda d: ~d["from_toc"]), 0), F.get(own, 0))
        return F.when(F.size(own) > 0, F.struct(F.lit(t).alias("key"), place(best).alias("value")))

    at = F.map_from_entries(F.array_compact(F.array(*[located(t) for t, _, _ in fixed.FRONT_DOCS])))
    has = lambda t: F.exists("docs", lambda d: d["doc_type"] == t)
    poa = F.transform(of("委託書"), lambda d: F.coalesce(d["purpose"], F.lit("用途未識別")))
    out = rows.select(
        "doc_id", *more, F.size(poa).cast("long").alias("poa_count"), poa.alias("purposes"), has("申請書").alias("has_application"), has("切結書").alias("has_affidavit"), has("審議資料表").alias("has_review_table"),
        at.alias("at"), dated(rows).alias("x"),
    )
    return out.select("*", F.col("x.date").alias("report_date"), F.col("x.page").alias("report_date_page"), F.col("x.source").alias("report_date_source")).drop("x")
