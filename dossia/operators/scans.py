"""Text scans: personal data, terms, numbers and attachments, by built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.scalars import attachments_present, context
from dossia.functions.text import let, located, pieces, stretch
from dossia.operators.pages import filled


def matches(text: Column, pattern: str, group: int, around: int) -> Column:
    """Every match of a pattern: `array<struct<value, context>>`, with the characters around it on one line.

    Places come from one pass over the matches, and contexts from pieces of the text near them, so time is in proportion to the text.
    """
    def one(cut, m):
        near = stretch(cut, m["start"] - around, m["end"] + around)
        return F.struct(m["value"].alias("value"), F.trim(F.replace(near, F.lit("\n"), F.lit(" "))).alias("context"))

    return let(F.struct(pieces(text).alias("cut"), located(text, pattern, group).alias("found")), lambda x: F.transform(x["found"], lambda m: one(x["cut"], m)))


def pii_found(text: Column, patterns=fixed.PII_PATTERNS) -> Column:
    """Every match of every category, in order: `array<struct<risk_type, severity, value, context>>`."""
    def tagged(kind: str, severity: str):
        return lambda v: F.struct(F.lit(kind).alias("risk_type"), F.lit(severity).alias("severity"), v["value"].alias("value"), v["context"].alias("context"))

    return F.flatten(F.array(*[F.transform(F.when(text.rlike(p), matches(text, p, 0, n)).otherwise(F.array().cast("array<struct<value:string,context:string>>")), tagged(k, s)) for k, s, p, n in patterns]))


def exploded(pages: DataFrame, key, found: Column) -> DataFrame:
    """A row for each of an array of structs, numbered. key: a column name or a list."""
    keys = [key] if isinstance(key, str) else list(key)
    return pages.select(*keys, F.posexplode(found).alias("seq", "x")).select(*keys, "seq", "x.*")


def pii(pages: DataFrame, key, text: str, patterns=fixed.PII_PATTERNS) -> DataFrame:
    """Every match of every category, in order: `key, seq, risk_type, severity, value, context`."""
    return exploded(pages, key, pii_found(F.col(text), patterns))


def pii_status(pages: DataFrame, matches_: DataFrame, key: str) -> DataFrame:
    """Any HIGH fails, any MEDIUM warns, the rest pass, with or without matches: `key, status, high`."""
    n = lambda s: F.count_if(F.col("severity") == s)
    sums = matches_.groupBy(key).agg(n("HIGH").alias("high"), n("MEDIUM").alias("medium"))
    out = pages.select(key).distinct().join(sums, key, "left").fillna(0, ["high", "medium"])
    return out.select(key, F.when(F.col("high") > 0, "fail").when(F.col("medium") > 0, "warn").otherwise("pass").alias("status"), "high")


def masked(pages: DataFrame, key: list[str], text: str, patterns=fixed.PII_PATTERNS) -> DataFrame:
    """The text with HIGH values as blocks of the same length, how many there were, and whether a page with some has no text to mask.

    A page's text may come from elsewhere (`seen`): values found there that the own text lacks ask for a banner.
    """
    out, n = F.col(text), F.lit(0)
    for _, severity, pattern, _ in patterns:
        if severity == "HIGH":
            n = n + F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern))
            found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
            out = F.aggregate(found, out, lambda a, v: F.replace(a, v, F.repeat(F.lit("█"), F.length(v))))
    have = [c for c in pages.columns if c == "seen"]
    banner = F.lit(False)
    for c in have:
        for _, severity, pattern, _ in patterns:
            if severity == "HIGH":
                values = F.regexp_extract_all(c, F.lit(pattern), 0)
                banner = banner | F.exists(values, lambda v: ~F.contains(F.coalesce(F.col(text), F.lit("")), v))
    return pages.select(*key, out.alias(text), n.cast("long").alias("masked"), F.coalesce(banner, F.lit(False)).alias("banner"))


def terms_found(text: Column, pairs=fixed.TERMS, around: int = 30) -> Column:
    """Wrong terms, each once at its first place: `array<struct<wrong_term, correct_term, at, context>>`."""
    at = lambda w: F.instr(text, w)
    return F.array_compact(F.array(*[F.when(at(w) > 0, F.struct(F.lit(w).alias("wrong_term"), F.lit(c).alias("correct_term"), at(w).alias("at"), context(text, at(w), F.lit(len(w)), around).alias("context"))) for w, c in pairs]))


def terms(pages: DataFrame, key, text: str, pairs=fixed.TERMS, around: int = 30) -> DataFrame:
    """Wrong terms, each once a page at its first place: `key, seq, wrong_term, correct_term, at, context`."""
    return exploded(pages, key, terms_found(F.col(text), pairs, around))


def numbers_found(text: Column, patterns=fixed.NUMBER_PATTERNS, around: int = 30) -> Column:
    """Numbers of known fields in running text, in order: `array<struct<field, value, raw_text>>`, null values where a match is no number."""
    def tagged(field: str):
        return lambda v: F.struct(F.lit(field).alias("field"), F.regexp_replace(v["value"], "[,，]", "").try_cast("double").alias("value"), v["context"].alias("raw_text"))

    return F.flatten(F.array(*[F.transform(F.when(text.rlike(p), matches(text, p, 1, around)).otherwise(F.array().cast("array<struct<value:string,context:string>>")), tagged(f)) for f, p in patterns]))


def numbers(pages: DataFrame, key, text: str, patterns=fixed.NUMBER_PATTERNS, around: int = 30) -> DataFrame:
    """Numbers of known fields in running text: `key, seq, field, value, raw_text`; what is no number is left out."""
    return exploded(pages, key, numbers_found(F.col(text), patterns, around)).where("value is not null")


def page_attachments(text: Column, page_num: Column, first: int = fixed.ATTACHMENT_PAGES[0], last: int = fixed.ATTACHMENT_PAGES[1]) -> Column:
    """Attachments that a front page shows; null for a page without text and for those after `last`."""
    return F.when(page_num.between(first, last) & filled(text).isNotNull(), attachments_present(text))


def gathered_attachments(names: Column) -> Column:
    """Aggregate: the attachments of a document's pages in their order; null where no page has text."""
    found = F.collect_list(names)
    return F.when(F.size(found) > 0, F.filter(F.array(*map(F.lit, fixed.ATTACHMENTS)), lambda n: F.exists(found, lambda p: F.array_contains(p, n))))


def attachments(pages: DataFrame, first: int = fixed.ATTACHMENT_PAGES[0], last: int = fixed.ATTACHMENT_PAGES[1]) -> DataFrame:
    """Attachments that a document's front pages show: `doc_id, attachments`, null where they have no text."""
    rows = pages.where(F.col("page_num").between(first, last)).select("doc_id", page_attachments(F.col("text"), F.col("page_num"), first, last).alias("names"))
    return rows.groupBy("doc_id").agg(gathered_attachments(F.col("names")).alias("attachments"))


def html_items(pages: DataFrame, key: str, html: str, tag: str = "li") -> DataFrame:
    """Texts of the elements of a tag, without tags inside: `key, item_no, item`."""
    items = F.regexp_extract_all(html, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)
    return pages.select(key, F.posexplode(items).alias("item_no", "item")).withColumn("item", F.trim(F.regexp_replace("item", "<[^>]+>", "")))
