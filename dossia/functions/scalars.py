"""Scalar functions on text, numbers and dates, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.text import let, nfkc


def without_space(c: Column) -> Column:
    """Text without any white space, for containment tests."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def normalised(c: Column) -> Column:
    """NFKC, no blanks, one spelling of Taipei's first character; null is empty."""
    return F.replace(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), "[ 　]", ""), F.lit("台"), F.lit("臺"))


def area_unit(c: Column) -> Column:
    """Spellings of the square metre as m2."""
    return F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), "㎡|平方公尺|平方米|m²|m2|M²|M2", "m2")


NUMBER = r"-?\d[\d,，]*(?:\.\d+)?"


def parse_number(c: Column) -> Column:
    """The first number in a text, signed, with thousands separators and blanks taken out; null if there is none."""
    return F.regexp_replace(F.regexp_extract(normalised(c), NUMBER, 0), "[,，]", "").try_cast("double")


def date_parts(text: Column) -> Column:
    """`struct<y, m, d>` of the first date in a normalised text."""
    pattern = r"(?U)(\d{2,4})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})"
    return F.struct(*[F.regexp_extract(text, pattern, k).try_cast("int").alias(n) for k, n in ((1, "y"), (2, "m"), (3, "d"))])


def normalize_date(c: Column) -> Column:
    """`YYYY-MM-DD` of a date in either calendar (years under 1911 count from 1911); null outside the ranges."""
    def shown(x):
        y, m, d = x["y"], x["m"], x["d"]
        year = F.when(y < 1911, y + 1911).otherwise(y)
        return F.when(m.between(1, 12) & d.between(1, 31) & y.isNotNull(), F.format_string("%04d-%02d-%02d", year, m, d))

    return let(date_parts(nfkc(c)), shown)


def roc_text(date: Column) -> Column:
    """A date as `Y年M月D日` of the local calendar."""
    return F.concat((F.year(date) - 1911).cast("string"), F.lit("年"), F.month(date).cast("string"), F.lit("月"), F.dayofmonth(date).cast("string"), F.lit("日"))


def values_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Equal as nothing, as numbers within a tolerance where both are whole numbers of their text, as dates, or as text, in this order."""
    def judged(x):
        a, b = x["a"], x["b"]  # normalised
        whole = lambda c: F.regexp_replace(c, "[ 　]", "").rlike(f"^{NUMBER}$")
        blank = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s", " ")) == ""
        dates = let(F.struct(normalize_date(a).alias("a"), normalize_date(b).alias("b")), lambda d: F.when(d["a"].isNotNull() & d["b"].isNotNull(), d["a"] == d["b"]))
        return (
            F.when(blank(a) & blank(b), True).when(blank(a) | blank(b), False)
            .when(whole(a) & whole(b), F.abs(parse_number(a) - parse_number(b)) <= tolerance)
            .otherwise(F.coalesce(dates, area_unit(normalised(a)) == area_unit(normalised(b))))
        )

    text = lambda c: nfkc(F.coalesce(c, F.lit("")))
    return let(F.struct(text(a).alias("a"), text(b).alias("b")), judged)


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Close by the larger of an absolute and a relative tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), F.abs(b) * tolerance)


def accessible_required(n: Column) -> Column:
    """Accessible places that a number of legal places asks for."""
    return F.when(n <= 0, 0).when(n <= 50, 1).when(n <= 300, 1 + F.ceil((n - 50) / 50)).otherwise(6 + F.ceil((n - 300) / 100)).cast("long")


def any_word(c: Column, words: list[str]) -> Column:
    """Whether a text has any of the words: one pattern, which keeps plans small."""
    return c.rlike("|".join(map(re.escape, words)))


def first_of(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first case that holds."""
    out = reduce(lambda c, case: c.when(*case), cases[1:], F.when(*cases[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def rank_of(c: Column, ranks: dict[str, int], unknown: int = 9) -> Column:
    return first_of([(c == k, F.lit(v)) for k, v in ranks.items()], F.lit(unknown))


def topic(rule_id: Column) -> Column:
    """The topic of a rule id; the first rule that holds decides."""
    r = F.upper(F.coalesce(rule_id, F.lit("")))
    has = lambda *parts: any_word(r, list(parts))
    return first_of([
        (has("FAR") | r.isin("CALC-001", "CALC-004"), F.lit("bonus")), (r.isin("CALC-002", "CALC-003"), F.lit("parking")), (has("CON-"), F.lit("consent")),
        (has("DATE"), F.lit("date")), (has("PII"), F.lit("pii")), (has("TERM"), F.lit("term")), (has("AREA", "OWN", "VAL", "IMP"), F.lit("crossdoc")),
        (has("CONS"), F.lit("consistency")), (has("DOC"), F.lit("document")), (has("FORM"), F.lit("form")),
    ], F.lit("other"))


def attachments_present(text: Column) -> Column:
    """Names of attachments that a text shows, in order; null for blank text."""
    names = F.array_compact(F.array(*[F.when(any_word(text, words), F.lit(name)) for name, words in fixed.ATTACHMENTS.items()]))
    return F.when(F.trim(text) != "", names)


def context(text: Column, at: Column, length: Column, around: int) -> Column:
    """What stands around a place (from 1), on one line."""
    start = F.greatest(F.lit(1), at - around)
    return F.trim(F.replace(F.substr(text, start, at + length + around - start), F.lit("\n"), F.lit(" ")))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: the whole, without code fences, or from the first brace to the last; null if there is none."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?m)^```(?:json)?|```$", ""))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.startswith(F.trim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), F.trim(c))
    return F.coalesce(ok(text), ok(bare), ok(inner))
