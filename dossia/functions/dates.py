"""Dates of the local calendar in text: strict, spaced, compact, dotted, and coded in document numbers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.text import let, located, pieces, stretch

Y, M, D = r"((?:\d\s*){2,4})年\s*", r"((?:\d\s*){1,2})月\s*", r"((?:\d\s*){1,2})日"
STRICT = r"(?U)中\s*華\s*民\s*國\s*" + Y + M + D
SPACED = r"(?U)(?:中\s*華\s*民\s*國\s*)?" + Y + M + D
COMPACT = r"(\d{3})年(\d{1,2})月(\d{1,2})日"
DOTTED = r"(\d{3})\.(\d{2})\.(\d{2})"
CODED = r"(?U)報核[^\n]*字第(\d{3})(\d{2})(\d{2})\d+\s*號"
FILE = r"(?:^|[_\-\s])(\d{3})(\d{2})(\d{2})(?:[^0-9]|$)"


def valid(y: Column, m: Column, d: Column) -> Column:
    return y.between(*fixed.ROC_YEARS) & m.between(1, 12) & d.between(1, 31)


def shown(y: Column, m: Column, d: Column) -> Column:
    """`Y年M月D日` of a valid date, null for others."""
    return F.when(valid(y, m, d), F.concat(y.cast("string"), F.lit("年"), m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日")))


def first_date(text: Column, pattern: str) -> Column:
    """The first match of a pattern with three groups, blanks inside numbers aside; null if that one is no date."""
    part = lambda k: F.regexp_replace(F.regexp_extract(text, pattern, k), r"(?U)\s+", "").try_cast("int")
    return let(F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")), lambda x: shown(x["y"], x["m"], x["d"]))


def all_dates(text: Column, pattern: str) -> Column:
    """`array<struct<key, shown>>` of every match that is a date; keys sort as the dates do."""
    def one(x, i):
        y, m, d = (F.get(x[f"g{k}"], i).try_cast("int") for k in (1, 2, 3))
        return F.struct(F.format_string("%03d%02d%02d", y, m, d).alias("key"), shown(y, m, d).alias("shown"))

    groups = F.struct(*[F.regexp_extract_all(text, F.lit(pattern), k).alias(f"g{k}") for k in (1, 2, 3)])
    found = let(groups, lambda x: F.transform(x["g1"], lambda _, i: one(x, i)))
    return F.filter(found, lambda x: x["shown"].isNotNull())


def strict_date(text: Column) -> Column:
    return first_date(text, STRICT)


def spaced_date(text: Column) -> Column:
    return first_date(text, SPACED)


def file_date(name: Column) -> Column:
    """The date that a file name begins with or has as a part: YYYMMDD."""
    return first_date(name, FILE)


def coded_date(text: Column) -> Column:
    """`struct<shown, source>` of a date coded in a filing's document number, with the number and who issued it."""
    def source(whole):
        number = F.regexp_extract(whole, r"(?U)字第(\d+)\s*號", 1)
        at = F.instr(text, whole)
        around = F.substr(text, F.greatest(F.lit(1), at - 15), F.length(whole) + F.least(at - 1, F.lit(15)))
        body = F.regexp_extract(around, r"(?U)(\S{2,8}更新會)字第", 1)
        return F.concat(F.lit("申請書文號（"), body, F.lit("字第"), number, F.lit("號）"))

    found = let(first_date(text, CODED), lambda d: F.when(d.isNotNull(), F.struct(d.alias("shown"), let(F.regexp_extract(text, CODED, 0), source).alias("source"))))
    return F.when(text.rlike(CODED), found)


#: Characters before a filing keyword in which its date may stand.
NEAR = 30


def near_keyword_date(text: Column) -> Column:
    """The date near a filing keyword: keywords in order, then their places; in 30 characters before and the keyword's line, a compact date, else a dotted one.

    Lines with the keyword are found in one pass, then its places in each; what follows the first date isn't looked at.
    """
    def of_word(word: str) -> Column:
        def in_line(cut, line):
            def later(found, at):
                before = stretch(cut, line["start"] + at["start"] - NEAR, line["start"] + at["end"])
                snippet = F.concat(before, line["value"])
                return F.when(found.isNull(), let(snippet, lambda s: F.coalesce(first_date(s, COMPACT), first_date(s, DOTTED)))).otherwise(found)

            return F.aggregate(located(line["value"], word), F.lit(None).cast("string"), later)

        def of_lines(x):
            return F.aggregate(x["lines"], F.lit(None).cast("string"), lambda found, line: F.when(found.isNull(), in_line(x["cut"], line)).otherwise(found))

        return let(F.struct(pieces(text).alias("cut"), located(text, rf"[^\n]*{word}[^\n]*").alias("lines")), of_lines)

    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), of_word(w)) for w in fixed.FILED_KEYWORDS])


def filing_date(text: Column) -> Column:
    """The latest filing date of a process table: coded in document numbers on any line, or on a line that speaks of filing.

    A line speaks of filing if it or the one before says so and neither names another stage.
    """
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")

    def of_line(all_, line, i):
        before = F.when(i == 0, "").otherwise(F.get(all_, i - 1))
        stage = let(F.concat(before, line), lambda both: F.contains(both, F.lit("報核")) & ~both.rlike("|".join(fixed.OTHER_STAGES)) & ~F.trim(both).isin("報核版", "報核"))
        coded = all_dates(line, r"(?U)字\s*第\s*(\d{3})(\d{2})(\d{2})\d{2,}\s*號")
        plain = F.concat(all_dates(line, r"(\d{3})\.(\d{1,2})\.(\d{1,2})"), all_dates(line, r"(?U)(\d{3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"))
        dated = F.when(stage, F.concat(coded, plain)).otherwise(coded)
        return F.when(line.rlike(r"\d{3}"), dated)

    found = let(lines, lambda all_: F.transform(all_, lambda line, i: of_line(all_, line, i)))
    return F.array_max(F.flatten(F.array_compact(found)))["shown"]


def iso_date(c: Column) -> Column:
    """`YYYY-MM-DD` of a date of the local calendar, as text and without a check of its ranges."""
    pattern = r"(?U)(\d+)\s*年\s*(\d+)\s*月\s*(\d+)\s*日"
    y, m, d = (F.regexp_extract(c, pattern, k).try_cast("int") for k in (1, 2, 3))
    return F.when(c.rlike(pattern), F.format_string("%04d-%02d-%02d", y + 1911, m, d))
