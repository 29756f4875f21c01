"""Unicode normalisation and number formats as Column expressions, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(c: Column) -> Column:
    """NFKC of a text, by the Unicode library that Spark itself brings for its collations; texts in ASCII pass as they are.

    The call counts as nondeterministic, so Catalyst works it out once in a column of its own and never inside an aggregate: normalise in a
    select before grouping.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7f]"), composed).otherwise(c)


def let(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(numbers: Column, combine=lambda a, b: a + b, longest: int = 1 << 30) -> Column:
    """What an array adds up to at each of its places (or another associative `combine`), in as many passes as its length has binary digits."""
    steps = F.expr(f"array({', '.join(str(1 << k) for k in range(longest.bit_length() - 1))})")

    def scanned(a):
        def doubled(sums, step):
            return F.transform(sums, lambda x, i: F.when(i >= step, combine(F.get(sums, i - step), x)).otherwise(x))

        return F.aggregate(F.filter(steps, lambda s: s < F.size(a)), a, doubled)

    return let(numbers, scanned)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern that matches no empty text: `array<struct<value, start, end>>`, the places of the whole match counted from 0, in one pass over the matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), group)

    def placed(x):
        # a match begins as far after the one before as that and the text between them are long
        steps = F.transform(x["whole"], lambda w, i: F.length(F.get(x["between"], i)) + F.when(i > 0, F.length(F.get(x["whole"], i - 1))).otherwise(0))
        return let(running(steps), lambda starts: F.transform(x["value"], lambda v, i: F.struct(v.alias("value"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(F.get(x["whole"], i))).alias("end"))))

    return let(F.struct(whole.alias("whole"), value.alias("value"), F.split(text, pattern).alias("between")), placed)


#: Characters of a piece of text: finding a place costs no more than this.
PIECE = 256


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, for `stretch`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)


def stretch(cut: Column, start: Column, end: Column) -> Column:
    """The characters of a text from `start` to before `end`, counted from 0, out of its pieces; nothing before or after the text."""
    start = F.greatest(F.lit(0), start)
    first = F.floor(start / PIECE).cast("int")
    near = F.array_join(F.slice(cut, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substr(near, start - first * PIECE + 1, end - start)


def fixed_point(c: Column, digits: int = 2, grouped: bool = True) -> Column:
    """A number with so many decimals, with thousands separators or without."""
    text = F.format_number(c, digits)
    return text if grouped else F.regexp_replace(text, ",", "")


def shortest(c: Column) -> Column:
    """A number in six significant digits without zeros at the end, as `%g` gives it."""
    d = c.cast("double")
    exponent = F.regexp_extract(F.format_string("%.5e", d), r"e([+-]\d+)$", 1).try_cast("int")  # after rounding to six digits
    scientific = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", d), r"\.?0+e", "e"), r"e([+-])(\d)$", "e$1" + "0$2")
    # so many decimals that six digits stay; format_number rounds halves to even
    plain = F.regexp_replace(F.call_function("format_number", d, 5 - F.greatest(F.lit(-4), F.least(exponent, F.lit(5)))), ",", "")
    fixed = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(d == 0, "0").when((exponent < -4) | (exponent >= 6), scientific).otherwise(fixed)


def python_number(c: Column) -> Column:
    """A double as its shortest text with a decimal, an integer without."""
    return F.when(c == F.floor(c), F.concat(F.format_string("%d", c.cast("long")), F.lit(".0"))).otherwise(c.cast("string"))
