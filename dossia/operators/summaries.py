"""Aggregations and window operations of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossia.functions.text import let, running


def timing(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile, extremes and sample deviation (0 for one value).

    Values are counted before they are ranked, so that a window sorts distinct values (timings have milliseconds) and no rows.
    """
    rows = rows.where(F.col(value).isNotNull())
    sums = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"),
    )
    counted = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("many_"))
    upto = F.sum("many_").over(W.partitionBy(by).orderBy(value))
    ranked = counted.withColumn("upto_", upto).join(sums.select(F.col(by).alias("by_"), "n"), F.col(by).eqNullSafe(F.col("by_")))
    # the value at a rank from 0 is the first whose running count passes it
    def at(rank):
        return F.min(F.when(F.col("upto_") > rank, F.col(value)))

    p95 = F.bround(0.95 * (F.col("n") - 1), 0).cast("long")
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    places = ranked.groupBy("by_").agg(at(p95).alias("p95"), ((at(low) + at(high)) / 2).alias("median"))
    return sums.join(places, F.col(by).eqNullSafe(F.col("by_"))).select(by, "n", "mean", "median", "p95", "least", "most", "deviation")


def micro_average(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of summed tp, fp, fn; an empty denominator counts as 1, and F1 as 0 if both are 0."""
    s = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def latest(rows: DataFrame, by: str, order: list, n: int = 1) -> DataFrame:
    """The newest n rows of each group (a top-k report)."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("nth") <= n)


def islands(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers in each group: first, last and length."""
    one = rows.select(*by, number).distinct()
    marked = one.withColumn("island", F.col(number) - F.row_number().over(W.partitionBy(*by).orderBy(number)))
    return marked.groupBy(*by, "island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("length")).drop("island")


def flag_groups(rows: DataFrame, by: str, order: list[str], flag: str) -> DataFrame:
    """Neighbouring rows that have the flag, as numbered groups."""
    w = W.partitionBy(by).orderBy(*order)
    starts = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    marked = rows.withColumn("starts", starts).withColumn("group_no", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where(flag).groupBy(by, "group_no").agg(F.count(F.lit(1)).alias("members"))


def lines_with_previous(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Each line with the one before it ('' for the first), without a shuffle."""
    lines = F.split(text, "\n")
    pair = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.when(i == 0, "").otherwise(F.get(lines, i - 1)).alias("previous")))
    return pages.select(key, F.posexplode(pair).alias("line_no", "x")).select(key, "line_no", "x.line", "x.previous")


HEADING = r"^(#{1,3})\s+(.+)$"


def chunks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Heading-led chunks: `key, chunk_no, section_title, parent_title, text, char_count`, without those that are blank.

    A line of one to three `#` begins one; what is before the first has the title ''. The parent is the nearest shallower heading
    that still holds: the last one of each smaller level since a shallower one. Chunks are spans of lines, cut out before they become
    rows, so that no row carries more than its own; what holds at a heading is a running combination of the headings before it.
    """
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), 0)
    none = F.lit(None).cast("string")

    def head(x, i):
        return let(F.regexp_replace(x, r"\r?\n$", ""), lambda bare: F.when(bare.rlike(HEADING), F.struct(i.alias("at"), F.length(F.regexp_extract(bare, HEADING, 1)).alias("level"), F.trim(F.regexp_extract(bare, HEADING, 2)).alias("title"))))

    def state(h):
        return F.struct(F.when(h["level"] == 1, h["title"]).alias("one"), F.when(h["level"] == 2, h["title"]).alias("two"))

    def after(a, b):
        # a heading of the first level ends what held of the second
        return F.struct(F.coalesce(b["one"], a["one"]).alias("one"), F.when(b["one"].isNotNull(), b["two"]).otherwise(F.coalesce(b["two"], a["two"])).alias("two"))

    def cut(x):
        def chunk(title, parent, start, end):
            body = F.regexp_replace(F.array_join(F.slice(x["lines"], start + 1, end - start), ""), r"(?U)^\s+|\s+$", "")
            return F.struct(title.alias("section_title"), parent.alias("parent_title"), body.alias("text"))

        def end(i):
            return F.coalesce(F.get(x["heads"], i)["at"], F.size(x["lines"]))

        def led(holding):
            def of(h, i):
                before = F.get(holding, i - 1)
                parent = F.when(i > 0, F.when(h["level"] == 2, before["one"]).when(h["level"] == 3, F.coalesce(before["two"], before["one"])))
                return chunk(h["title"], parent, h["at"], end(i + 1))

            return F.transform(x["heads"], of)

        return F.concat(F.array(chunk(F.lit(""), none, F.lit(0), end(F.lit(0)))), let(running(F.transform(x["heads"], state), after), led))

    heads = lambda all_: F.filter(F.transform(all_, head), lambda h: h.isNotNull())
    spans = let(lines, lambda all_: let(F.struct(all_.alias("lines"), heads(all_).alias("heads")), cut))
    out = pages.select(key, F.posexplode(spans).alias("chunk_no", "c")).select(key, "chunk_no", "c.*")
    return out.withColumn("char_count", F.length("text")).where("text <> ''")


def label_counts(rows: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """Labels found rightly, wrongly and not at all, of two arrays a row, each taken as a set: adds `tp, fp, fn`."""
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    size = lambda c: F.size(c).cast("long")
    return rows.withColumn("tp", size(F.array_intersect(p, e))).withColumn("fp", size(F.array_except(p, e))).withColumn("fn", size(F.array_except(e, p)))
