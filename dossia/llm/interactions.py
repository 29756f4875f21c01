"""Filter interaction audit: what each filter removes in every order of the filters (operator 11).

A document's failures are a set of filters. It contributes to the edges (filters applied already, next filter) of the
lattice of subsets: five filters have 80. Documents are counted by part, failures and labels first, so that an edge adds
up at most 4 * 32 counts of a part; an order of the filters is a path of five edges, and the aggregated edges are joined
to the 600 steps of all orders.

Copies are told by a SHA-256 of the whole text: rows alike in text, part, failures and labels become one count with its
smallest doc_id before rows of a text meet, so a text that a third of all rows share is a few rows there.

Null text is empty, null part is the empty string; a row without doc_id never counts as a copy and is nobody's original;
rows repeated with the smallest doc_id of their text are all originals; of a doc_id labelled more than once each label
counts if any row has it; labels without a document and other columns are ignored; an empty table gives no rows. Texts of any
length are read whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
#: The filter that drops copies: it sees the table, the others a text.
COPIES = "E"


def rules(text: Column) -> dict[str, Column]:
    """Whether a text fails: under 100 words, words that repeat, capitals, symbols."""
    words = F.array_remove(F.split(text, BLANK), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, filters: dict[str, Column], part: str) -> DataFrame:
    """`id, part, digest, mask`: which of the filters that see a text each row fails, as bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = reduce(Column.__add__, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())])
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def counted(rows: DataFrame, labels: DataFrame, copies_bit: int) -> DataFrame:
    """`part, mask, good, toxic, n`: how many documents fail just these filters, copies among them."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows without an id match nothing: they are dealt by their text
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    known = rows.join(marked.withColumn("salt", F.lit(0).cast("long")).withColumnRenamed("l_id", "id"), ["id", "salt"], "left")
    kind = ["digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    each = known.groupBy("id", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    # of rows alike: how many, the smallest id and how many have it; rows without an id originate nothing and are no copies
    alike = each.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first")
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = alike.withColumn("least", least).select("part", "good", "toxic", "mask", "n", originals.alias("originals"))
    both = F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + copies_bit).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("x")).groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n")).where("n > 0")


def edges(names: list[str]) -> list[tuple[int, int, int]]:
    """(set of filters applied before, the next one's bit, in how many orders) of every edge of the lattice."""
    k = len(names)
    out = []
    for i in range(k):
        others = [1 << j for j in range(k) if j != i]
        out += [(sum(c), 1 << i, factorial(r) * factorial(k - 1 - r)) for r in range(k) for c in combinations(others, r)]
    return out


def paths(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, set before, bit) of each step of every order."""
    bit = {n: 1 << i for i, n in enumerate(names)}
    return [("".join(p), s + 1, sum(bit[x] for x in p[:s]), bit[x]) for p in permutations(names) for s, x in enumerate(p)]


def lattice(counts: DataFrame, names: list[str]) -> DataFrame:
    """What happens on each edge: `part, before, bit, kept, removed, ...` of counts by part and failures."""
    edge = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("before", "bit", "orders"), e)]) for e in edges(names)]))
    fails, clear = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    removed = fails & clear
    sums = {"kept": ~fails & clear, "removed": removed, "redundant": fails & ~clear, "unique_fails": F.col("mask") == F.col("bit"), "good_lost": removed & F.col("good"), "toxic_lost": removed & F.col("toxic")}
    return counts.withColumn("edge", edge).select("*", "edge.*").groupBy("part", "before", "bit", "orders").agg(*[n(c).alias(k) for k, c in sums.items()])


def interaction_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "lang") -> DataFrame:
    """`part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley` for every part, order and step.

    `filters` has conditions over docs by one-letter names, at most seven; the filter of copies comes after them.
    """
    filters = rules(F.coalesce(F.col("text").cast("string"), F.lit(""))) if filters is None else filters
    if len(filters) > 7:
        raise ValueError("the orders of more than eight filters are too many to list")
    names = [*filters, COPIES]
    counts = counted(failures(docs, filters, part), labels, 1 << len(filters))
    found = lattice(counts, names)
    found = found.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "bit")))
    steps = docs.sparkSession.createDataFrame(paths(names), "filter_order string, step int, p_before int, p_bit int")
    walked = found.join(F.broadcast(steps), (F.col("before") == F.col("p_before")) & (F.col("bit") == F.col("p_bit")))
    return walked.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle() -> str:
    """The audit in DuckDB's SQL: every document against every step of every order, by the letters it fails."""
    letters = "(values ('A'), ('B'), ('C'), ('D'), ('E'))"
    return f"""
        with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
        w as (select *, [x for x in regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') if x <> ''] as ws, min(doc_id) over (partition by text) as least from t),
        l as (select doc_id, max(coalesce(quality, 0)) as quality, max(coalesce(toxic, 0)) as toxic from labels group by doc_id),
        f as (select part, coalesce(quality, 0) = 1 as good, coalesce(toxic, 0) = 1 as toxic,
                     (case when len(ws) < 100 then 'A' else '' end) || (case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 'B' else '' end)
                     || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 'C' else '' end)
                     || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > least then 'E' else '' end) as fails
              from w left join l using (doc_id)),
        g as (select part, good, toxic, fails, count(*) as n from f group by all),
        o as (select a.x || b.x || c.x || d.x || e.x as filter_order
              from {letters} a(x), {letters} b(x), {letters} c(x), {letters} d(x), {letters} e(x)
              where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s as (select filter_order, step::integer as step, filter_order[step] as filter, filter_order[1:step - 1] as before from o, range(1, 6) r(step)),
        j as (select *, contains(fails, filter) as here, regexp_matches(fails, '[' || case when before = '' then '0' else before end || ']') as gone from g, s),
        k as (select part, filter_order, step, filter,
                     coalesce(sum(n) filter (not here and not gone), 0)::bigint as kept, coalesce(sum(n) filter (here and not gone), 0)::bigint as removed,
                     coalesce(sum(n) filter (here and gone), 0)::bigint as redundant, coalesce(sum(n) filter (fails = filter), 0)::bigint as unique_fails,
                     coalesce(sum(n) filter (here and not gone and good), 0)::bigint as good_lost, coalesce(sum(n) filter (here and not gone and toxic), 0)::bigint as toxic_lost
              from j group by all)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from k"""
