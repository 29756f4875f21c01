"""Joins of the audit: runs, versions, documents, quotes and geometry against each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dossia.functions import fixed
from dossia.functions.rolling import windows
from dossia.functions.scalars import topic, without_space
from dossia.functions.text import nfkc


def version_asof(rows: DataFrame, date: str, versions: list[tuple[str, str]] = fixed.VERSIONS, default: str = fixed.DEFAULT_VERSION) -> DataFrame:
    """Rows with the version in force on their date; before the first it is the first, without a date the default.

    The few versions are an expression, so the as-of lookup needs no join.
    """
    label = F.lit(versions[0][0])
    kind = rows.schema[date].dataType  # dates, or texts that sort as dates
    for name, since in versions[1:]:
        label = F.when(F.col(date) >= F.lit(since).cast(kind), F.lit(name)).otherwise(label)
    return rows.withColumn("version", F.when(F.col(date).isNull(), default).otherwise(label))


def consecutive_diff(rows: DataFrame, version: str, key: str, value: str) -> DataFrame:
    """Keys added, removed or updated from one version to the next (full outer join of neighbours)."""
    order = rows.select(version).distinct().withColumn("next", F.lead(version).over(W.orderBy(version)))
    a = rows.join(order, version).where("next is not null").select(F.col("next").alias("v"), F.col(key).alias("k"), F.col(value).alias("old"))
    b = rows.join(order.select(F.col("next").alias(version)).where(f"{version} is not null"), version).select(F.col(version).alias("v"), F.col(key).alias("k"), F.col(value).alias("new"))
    both = a.join(b, ["v", "k"], "full_outer").where("not (old <=> new)")
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("updated"))


def number_consistency(expected: DataFrame, found: DataFrame, on: list[str], tolerance: float = fixed.NUMBER_TOLERANCE) -> DataFrame:
    """Status of each expected value against the numbers found for it: no number warns, one that is off fails."""
    seen = found.groupBy(*on).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    off = F.greatest(F.abs(F.col("low") - F.col("value")), F.abs(F.col("high") - F.col("value")))
    return expected.join(seen, on, "left").withColumn("status", F.when(F.col("value").isNull(), "skip").when(F.col("low").isNull(), "warn").when(off > tolerance, "fail").otherwise("pass"))


def confidence(findings: DataFrame, failing: DataFrame, by: list[str] = ()) -> DataFrame:
    """Findings (source, rule_id, severity, verified) with corroboration by failing rules of the same topic, score and review flag.

    by: the columns of both that tell whose findings they are; without, all are of one audit.
    """
    topics = failing.select(*[F.col(k).alias(f"t_{k}") for k in by], topic(F.col("rule_id")).alias("t")).where("t <> 'other'").distinct()
    same = F.col("topic") == F.col("t")
    for k in by:
        same = same & (F.col(k) == F.col(f"t_{k}"))
    rows = findings.withColumn("topic", topic(F.col("rule_id"))).join(topics, same, "left")
    rows = rows.withColumn("corroborated", F.col("t").isNotNull()).drop("t", *[f"t_{k}" for k in by])
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fixed.CONFIDENCE_BASE.items() for x in kv]), F.col("source")), F.lit(fixed.CONFIDENCE_OTHER))
    moved = base + F.when(F.col("verified"), fixed.EVIDENCE_BOOST).when(F.col("source") == "llm", fixed.UNVERIFIED_LLM).otherwise(0.0) + F.when(F.col("corroborated"), fixed.CORROBORATED).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))
    review = (score < fixed.REVIEW_BELOW) | ((F.col("severity") == "critical") & ~F.col("verified"))
    return rows.withColumn("needs_review", review).withColumn("confidence", F.round(score, 2))


def quote_places(quotes: DataFrame, pages: DataFrame, key: list[str], quote: str = "quote") -> DataFrame:
    """The quotes with `found`, `page_num`, `start` and `end`: the first place in the pages of the quote's own document.

    quotes: doc_id and the columns of `key`, which tell a document's quotes apart; pages: doc_id, page_num, text. White space and
    width of characters don't count, and places count what is left of a page, from 0, the end exclusive. A quote of fewer than MIN_QUOTE
    characters, or none, is nowhere.

    The documents are met by doc_id alone, so what is shuffled are the quotes that can be found and the pages of documents that have one.
    """
    flat = lambda c: without_space(nfkc(c))
    on = ["doc_id", *[k for k in key if k != "doc_id"]]
    q = F.col(quote)
    asked = quotes.where(F.length(F.regexp_replace(q, r"(?U)^\s+|\s+$", "")) >= fixed.MIN_QUOTE).select(*[F.col(k).alias(f"q_{k}") for k in on], flat(q).alias("q_"))
    there = pages.select(F.col("doc_id").alias("q_doc_id"), "page_num", flat(F.col("text")).alias("p_"))
    at = F.instr(F.col("p_"), F.col("q_")) - 1
    hits = there.join(asked, "q_doc_id").withColumn("start", at).where("start >= 0")
    first = hits.groupBy(*[f"q_{k}" for k in on]).agg(F.min(F.struct("page_num", "start", (F.col("start") + F.length("q_")).alias("end"))).alias("at_"))
    same = [F.col(k).eqNullSafe(F.col(f"q_{k}")) if k != "doc_id" else F.col(k) == F.col(f"q_{k}") for k in on]
    out = quotes.join(first, same, "left")
    return out.select(*quotes.columns, F.col("at_").isNotNull().alias("found"), "at_.page_num", "at_.start", "at_.end")


QUOTE_BYTES, SEED = 8 << 20, 24


class Quotes:
    """A block of quotes: of each, the hash of a piece from its middle, by length of piece."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.by_width = {}
        for w in sorted({min(SEED, len(t)) for t in texts}):
            own = [k for k, t in enumerate(texts) if min(SEED, len(t)) == w]
            pieces = np.frombuffer(b"".join(texts[k][(len(texts[k]) - w) // 2 :][:w] for k in own), np.uint8)
            found = np.concatenate([h for n in range(0, len(pieces), w) for _, h in windows(pieces[n : n + w], w)])
            order = np.argsort(found, kind="stable")
            self.by_width[w] = found[order], np.array(own)[order]

    def inside(self, text: bytes) -> list[int]:
        """Numbers of the quotes that a text holds."""
        data, hits = np.frombuffer(text, np.uint8), set()
        for w, (known, own) in self.by_width.items():
            for _, h in windows(data, w):
                h = np.unique(h)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for x in h[known[at] == h]:
                    hits.update(own[np.searchsorted(known, x) : np.searchsorted(known, x, "right")].tolist())
        return sorted(k for k in hits if self.texts[k] in text)


def grounded(quotes: DataFrame, pages: DataFrame, quote: str, text: str) -> DataFrame:
    """Pairs of a quote and a text that holds it, white space and width of characters aside: the columns of both.

    Quotes of fewer than MIN_QUOTE characters are in no text. Quotes go to all tasks in blocks of QUOTE_BYTES, a scan of the
    texts for each; a text's windows are met with a piece of each quote by hash, and what meets is checked. Texts don't move.
    """
    flat = lambda c: without_space(nfkc(F.col(c))).cast("binary")
    spark = pages.sparkSession
    rows = quotes.where(F.length(without_space(nfkc(F.col(quote)))) >= fixed.MIN_QUOTE).withColumn("q_", flat(quote))
    schema = StructType([*quotes.schema, StructField("q_no", IntegerType())])
    out = None
    for block in blocks(rows.toLocalIterator(), QUOTE_BYTES):
        sent = spark.sparkContext.broadcast(Quotes([bytes(r["q_"]) for r in block]))

        def run(batches, sent=sent):
            for batch in batches:
                at, no = [], []
                for k, t in enumerate(batch.column("p_")):
                    found = sent.value.inside(t.as_py() or b"")
                    at += [k] * len(found)
                    no += found
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in batch.schema.names if c != "p_"), pa.array(no, pa.int32())], names=[c for c in batch.schema.names if c != "p_"] + ["q_no"])

        hit = pages.withColumn("p_", flat(text)).mapInArrow(run, StructType([*pages.schema, StructField("q_no", IntegerType())]))
        own = spark.createDataFrame([(*r[:-1], k) for k, r in enumerate(block)], schema)
        got = hit.join(own, "q_no").drop("q_no")
        out = got if out is None else out.unionByName(got)
    return pages.join(quotes, F.col(text) == F.col(quote)).where("false") if out is None else out


def blocks(rows, most: int):
    """Rows with a binary last column in lists of about so many bytes of it."""
    own, size = [], 0
    for r in rows:
        if own and size + len(r[-1]) > most:
            yield own
            own, size = [], 0
        own.append(r)
        size += len(r[-1])
    if own:
        yield own


def right_neighbours(boxes: DataFrame, by: list[str], labels: str, cell: float = 64.0) -> DataFrame:
    """Boxes right of a label on its row, nearest first: vertical distance at most 0.6 of the larger height.

    Rows are found by cells of the vertical centre, so the join has equal keys besides the ranges.
    """
    a = boxes.where(labels).select(*by, *[F.col(c).alias(f"l_{c}") for c in ("seq", "x0", "x1", "yc", "h")])
    b = boxes.withColumn("cell", F.floor(F.col("yc") / cell))
    reach = F.floor(F.col("l_yc") / cell)
    a = a.withColumn("cell", F.explode(F.array(reach - 1, reach, reach + 1)))
    near = (F.abs(F.col("yc") - F.col("l_yc")) <= 0.6 * F.greatest("h", "l_h")) & (F.col("x0") - F.col("l_x1") >= -F.col("l_h")) & (F.col("seq") != F.col("l_seq"))
    return a.join(b, [*by, "cell"]).where(near).drop("cell").withColumn("nth", F.row_number().over(W.partitionBy(*by, "l_seq").orderBy("x0", "seq")))
