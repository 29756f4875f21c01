"""Proportional stratified interleaving into shards (operator 9).

Rows are shuffled within each source by a seeded digest, get the fractional rank
(place - 1/2) / rows of the source, are ordered by that over all sources, and the order is cut
into shards of equal row counts (law `rows`: at most one apart), so each shard has every source
in the proportion of the whole.

No source is ranked in one task: places come from counts per (source, bucket of the digest) that
are summed first, and only the rows of one bucket are sorted together; the global order works
the same way on buckets of the fractional rank. Ties are broken by the digest and then by the
row's own number, so that repeated rows get places of their own. A null source is a source, a
null text has 0 bytes, a long text counts as one row whatever its size, an empty table gives no
rows, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossia.llm.kernels import cut


def places(df: DataFrame, by: list[str], bucket: Column, order: list, n_buckets: int) -> DataFrame:
    """`df` with `place`, the row's number from 0 in its `by` group in (bucket, order), ranked bucket by bucket."""
    keyed = df.withColumn("bucket", bucket)
    sums = keyed.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in by], F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy(*by, "bucket").orderBy(*order)
    ranked = keyed.withColumn("place", F.row_number().over(inside) - 1)
    on = F.col("bucket") == F.col("s_bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return ranked.join(sums, on).withColumn("place", F.col("place") + F.col("base")).drop("base", "s_bucket", "bucket", *[f"s_{c}" for c in by])


def interleaved_shards(docs: DataFrame, n_shards: int = 24, seed: str = "7", buckets: int = 1024) -> DataFrame:
    """`doc_id, source, size, text_crc32, law, shard, slot, grown_shard` of each row.

    buckets: the number of sub-groups that a source, and the whole order, is ranked in; a row's
    sub-group is sorted in memory or spilled, so 1/buckets of the largest source is what one task gets.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary")).alias("digest"),
    )
    rows = cut(rows)  # a few dozen bytes a row; the texts are read once
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("source", "f_source")
    slot = F.conv(F.substring("digest", 1, 6), 16, 10).cast("long") * buckets / F.lit(16**6)
    ranked = places(rows, ["source"], F.floor(slot).cast("int"), ["digest", "doc_id", "text_crc32"], buckets)
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("f_source"))).drop("f_source")
    # exact integers: (2 place + 1) / (2 of) as a fraction of 2^40
    ranked = ranked.withColumn("fraction", F.expr("cast(floor(cast(2 * place + 1 as decimal(20,0)) * 1099511627776 / (2 * of)) as bigint)"))
    ranked = places(ranked, [], F.floor(F.col("fraction") * buckets / F.lit(2**40)).cast("int"), ["fraction", "digest", "source", "doc_id", "text_crc32"], buckets)
    total = max(1, rows.count())
    ranked = ranked.withColumn("shard", F.expr(f"cast((place * {n_shards}) div {total}L as int)"))
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return ranked.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
