"""A training corpus from raw documents: five stages, each an operator of dossia.llm.

Every stage takes all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from dossia.llm import decontaminate, jaccard, packing, quality, suffixes
from dossia.llm.kernels import cut, written
from dossia.llm.queries import tokenizer
from dossia.llm.suffixes import PASSAGE_BYTES, PASSAGE_WORDS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are content for the greater part.

    Null and empty texts go (they have no words); repeated rows are judged each; without labels of both kinds the base rules alone decide; a text of any
    length is judged whole; an empty table stays empty; further columns stay as they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs, quality.train(docs, labels), keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join: of its smallest doc_id, if a row has one; rows without words all stay.

    Where an id is repeated or missing, the row is told by its class too, and the smallest text stands for rows alike in both
    (then the smallest of the other columns that can be ordered, so one row is left of any number of repeated ones).
    """
    named = cut(jaccard.rooted(docs))
    first = named.where("key <> 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("k_id"), F.col("x.key").alias("k_key"))
    many = named.where("doc_id is not null").groupBy(F.col("doc_id").alias("m_id")).count().where("count > 1").select("m_id")
    # the columns of docs travel in one, so that no name of theirs clashes
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # an id that one row has is enough to know it by
    alone = kept.select("k_id").unionByName(named.where("key = 0").select(F.col("doc_id").alias("k_id"))).where("k_id is not null")
    alone = rows.join(alone.join(many, F.col("k_id") == F.col("m_id"), "left_anti"), F.col("doc_id") == F.col("k_id"), "left_semi")
    others = rows.join(many, F.col("doc_id") == F.col("m_id"), "left_semi").unionByName(rows.where("doc_id is null"))
    others = jaccard.with_class_key(others)
    told = kept.join(many, F.col("k_id") == F.col("m_id"), "left_semi").unionByName(kept.where("k_id is null"))
    found = others.join(told, (F.col("class_key") == F.col("k_key")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
    plain = [F.col(f"row.{f.name}") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    one = found.groupBy("class_key").agg(F.min_by("row", F.struct("text", *plain)).alias("row"))
    return alone.select("row.*").unionByName(one.select("row.*")).unionByName(others.where("class_key = 0").select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE_WORDS words or more that occur elsewhere too, byte for byte.

    Documents of which nothing but blanks is left go, and so do those without text (null or blank) to begin with.
    """
    out = suffixes.deduplicated(docs, PASSAGE_BYTES, PASSAGE_WORDS).where(F.trim(F.regexp_replace("text", r"\s", " ")) != "")
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, whole or edited.

    Null and empty texts hold none and stay; repeated rows are judged each; without items all stay; long texts are searched whole; an empty table
    stays empty; further columns stay as they are.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their ids.

    Null and empty texts are their end token; repeated rows are packed each; long texts are cut over sequences; an empty table gives no pieces; further
    columns play no part.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), extra_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The line labeller, the suffix order and the alignments aren't SQL. Tests hold single stages against plain versions; of run() as a whole only that it gives rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
