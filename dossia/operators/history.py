"""Run history: saving with metrics, growing schemas, clearing test runs, comparing with the run before and with peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.scalars import any_word
from dossia.sources.tables import RUNS

METRICS = ["submission_type", "bonus_pct", "critical_count", "high_count", "warn_count", "parking_pass", "pii_high_count"]
FINDINGS = "array<struct<rule_id:string,rule_name:string,status:string,message:string,evidence:string>>"


def encoded(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """Each document's findings as one JSON array, in rule order: `by, findings`."""
    item = F.struct("seq", F.struct("rule_id", "rule_name", "status", "message", "evidence").alias("f"))
    return findings.groupBy(by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]), {"ignoreNullFields": "false"}).alias("findings"))


def decoded(runs: DataFrame, by: list[str]) -> DataFrame:
    """The findings in the JSON of each run; text that isn't such an array has none."""
    return runs.select(*by, F.posexplode(F.from_json("findings", FINDINGS)).alias("seq", "f")).select(*by, "seq", "f.*")


def is_test(filename: Column, case_name: Column) -> Column:
    """Uploads of tests, by the file's name in any case or the case's name as it is."""
    name = lambda c: F.coalesce(c, F.lit(""))
    return any_word(F.lower(name(filename)), fixed.TEST_MARKERS) | any_word(name(case_name), fixed.TEST_MARKERS)


def bonus_pct(bonus: Column, base: Column, limit: Column) -> Column:
    """Bonus as a share of the base area in percent; the base is twice the limit where it is missing or 0."""
    whole = F.coalesce(F.nullif(base, F.lit(0.0)), F.nullif(limit, F.lit(0.0)) * 2)
    return F.when((bonus != 0) & (whole > 0), F.round(bonus / whole * 100, 1))


def metrics(findings: DataFrame, tables: DataFrame, pii: DataFrame) -> DataFrame:
    """The columns that runs are compared by: one row a document.

    findings: doc_id, rule_id, status, severity; tables: doc_id, submission_type and areas; pii: doc_id, severity.
    """
    fail = F.col("status") == "fail"
    parking = F.when(F.col("rule_id").isin("CALC-002", "CALC-003"), F.col("status") == "pass")
    f = findings.groupBy("doc_id").agg(
        F.count_if(fail & (F.col("severity") == "critical")).alias("critical_count"), F.count_if(fail & (F.col("severity") == "high")).alias("high_count"),
        F.count_if(F.col("status") == "warn").alias("warn_count"), F.bool_and(parking).cast("int").alias("parking_pass"),
    )
    p = pii.groupBy("doc_id").agg(F.count_if(F.col("severity") == "HIGH").alias("pii_high_count"))
    t = tables.select("doc_id", "submission_type", bonus_pct(F.col("bonus_floor_area"), F.col("base_floor_area"), F.col("bonus_limit")).alias("bonus_pct"))
    return f.join(t, "doc_id", "left").join(p, "doc_id", "left").fillna(0, ["pii_high_count"]).select("doc_id", *METRICS)


def migrated(runs: DataFrame, schema: str = RUNS) -> DataFrame:
    """Runs with the columns that the schema has and they lack, as null; further columns stay."""
    empty = runs.sparkSession.createDataFrame([], schema)
    return empty.unionByName(runs, allowMissingColumns=True)


def with_metrics(runs: DataFrame, new: DataFrame) -> DataFrame:
    """The newest run of each case gets its metrics (case_name and METRICS); older runs stay as they are."""
    newest = F.row_number().over(W.partitionBy("case_name").orderBy(F.desc("id"))) == 1
    other = new.select(F.col("case_name").alias("n_case"), F.lit(True).alias("n_set"), *[F.col(c).alias(f"n_{c}") for c in METRICS])
    joined = runs.withColumn("newest_", newest).join(other, (F.col("case_name") == F.col("n_case")) & F.col("newest_"), "left")
    return joined.select(*[F.when(F.col("n_set"), F.col(f"n_{c}")).otherwise(F.col(c)).cast(runs.schema[c].dataType).alias(c) if c in METRICS else F.col(c) for c in runs.columns])


def without_tests(runs: DataFrame) -> DataFrame:
    """The history without test runs, by their case's name in any case of letters."""
    test = F.lit(False)
    for pattern in fixed.TEST_RUNS:
        test = test | F.coalesce(F.col("case_name").ilike(pattern), F.lit(False))
    return runs.where(~test)


def append(runs: DataFrame, path: str) -> None:
    """Adds runs to a history folder; columns may be new."""
    runs.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A history folder, with all columns that any run has."""
    return migrated(spark.read.option("mergeSchema", "true").parquet(path))


def peer_stats(runs: DataFrame, least: int = 2) -> DataFrame:
    """Runs that have metrics, by submission type: their number, means to one decimal and share that passed parking, of two or more."""
    mean = lambda c, name: F.round(F.avg(c), 1).alias(name)
    rows = runs.where("critical_count is not null and coalesce(submission_type, '') <> ''")
    out = rows.groupBy("submission_type").agg(
        F.count(F.lit(1)).alias("n"), mean("bonus_pct", "avg_bonus_pct"), mean("critical_count", "avg_critical"), mean("high_count", "avg_high"), mean("warn_count", "avg_warn"), mean("pii_high_count", "avg_pii_high"),
        F.round(F.avg("parking_pass"), 2).alias("parking_pass_rate"),
    )
    return out.where(F.col("n") >= least)


def finding_diff(current: DataFrame, previous: DataFrame, by: list[str]) -> DataFrame:
    """Findings that are new or have another status than before: improved, regressed or changed.

    current, previous: by, seq, rule_id, status (and what else current has). Of a rule's repeated findings before, the last
    counts; what is gone isn't told. Rows of `by` without any finding before give nothing.
    """
    last = previous.groupBy(*by, "rule_id").agg(F.max_by("status", "seq").alias("prev_status"))
    known = previous.select(*by).distinct()
    rows = current.join(known, by, "left_semi").join(last, [*by, "rule_id"], "left")
    p, c = F.col("prev_status"), F.col("status")
    bad = lambda x: x.isin("fail", "warn")
    change = F.when(p.isNull(), "new").when(bad(p) & (c == "pass"), "improved").when((p == "pass") & bad(c), "regressed").otherwise("changed")
    return rows.where(p.isNull() | (p != c)).withColumn("change", change)


def newest_cases(cases: DataFrame, most: int = 50) -> DataFrame:
    """The cases uploaded last (a report's limit)."""
    return cases.orderBy(F.desc("uploaded_at"), "meta_id").limit(most)


def display_name(filename: Column) -> Column:
    """A file's name without the eight-digit prefix of its upload, blanks for underscores."""
    return F.replace(F.regexp_replace(filename, "^[a-f0-9]{8}_", ""), F.lit("_"), F.lit(" "))


def reg_year(label: Column) -> Column:
    """The year in a version's label; 111 without one."""
    return F.coalesce(F.trim(F.replace(label, F.lit("年版"), F.lit(""))), F.lit("111"))
