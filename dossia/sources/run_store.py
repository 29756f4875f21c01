"""The run history as a folder that is appended to and changed in place: ids for new runs, metrics for the newest run of a case, test runs cleared.

Runs lie in BUCKETS folders by a hash of their case, so a change reads and replaces the folders of its cases alone. New folders are
staged and take the old ones' place when the whole job has succeeded (dynamic partition overwrite): a writer that fails leaves what was
there. One writer at a time; readers may be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.operators import history
from dossia.sources.shared import kept
from dossia.sources.tables import RUNS

BUCKETS = 16
BUCKET = "bucket"


def bucket_of(case_name: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(case_name, F.lit(""))), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the folder, place holders too; None where nothing is stored yet."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return history.migrated(rows, f"{RUNS}, {BUCKET} int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The runs, with all columns that any run has."""
    rows = stored(spark, path)
    return spark.createDataFrame([], RUNS) if rows is None else rows.where("id is not null").drop(BUCKET)


def newest_id(spark: SparkSession, path: str) -> int:
    rows = stored(spark, path)
    return 0 if rows is None else rows.agg(F.max("id")).first()[0] or 0


def numbered(runs: DataFrame, above: int) -> DataFrame:
    """Rows without an id get the next ones over `above` and over the ids that the rows bring, without a sort or a shuffle of rows.

    A row's number in its task comes with it; where a task's numbers begin is the number of rows in the tasks before, of which there
    are as many as tasks. The rows are kept as a table first, so that a task that runs again finds the same rows.
    """
    if "id" not in runs.columns:
        runs = runs.withColumn("id", F.lit(None).cast("long"))
    runs = kept(runs, "runs")
    new = runs.where("id is null").withColumn("task_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in new.groupBy("task_").agg(F.max("row_") + 1).collect())
    at, begins = max(above, runs.agg(F.max("id")).first()[0] or 0), []
    for task, n in counts:
        begins += [F.lit(task), F.lit(at)]
        at += n
    if not counts:
        return runs
    start = F.element_at(F.create_map(*begins), F.col("task_"))
    given = new.withColumn("id", start + F.col("row_") + 1).select(*runs.columns)
    return given.unionByName(runs.where("id is not null"))


def save(runs: DataFrame, path: str) -> None:
    """Adds runs; those without an id get new ones, larger than all before. Columns may be new."""
    spark = runs.sparkSession
    out = numbered(runs, newest_id(spark, path)).withColumn(BUCKET, bucket_of(F.col("case_name")))
    out.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def replaced(rows: DataFrame, touched: list[int], path: str) -> None:
    """Writes the folders `touched` anew; a row without an id holds the place of a folder that has none left."""
    holders = rows.sparkSession.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
    out = rows.unionByName(holders, allowMissingColumns=True)
    out.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def update(new: DataFrame, path: str) -> None:
    """The newest run of each case in `new` (case_name and history.METRICS) gets these metrics."""
    spark = new.sparkSession
    rows = stored(spark, path)
    touched = [r[0] for r in new.select(bucket_of(F.col("case_name"))).distinct().collect()]  # BUCKETS at most
    if rows is not None and touched:
        replaced(history.with_metrics(rows.where(F.col(BUCKET).isin(touched)).where("id is not null"), new), touched, path)


def clear_tests(spark: SparkSession, path: str) -> None:
    """Test runs go; folders without any stay as they are."""
    rows = stored(spark, path)
    if rows is None:
        return
    runs = rows.where("id is not null")
    tests = runs.join(history.without_tests(runs).select("id"), "id", "left_anti")
    touched = [r[0] for r in tests.select(BUCKET).distinct().collect()]
    if touched:
        replaced(history.without_tests(runs.where(F.col(BUCKET).isin(touched))), touched, path)
