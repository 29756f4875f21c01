"""The run history in place: ids, the newest run's metrics, test runs, and writers that fail."""

import pytest
from pyspark.sql import functions as F

from dossia.operators import history
from dossia.sources import run_store as store

RUN = "case_name string, submission_type string, note string"


def metrics(spark, rows):
    return spark.createDataFrame([(c, "B-1", 2.5, n, 1, 1, 1, 0) for c, n in rows], "case_name string, submission_type string, bonus_pct double, critical_count int, high_count int, warn_count int, parking_pass int, pii_high_count int")


def test_run_store(spark, tmp_path):
    path = str(tmp_path / "history")
    assert store.read(spark, path).count() == 0
    store.update(metrics(spark, [("a", 1)]), path)
    store.clear_tests(spark, path)
    assert store.read(spark, path).count() == 0
    # ids over several tasks are distinct and follow each other
    store.save(spark.range(50).repartition(5).select(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("case_name")), path)
    assert sorted(r.id for r in store.read(spark, path).collect()) == list(range(1, 51))
    # later runs get larger ids, and may bring columns; given ids stay
    store.save(spark.createDataFrame([("c1", "A-1", "new"), (None, "C", None)], RUN), path)
    store.save(spark.createDataFrame([(500, "e2e_test 1"), (501, "x")], "id long, case_name string"), path)
    rows = {r.id: r for r in store.read(spark, path).collect()}
    assert set(rows) == {*range(1, 53), 500, 501} and {rows[51].case_name, rows[52].case_name} == {"c1", None} and {rows[51].note, rows[52].note} == {"new", None}
    # the newest run of a case alone is changed
    store.update(metrics(spark, [("c1", 9), ("nobody", 8)]), path)
    changed = [r for r in store.read(spark, path).collect() if r.critical_count is not None]
    assert [(r.case_name, r.critical_count, r.submission_type, r.note) for r in changed] == [("c1", 9, "B-1", "new")] and changed[0].id in (51, 52)
    store.clear_tests(spark, path)
    left = [r.id for r in store.read(spark, path).collect()]
    assert sorted(left) == [*range(1, 53), 501]
    store.save(spark.createDataFrame([("y",)], "case_name string"), path)
    assert max(r.id for r in store.read(spark, path).collect()) == 502


def test_a_folder_is_emptied(spark, tmp_path):
    path = str(tmp_path / "history")
    store.save(spark.createDataFrame([("api_test",), ("API_TEST",)], "case_name string"), path)
    store.clear_tests(spark, path)
    assert store.read(spark, path).count() == 0 and store.newest_id(spark, path) == 0


def test_a_failed_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    store.save(spark.createDataFrame([(f"c{k}",) for k in range(20)], "case_name string"), path)
    before = sorted(map(tuple, store.read(spark, path).collect()), key=str)
    rows = store.stored(spark, path)
    broken = rows.withColumn("audit_time", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("t")))
    with pytest.raises(Exception, match="no"):
        store.replaced(broken, list(range(store.BUCKETS)), path)
    assert sorted(map(tuple, store.read(spark, path).collect()), key=str) == before
    failing = spark.range(10).repartition(3).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise(F.lit("c")).alias("case_name"))
    with pytest.raises(Exception, match="no"):
        store.save(failing, path)
    assert sorted(map(tuple, store.read(spark, path).collect()), key=str) == before
    assert set(history.METRICS) <= set(store.read(spark, path).columns)
