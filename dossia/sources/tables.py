"""Inputs and outputs: page text, run history and rule configurations as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

RUNS = "id long, case_name string, audit_time string, rule_ver string, findings string, submission_type string, bonus_pct double, critical_count int, high_count int, warn_count int, parking_pass int, pii_high_count int"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds runs to the history, a folder for each rule version."""
    runs.write.mode("append").partitionBy("rule_ver").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def read_playbook(spark: SparkSession, path: str) -> list[dict]:
    """Rule specifications of a JSON file (a list, or an object with `rules`)."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = json.loads(text)
    return found["rules"] if isinstance(found, dict) else found
