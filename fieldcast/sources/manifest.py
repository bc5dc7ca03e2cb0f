"""Runs written as a whole or not at all, and seen once.

Every write of a run is an attempt with a folder of its own, so writers never
share a temporary folder.  When its files are complete, one small record
(run, attempt, time) is added to the commits, in a folder of its own too; a
single file appears there or doesn't.  Readers take, of each run, the newest
committed attempt: one that failed half way has no record, and one that was
repeated is read once.  Nothing is locked, changed or deleted.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMITS = "run_id string, attempt string, at long"


def data_folder(path: str, attempt: str) -> str:
    return f"{path}/data/attempt={attempt}"


def write_attempt(rows: DataFrame, path: str, partitions: list[str] | None = None) -> str:
    """Write the rows of an attempt and return its name; nobody sees them yet."""
    attempt = uuid.uuid4().hex
    rows.write.partitionBy(*(partitions or [])).parquet(data_folder(path, attempt))
    return attempt


def commit(spark: SparkSession, path: str, run_id: str, attempt: str) -> None:
    record = spark.createDataFrame([(run_id, attempt, time.time_ns())], COMMITS)
    record.coalesce(1).write.parquet(f"{path}/commits/{attempt}")


def write_run(rows: DataFrame, path: str, run_id: str, partitions: list[str] | None = None) -> None:
    commit(rows.sparkSession, path, run_id, write_attempt(rows, path, partitions))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt): the newest committed attempt of each run."""
    records = spark.read.schema(COMMITS).parquet(f"{path}/commits/*")
    return records.groupBy("run_id").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Rows of one run with ``run_id``; only the files of its attempt are listed."""
    found = committed(spark, path).where(F.col("run_id") == run_id).first()
    if found is None:
        raise ValueError(f"no run {run_id} was committed")
    return spark.read.parquet(data_folder(path, found.attempt)).withColumn("run_id", F.lit(run_id))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed runs with ``run_id``; other attempts aren't even listed."""
    runs = committed(spark, path)
    folders = [data_folder(path, r.attempt) for r in runs.collect()]  # one short row per run
    if not folders:
        raise ValueError("no run was committed")
    rows = spark.read.option("basePath", f"{path}/data").parquet(*folders)
    return rows.join(runs, "attempt").drop("attempt")
