"""Marks of finished stages: empty files in a folder per run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from narrata.sinks.keyed import file_system


def finished(spark: SparkSession, path: str, run_id: str) -> set[str]:
    fs, folder = file_system(spark, f"{path}/runs/run={run_id}")
    return {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()


def finish(spark: SparkSession, path: str, run_id: str, stage: str) -> None:
    """Called after everything the stage writes has been written."""
    fs, mark = file_system(spark, f"{path}/runs/run={run_id}/{stage}")
    fs.create(mark, True).close()
