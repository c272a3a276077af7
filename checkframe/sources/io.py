"""Readers and writers around a validation run; formats are Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.engine import ERRORS, Result


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def write_split(result: Result, valid_path: str, failures_path: str, *keys: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Valid rows to one place, and failures with their keys to another."""
    result.valid.write.format(fmt).mode(mode).save(valid_path)
    result.failures(*keys).write.format(fmt).mode(mode).save(failures_path)


def write_annotated(result: Result, path: str, mode: str = "error") -> None:
    """All rows once, split by a partition column that says whether they passed."""
    result.annotated.withColumn("passed", F.size(ERRORS) == 0).write.partitionBy("passed").mode(mode).parquet(path)
