"""Cancelling the jobs of one request."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def job_group(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside belong to ``name`` and end with ``cancel``."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)
