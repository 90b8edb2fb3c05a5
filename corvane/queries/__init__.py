"""Queries of the core operators, keyed by the identifiers of the operator inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.queries import decisions, graphs, ingest, measures, search, stored
from corvane.queries.registry import QUERIES, SQL

MODULES = (search, graphs, decisions, ingest, stored, measures)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings as questions, BM25 over the documents, the best hits of each question as one context."""
    return QUERIES["R29_format_context"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
