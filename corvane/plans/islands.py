"""Runs of equal values in order, numbered within each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def islands(rows: DataFrame, key: str, order: list[Column], value: str, span: Column, name: str = "island") -> DataFrame:
    """Adds the number, from 1, of the run of equal ``value`` that a row is in, by ``order`` within ``key``.

    ``span`` must not decrease in the order. Rows are numbered within a key and span, so a key that a third of all
    rows share is many groups; the spans' own counts, first and last values are few rows and tell where each span
    begins to count. A null value is a run of its own.
    """
    spans = rows.withColumn("_span", span)
    w = Window.partitionBy(key, "_span").orderBy(*order)
    before = F.lag(value).over(w)
    local = spans.withColumn("_begins", F.when(before.isNull() | F.col(value).isNull() | (before != F.col(value)), 1).otherwise(0))
    local = local.withColumn("_local", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    sums = local.groupBy(key, "_span").agg(F.sum("_begins").alias("_n"), F.min(F.struct(place.alias("at"), F.col(value).alias("v"))).alias("_first"), F.max(F.struct(place.alias("at"), F.col(value).alias("v"))).alias("_last"))
    v = Window.partitionBy(key).orderBy("_span")
    sums = sums.withColumn("_joins", F.coalesce((F.lag(F.col("_last.v")).over(v) == F.col("_first.v")).cast("int"), F.lit(0)))
    sums = sums.withColumn("_offset", F.coalesce(F.sum(F.col("_n") - F.col("_joins")).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_joins"))
    met = local.join(sums.select(F.col(key).alias("_key"), F.col("_span").alias("_at"), "_offset"), F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_at")))
    return met.withColumn(name, F.col("_offset") + F.col("_local")).drop("_span", "_begins", "_local", "_offset", "_key", "_at")
