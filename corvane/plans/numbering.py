"""Numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.plans.lineage import cut


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Adds the place of each row, from 1, in the given order, which must be total.

    Rows are range-partitioned and numbered within their partition; the partitions' counts, one row each, tell where
    every partition begins. The ranges are written once, so that both steps see the same ones."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(starts, "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")
