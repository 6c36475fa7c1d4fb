"""Gapless ranks over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, bucket: Column, order: list[str | Column], name: str) -> DataFrame:
    """Adds the 1-based rank in the order (bucket, order). ``bucket`` must rise with the order, such as id // 1000.

    Rows are numbered inside their bucket; the buckets' sizes, one row each, give the shift.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.withColumn("_row", row).join(sizes, "_bucket").withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_before")
