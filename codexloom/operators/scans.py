"""Running values over sequences of any length: within ranges first, then carried from range to range.

A sequence (a book's blocks, say) is cut into ranges. Windows run inside a range; per range one summary row
remains, and a window over the summaries gives what comes before each range. So a sequence that holds a
third of all rows is spread over tasks, and what one task sees in order is a range, or one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.sources.store import stage


def before_ranges(summaries: DataFrame, keys: list[str], part: str, **values: Column) -> DataFrame:
    """(keys, part, values) per range: running aggregates over all ranges before it, null for the first."""
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return summaries.select(*keys, part, *[v.over(w).alias(name) for name, v in values.items()])


def since_reset(summaries: DataFrame, keys: list[str], part: str, reset: str, value: str) -> DataFrame:
    """(keys, part, value): the greatest ``value`` of the ranges before, back to the last one with a ``reset``, that one included.

    It is the running state of a segmented scan, whose merge is: a range with a reset forgets what came before.
    """
    order = Window.partitionBy(*keys).orderBy(part)
    s = summaries.withColumn("_g", F.sum(F.col(reset).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_m", F.max(value).over(Window.partitionBy(*keys, "_g").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)))
    return s.select(*keys, part, F.lag("_m").over(order).alias(value))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "no") -> DataFrame:
    """df with the row's number, from 0, within its keys. Sorted ranges of all rows are numbered apart; ``order`` should not tie."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stage(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = held.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    first = before_ranges(counts, keys, "_range", _before=F.sum("_n"))
    at = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return held.withColumn("_at", at).join(first, [*keys, "_range"]).withColumn(name, F.col("_at") + F.coalesce("_before", F.lit(0))).drop("_at", "_before", "_range")
