"""Places of rows and running sums in a global order, with no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm.common import broadcast_below, stored


def ordered(df: DataFrame, group: str, order: list, value: str | None = None) -> DataFrame:
    """The rows of a stored table with `before`: how many rows of their group (a column without nulls) stand before them in
    this order, or what the column value sums up to in these.

    Rows are dealt by ranges of group and order, so that a group of any size is spread over tasks; the ranges, sorted,
    are written once. Each range's total for a group then gives where the next range starts: a table of a row for each range
    and group that meet, ranges plus groups at most. Rows that are equal in order follow as they are stored.
    """
    tie = F.monotonically_increasing_id()
    keys = [F.col(group), *order, F.col("_tie")]
    ranges = df.withColumn("_tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    rows = stored(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    amount = F.sum(value) if value else F.count("*")
    totals = rows.groupBy(group, "_part").agg(amount.alias("_total"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(totals.select(F.col(group).alias("_group"), F.col("_part").alias("_range"), "_first", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start")))
    out = rows.join(broadcast_below(starts), (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_range")))
    if value:
        own = Window.partitionBy("_part", group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("_start") + F.coalesce(F.sum(value).over(own), F.lit(0))
    else:
        before = F.col("_start") + F.col("_row") - F.col("_first")
    return out.select(*df.columns, before.alias("before"))
