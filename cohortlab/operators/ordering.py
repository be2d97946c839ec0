"""A total order with positions, without a task that holds all rows.

``orderBy`` into one file, or a ``row_number`` over everything, puts all rows into one task.
Here rows are range-partitioned by the order, sorted within their range and written; a row's
position is its place in its range plus the sizes of the ranges before, of which there are as
many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PLACE = (1 << 33) - 1  # monotonically_increasing_id: partition number above, place in it below


def with_position(df: DataFrame, order: list[str], position: str = "position") -> DataFrame:
    """``df`` plus its rows' 1-based ``position`` by ``order`` (ascending, NULLs first), then by
    its other columns; equal rows follow one another in any order."""
    total = [F.col(c).asc_nulls_first() for c in [*order, *[c for c in df.columns if c not in order]]]
    ranged = df.repartitionByRange(*total).sortWithinPartitions(*total)
    rows = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")) \
        .select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    sizes = F.broadcast(sizes)  # a row for each range
    return rows.join(sizes, "_range").withColumn(position, F.col("_before") + F.col("_id").bitwiseAND(_PLACE) + 1) \
        .drop("_id", "_range", "_before")
