"""Global row numbers without a single-task window: rows are range-partitioned and sorted, counted
per partition, and each partition's first number is the count of all rows before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL = (1 << 33) - 1      # monotonically_increasing_id: partition in the upper bits, row in the lower 33


def numbered(df: DataFrame, *order: Column | str, name: str = "position", total: str | None = None,
             keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``df`` with ``name``, the 0-based place of each row in the order of ``order`` over the whole frame, and with the
    number of all rows as ``total`` if it is named. ``keep`` stores the rows in their order.

    The order should be total where the numbers must not hang on the input's order. Only the counts per
    partition (one row for each task) pass through one window; a key that holds many rows is split as
    far as the further order columns tell its rows apart."""
    at = F.monotonically_increasing_id()
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__num_id", at)
    own = keep(own.select("*", F.shiftright("__num_id", 33).alias("__num_part")))
    count = own.groupBy("__num_part").agg(F.count("*").alias("__num_n"))
    before = Window.orderBy("__num_part").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("__num_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = [F.sum("__num_n").over(all_).alias(total)] if total else []
    count = count.select("__num_part", F.coalesce(F.sum("__num_n").over(before), F.lit(0)).alias("__num_base"), *more)
    return (own.join(F.broadcast(count), "__num_part")
               .withColumn(name, F.col("__num_base") + F.col("__num_id").bitwiseAND(F.lit(_LOCAL)))
               .drop("__num_part", "__num_id", "__num_base"))
