"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.session import materialise

#: Rows of a group from which it is numbered over several tasks.
HOT_ROWS = 1_000_000


def numbered(rows: DataFrame, group: Column, order: Sequence[Column], name: str, hot_rows: int | None = None) -> DataFrame:
    """`rows` with their number from 1 within `group` (null is a group) by `order`, which should tell all rows apart.

    Groups of over `hot_rows` rows (at most rows / hot_rows of them, so their list is broadcast) are range-sorted over as
    many tasks as they fill; the rows a task holds of a group are counted, and prefix sums make their local numbers exact.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    keyed = rows.withColumn("_g", F.struct(group.alias("v")))  # a struct is never null
    large = materialise(keyed.groupBy("_g").count().where(F.col("count") > hot_rows).select("_g"), "large")
    within = Window.partitionBy("_g").orderBy(*order)
    if not large.limit(1).count():
        return keyed.withColumn(name, F.row_number().over(within)).drop("_g")
    few = F.broadcast(large)
    small = keyed.join(few, "_g", "left_anti").withColumn(name, F.row_number().over(within))
    spread = keyed.join(few, "_g").repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    # Ids grow with the place of a row in its partition; once written they stay.
    placed = materialise(spread.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "placed")
    parts = placed.groupBy("_g", "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_g", "_p", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    big = placed.join(F.broadcast(parts), ["_g", "_p"]).withColumn(name, (F.col("_i") + F.col("_shift")).cast("int"))  # a row per task and group
    return small.drop("_g").unionByName(big.select(*small.drop("_g").columns))
