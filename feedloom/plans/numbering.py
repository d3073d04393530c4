"""Numbers along a global order without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.plans.lineage import checkpointed


def numbered_along(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``rows`` with ``name``, 1.. in ``order`` (which must leave no ties).

    Rows are kept first, as ranges are found by looking at them; then they are
    dealt to the ranges of the order and kept so.  Each range is numbered by
    itself and moved by the rows of the ranges before it, of which there are as
    many as partitions.  Null comes first in the order.
    """
    keyed = checkpointed(rows.withColumn("_key", F.struct(*order)))
    ranged = checkpointed(keyed.repartitionByRange("_key").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_key")
    placed = ranged.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(offsets), "_range")
    return placed.withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_key", "_range", "_before", "_at")


def numbered_within(rows: DataFrame, group: list[Column], order: list[Column], name: str = "n") -> DataFrame:
    """``rows`` with ``name``, 1.. in ``order`` within each ``group``, however large one is: along all groups, less the rows before the group."""
    along = numbered_along(rows.withColumn("_group", F.struct(*group)), [F.col("_group"), *order], "_along")
    begins = along.groupBy("_group").agg(F.min("_along").alias("_begin"))
    return along.join(begins.withColumnRenamed("_group", "_of"), F.col("_group").eqNullSafe(F.col("_of"))).drop("_of").withColumn(name, (F.col("_along") - F.col("_begin") + 1).cast("int")).drop("_group", "_along", "_begin")


def content_digest(rows: DataFrame, order: list[Column], line: Column, fan: int = 1024) -> DataFrame:
    """``rows`` and ``digest``: one hash of all lines in ``order`` (no ties), however the rows lie in partitions.

    Each line is hashed, every ``fan`` hashes along the order are hashed
    together, and so on, so no task holds more than ``fan`` of them.  No rows
    have the hash of nothing.
    """
    level = numbered_along(rows.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.sha2(line, 256).alias("h")), [F.col(f"_o{i}") for i in range(len(order))]).select("n", "h")
    level = checkpointed(level)
    n = many = level.count()
    while many > 1 or (many and level.columns != ["n", "h", "over"]):
        inside = F.array_sort(F.collect_list(F.struct("n", "h")))
        above = level.groupBy(F.floor((F.col("n") - 1) / fan).alias("at")).agg(F.sha2(F.array_join(F.transform(inside, lambda x: x["h"]), ""), 256).alias("h"))
        level = checkpointed(above.select((F.col("at") + 1).cast("bigint").alias("n"), "h", F.lit(True).alias("over")))
        many = level.count()
    if not n:
        return rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("rows"), F.sha2(F.lit(""), 256).alias("digest"))
    return level.select(F.lit(n).cast("bigint").alias("rows"), F.col("h").alias("digest"))
