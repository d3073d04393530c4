"""Stored posts on disk: partitions by day, of which only those that change are written again.

A store is a folder of parquet files under ``day=YYYY-MM-DD``, the day of
``fetched_at``.  What replaces a partition is computed and kept elsewhere first,
then takes its place by dynamic overwrite, so a run that dies leaves the old or
the new partition and a repeated one changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.plans.lineage import checkpointed

DAY = "day"


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """The store's rows with ``day``, or None where nothing was stored yet."""
    try:
        return spark.read.option("basePath", path).parquet(path).withColumn(DAY, F.col(DAY).cast("date"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _put(rows: DataFrame, path: str, mode: str) -> None:
    # A day's rows meet in as many files as their size asks for, not one a task.
    dealt = rows.hint("rebalance", DAY)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn(DAY, F.to_date("fetched_at"))


def add_items(rows: DataFrame, path: str, key: str = "id") -> int:
    """Insert what the store lacks, of rows that share a key the first by ``fetched_at``; how many were inserted.

    New files are added to the days of new rows; no file is written again.
    """
    spark, old = rows.sparkSession, opened(rows.sparkSession, path)
    first = Window.partitionBy(key).orderBy(F.col("fetched_at").asc_nulls_last(), F.xxhash64(*rows.columns))
    fresh = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if old is not None:
        fresh = fresh.join(old.select(key), key, "left_anti")
    fresh = checkpointed(_dated(fresh).select(*rows.columns, DAY))
    n = fresh.count()
    if n:
        _put(fresh, path, "append")
    spark.catalog.refreshByPath(path)
    return n


def replace_items(rows: DataFrame, path: str, key: str = "id") -> int:
    """Upsert: rows take the place of stored ones of their key, in whichever day; how many days were written again.

    Days that lose or gain a row are written again, others stay as they are.
    """
    spark, old = rows.sparkSession, opened(rows.sparkSession, path)
    last = Window.partitionBy(key).orderBy(F.col("fetched_at").desc_nulls_last(), F.xxhash64(*rows.columns))
    new = checkpointed(_dated(rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")).select(*rows.columns, DAY))
    if old is None:
        _put(new, path, "append")
        return new.select(DAY).distinct().count()
    gone = old.join(new.select(key), key, "left_semi").select(DAY)
    touched = checkpointed(new.select(DAY).union(gone).distinct())
    kept = old.join(F.broadcast(touched), old[DAY].eqNullSafe(touched[DAY]), "left_semi").join(new.select(key), key, "left_anti")
    return _rewrite(spark, path, kept.select(*rows.columns, DAY).unionByName(new), touched, old)


def _rewrite(spark: SparkSession, path: str, after: DataFrame, touched: DataFrame, old: DataFrame) -> int:
    after = checkpointed(after)
    empty = [r[0] for r in touched.join(after.select(DAY).distinct(), DAY, "left_anti").join(old.select(DAY).distinct(), DAY, "left_semi").collect()]  # days, not rows
    n = touched.count()
    if not after.isEmpty():
        _put(after, path, "overwrite")
    for day in empty:
        _drop(spark, f"{path}/{DAY}={day}")
    spark.catalog.refreshByPath(path)
    return n


def _drop(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, path: str, before: str) -> int:
    """Delete rows fetched before a time; how many days were dropped or written again.

    Whole days go with their folder, unread; only the day the time falls in is
    written again, if it holds such rows.  Rows without a time stay.
    """
    old = opened(spark, path)
    if old is None:
        return 0
    edge = F.lit(before).cast("timestamp_ntz")
    days = [r[0] for r in old.where(F.col(DAY) < F.to_date(edge)).select(DAY).distinct().collect()]
    for day in days:
        _drop(spark, f"{path}/{DAY}={day}")
    spark.catalog.refreshByPath(path)
    last = opened(spark, path) if days else old
    if last is None:
        return len(days)
    last = last.where(F.col(DAY) == F.to_date(edge))
    if last.where(F.col("fetched_at") < edge).isEmpty():
        return len(days)
    return len(days) + _rewrite(spark, path, last.where(F.col("fetched_at") >= edge), checkpointed(last.select(DAY).distinct()), last)


def compact(spark: SparkSession, path: str, most_files: int = 8) -> int:
    """Write days of more than ``most_files`` files again in fewer; how many there were."""
    old = opened(spark, path)
    if old is None:
        return 0
    files = old.select(DAY, F.input_file_name().alias("file")).distinct().groupBy(DAY).agg(F.count("*").alias("n"))
    many = checkpointed(files.where(F.col("n") > most_files).select(DAY))
    if many.isEmpty():
        return 0
    return _rewrite(spark, path, old.join(F.broadcast(many), old[DAY].eqNullSafe(many[DAY]), "left_semi"), many, old)


def since(spark: SparkSession, path: str, when: Column) -> DataFrame:
    """Rows fetched at a time or later; days before it aren't opened."""
    return opened(spark, path).where((F.col(DAY) >= F.to_date(when)) & (F.col("fetched_at") >= when))
