"""The polling loop as streams: exactly-once inserts, silence, daily counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.plans.lineage import shared_folder


def read_items(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def first_sightings(items: DataFrame, key: str, ts: str, horizon: str = "30 days") -> DataFrame:
    """Each key once; rows later than the horizon are never let in again."""
    return items.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def daily_counts(items: DataFrame, ts: str, *keys: str, lateness: str = "1 day") -> DataFrame:
    return items.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"))


def sessions(items: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Runs of posts without a silence of ``gap``: their number, first and last time."""
    runs = items.withWatermark(ts, gap).groupBy(F.session_window(ts, gap), key)
    return runs.agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def append_new(store: str, key: str = "id", order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds what the store lacks, of a batch's rows of one key the first along ``order``.

    A batch that is tried again adds nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = Window.partitionBy(key).orderBy(order or key)
        fresh = batch.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
        try:
            fresh = fresh.join(spark.read.parquet(store).select(key), key, "left_anti")
        except AnalysisException as e:  # the first batch finds no store
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("append").parquet(store)

    return write


def store_of(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def run_once(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run over what is there and stop; state and results stay in the shared folder, the results are read from there.

    With the ``folder`` of an earlier run it goes on where that one stopped.
    """
    spark, folder = df.sparkSession, folder or store_of(df.sparkSession)
    schema = df.schema

    def write(batch: DataFrame, epoch: int) -> None:
        # A complete result replaces the one before; appended ones are kept by epoch, so one that is tried again replaces itself.
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch if mode == 'append' else 0}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows/epoch=*")


def run_into(df: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    """Run a batch writer over what is there and stop."""
    state = f"{store_of(df.sparkSession)}/state"
    df.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def poll(df: DataFrame, write: Callable[[DataFrame, int], None], state: str, seconds: int = 900):
    """Run a batch writer over what comes, every so often, until stopped; offsets and what was done stay in ``state``."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(processingTime=f"{seconds} seconds").start()


def cursor(spark: SparkSession, store: str, key: str):
    """Where a consumer stands, or None: the value that was written last."""
    try:
        rows = spark.read.parquet(store).where(F.col("key") == key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.agg(F.max_by("value", "version")).first()[0]


def advance(spark: SparkSession, store: str, key: str, value: str) -> None:
    """Move a consumer's cursor, once its output is written: to the time its reading began, so nothing that came since is passed over."""
    spark.sql("select :key as key, :value as value, unix_micros(current_timestamp()) as version", args={"key": key, "value": value}).write.mode("append").parquet(store)
