"""Cutting lineage in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def freeing(spark: SparkSession) -> None:
    """From now on the session's shuffle files go when the execution that wrote them ends: what is read again is kept."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of checkpoints."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder as compressed columns, of which later reads take what they need."""
    path = f"{shared_folder(df.sparkSession)}/feedloom/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._kept_at = path
    return read


def dropped(*tables: DataFrame) -> None:
    """Delete what was kept for these very frames: whatever was made from them is kept itself by now."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_kept_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode (tests) and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")
