"""Cutting lineage between rounds of an iterative job, and tables that a call writes for itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. A local run that names none gets one on this machine; on a cluster that is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    return (own or "file:///tmp/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the reliable checkpoint folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for one call's tables, in the shared one."""
    return f"{shared_folder(spark)}/auralake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read again: as safe as `cut`, but read by columns, with filters pushed down, and of a known size,
    so that small ones are broadcast."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """True if a job has written this table to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores where it comes in too few parts (one small file) to use them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
