"""Text files as numbered lines. Spark's codecs open gzip and bzip2; a byte-order mark at a file's start goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (an ordered position: block, place) and line. Large files split; positions still order their lines."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("at"), F.col("value").alias("line"))
    return raw.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and line, for files of which each fits a row, as grammars and lists do."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def clean(lines: DataFrame) -> DataFrame:
    """lines trimmed, without blank ones and comments (#); numbers stay."""
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\n\r\f"))).where((F.col("line") != "") & ~F.col("line").startswith("#"))
