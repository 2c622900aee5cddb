"""Texts from files: one row for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """path and text of every file under ``path``, without a byte order mark; the reader is Spark's, so any of its stores will do."""
    if encoding.upper() == "UTF-8":
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    else:
        rows = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("text"))
    return rows.withColumn("text", F.regexp_replace("text", "^﻿", ""))
