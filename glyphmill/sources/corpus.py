"""Corpora: whole files as bytes or as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, bytes): each file as a byte string."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("bytes"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, text): each file as UTF-8 text; what is no UTF-8 becomes U+FFFD."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
