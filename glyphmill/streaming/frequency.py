"""Frequencies of a stream of texts: the state is one count for each value, and the trainer takes it as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokenize import tokenize


def token_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A streaming (type, value, freq) table; use it with output mode complete or update."""
    return tokenize(texts, key, text).where("value <> ''").groupBy("type", "value").agg(F.count(F.lit(1)).alias("freq"))


def start(texts: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Counts what has arrived and finishes with all input seen. Each batch writes the counts so far as a table of its
    own under folder/counts, over one that a lost attempt may have left; folder/state holds the checkpoint."""

    def write(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")

    stream = token_counts(texts, key, text).writeStream.outputMode("complete").foreachBatch(write)
    return stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The counts (type, value, freq) of the latest batch."""
    batches = spark.read.parquet(f"{folder}/counts")
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).scalar()).drop("batch")
