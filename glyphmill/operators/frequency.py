"""Frequencies of words and delimiters, and cuts of ranked values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import threshold
from .ordering import placed
from .tokenize import DELIMITER, WORD


def frequencies(tokens: DataFrame, kind: int) -> DataFrame:
    """Rows (value, freq) of one token type; empty values are not counted. Partial sums are made before the shuffle."""
    return tokens.where((F.col("type") == kind) & (F.col("value") != "")).groupBy("value").agg(F.count(F.lit(1)).alias("freq"))


def totals(tokens: DataFrame) -> DataFrame:
    """One row (words, distinct_words, delimiters, tokens)."""
    by_value = tokens.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n"))
    word = F.col("type") == WORD
    return by_value.agg(
        F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("words"), F.count(F.when(word & (F.col("value") != ""), 1)).alias("distinct_words"),
        F.coalesce(F.sum(F.when(F.col("type") == DELIMITER, F.col("n"))), F.lit(0)).alias("delimiters"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
    )


def ranked(freq: DataFrame, group: list[str], value: str = "value", weight: str = "freq") -> DataFrame:
    """The rows with their rank from 1 in their group, by weight descending, then value ascending.

    No group and no run of equal weights meets in one task.
    """
    got = placed(freq, group, [F.desc(weight), F.asc(value)], "rank")
    return got.withColumn("rank", F.col("rank") + 1)


def ranked_head(rows: DataFrame, group: list[str], value: str = "value", weight: str = "freq") -> DataFrame:
    """The rows that pruned() keeps, with their rank from 1. One range sort serves the ranks and the cut."""
    all_ = ranked(rows, group, value, weight)
    cut = threshold.grouped_cuts(all_, group, weight).select(*group, "k")
    return all_.join(cut, group).where(F.col("rank") <= F.col("k")).drop("k")


def pruned(rows: DataFrame, group: list[str], value: str = "value", weight: str = "freq") -> DataFrame:
    """The rows that the adaptive cut of their group keeps: the heaviest, of equal ones the least values.

    Whole runs of equal weights are kept or left by comparison; only a run that the cut divides is put in order, by all
    tasks together, as it can hold most of a vocabulary.
    """
    cut = threshold.grouped_cuts(rows, group, weight)
    met = rows.join(cut, group)
    w = F.col(weight).cast("double")
    whole = met.where((w > F.col("at")) | ((w == F.col("at")) & (F.col("need") == F.col("run"))))
    part = met.where((w == F.col("at")) & (F.col("need") < F.col("run")))
    part = placed(part, group, [F.asc(value)], "__r").where("__r < need").drop("__r")
    return whole.unionByName(part).drop("k", "at", "need", "run")
