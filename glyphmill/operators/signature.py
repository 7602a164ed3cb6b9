"""Sparse signatures of words: what stands left of them, their own parts, what stands right of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sparse
from .ordering import placed


def encode(words: DataFrame, scope: list[str], pos: str = "pos", bag: str = "bag", radius: int | None = None) -> DataFrame:
    """The rows with L, C, R: union of the bags before, the own bag, union of the bags after, within the scope.

    With a radius only so many words on either side count. Without one, each part's first and last place in the scope
    decide (it is on the left of every later word, on the right of every earlier one), so that no prefix is gathered
    twice. Null bags are empty; every row stays.
    """
    own = sparse.as_set(F.col(bag))
    w = Window.partitionBy(*scope).orderBy(pos)
    if radius is not None:
        if radius == 0:
            none = F.array().cast("array<int>")
            return words.select("*", none.alias("L"), own.alias("C"), none.alias("R"))
        side = lambda a, b: sparse.as_set(F.flatten(F.collect_list(own).over(w.rowsBetween(a, b))))
        return words.select("*", side(-radius, -1).alias("L"), own.alias("C"), side(1, radius).alias("R"))
    each = words.select(*scope, F.col(pos).alias("__p"), F.explode(own).alias("__id"))
    spans = each.groupBy(*scope, "__id").agg(F.min("__p").alias("lo"), F.max("__p").alias("hi"))
    whole = spans.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(F.col("__id").alias("id"), "lo", "hi"))).alias("__spans"))
    got = words.join(whole, scope, "left")
    left = F.transform(F.filter("__spans", lambda s: s["lo"] < F.col(pos)), lambda s: s["id"])
    right = F.transform(F.filter("__spans", lambda s: s["hi"] > F.col(pos)), lambda s: s["id"])
    none = F.array().cast("array<int>")
    return got.select(*words.columns, F.coalesce(left, none).alias("L"), own.alias("C"), F.coalesce(right, none).alias("R"))


def next_label(label: str, scope: list[str], pos: str = "pos") -> Column:
    """The label of the following word in the scope; null at its end."""
    return F.lead(label).over(Window.partitionBy(*scope).orderBy(pos))


def vocabulary(words: DataFrame, order: list[str], word: str = "value") -> DataFrame:
    """Rows (word_id, word): ids dense from 0 in the order in which words are first seen.

    Only the distinct words, each with its first place, are put in order, and all tasks share in that.
    """
    first = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.min(F.struct(*order)).alias("__o"))
    return placed(first, [], [F.asc("__o"), F.asc("word")]).select(F.col("place").cast("int").alias("word_id"), "word")


def band_union(left: Column, own: Column) -> Column:
    """One band of what has been seen so far."""
    return sparse.union(left, own)
