"""Half-open ranges in two columns: start, end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(start: Column, end: Column | None = None) -> Column:
    """A range as a struct; a missing end or one of 0 is the start."""
    end = F.lit(None).cast("int") if end is None else end
    return F.struct(start.alias("start"), F.coalesce(F.nullif(end, F.lit(0)), start).alias("end"))


def clamp(start: Column, end: Column) -> Column:
    """A segment's range: a null or negative start is 0, a null, zero or negative end is the start."""
    s = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    return F.struct(s.alias("start"), F.when(end > 0, end).otherwise(s).alias("end"))


def overlap(a: Column, b: Column) -> Column:
    """The part two ranges share, null if they only touch or less."""
    s, e = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    return F.when(s < e, F.struct(s.alias("start"), e.alias("end")))


def overlaps(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def contains(big: Column, small: Column) -> Column:
    return (big["start"] <= small["start"]) & (big["end"] >= small["end"])


def span(a: Column) -> Column:
    return a["end"] - a["start"]


def extract(text: Column, a: Column) -> Column:
    """The text of a range."""
    return F.substring(text, a["start"] + 1, span(a))


def to_json(a: Column) -> Column:
    return F.to_json(F.array(a["start"], a["end"]))


def to_string(a: Column, name: str = "Segment") -> Column:
    return F.format_string(f"{name} [%d, %d]", a["start"], a["end"])


def title(text: Column, a: Column, offset: Column) -> Column:
    """A header's title: its text past the offset, without the # and blanks around it."""
    inner = F.least(F.greatest(F.coalesce(offset, F.lit(0)), F.lit(0)), span(a))
    return F.regexp_replace(F.substring(text, a["start"] + inner + 1, span(a) - inner), r"^\s*#*\s*|\s*#*\s*$", "")


def overlapping(left: DataFrame, right: DataFrame, by: str, width: int = 256) -> DataFrame:
    """Pairs of ranges that share a place in the same document: (by, a_start, a_end, b_start, b_end).

    Both sides have the columns by, start, end. Ranges are put into bins of the given width, pairs meet in the first
    bin both reach, so one document with very many ranges spreads over its bins and no pair is made twice. Ranges
    that are null, empty or reversed overlap nothing.
    """

    def binned(df: DataFrame, p: str) -> DataFrame:
        ok = df.where("start < `end`").select(by, F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
        first, last = F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_end") - 1) / width)
        return ok.withColumn("__bin", F.explode(F.sequence(first, last)))

    both = binned(left, "a").join(binned(right, "b"), [by, "__bin"])
    s = F.greatest("a_start", "b_start")
    return both.where((s < F.least("a_end", "b_end")) & (F.col("__bin") == F.floor(s / width))).drop("__bin")
