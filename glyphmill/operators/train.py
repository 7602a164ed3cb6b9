"""Training a dictionary of parts from frequencies.

The driver loops over passes; each pass is one plan over the distinct words that still have a free range: ranges are
exploded into prefixes, inner windows and suffixes of all lengths at once, summed by (kind, length, value), ranked in
their 18 bins, cut adaptively and added.  Bins of one pass cannot influence each other, as their parts differ in kind or
length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytestr import DELIMITER, END, MID, START, WHOLE
from ..session import stored
from . import decompose, dictionary, frequency
from .dictionary import CONNECTORS, LONGEST, SHORTEST, Part

ORDER = {START: 0, MID: 1, END: 2}  # fixed values: the order of adding within a length


@dataclass
class Trained:
    """The parts in order of their ids, and the passes it took."""

    parts: list[Part]
    passes: int


def _bins(runs: DataFrame) -> DataFrame:
    """Rows (kind, len, value, freq) of all pieces of the free ranges."""
    n = F.length("piece")
    lengths = F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda size: size <= n)

    def pieces(size: Column) -> Column:
        one = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), size.alias("len"), F.substring(F.col("piece"), pos + 1, size).alias("value"))
        inner = F.transform(F.sequence(F.lit(0), n - size), lambda pos: one(MID, pos))
        nothing = F.filter(inner, lambda _: F.lit(False))
        head = F.when(F.col("touches_start"), F.array(one(START, F.lit(0)))).otherwise(nothing)
        tail = F.when(F.col("touches_end"), F.array(one(END, n - size))).otherwise(nothing)
        return F.concat(head, inner, tail)

    each = runs.where(n >= SHORTEST).select("freq", F.explode(F.flatten(F.transform(lengths, pieces))).alias("p"))
    return each.groupBy("p.kind", "p.len", "p.value").agg(F.sum("freq").alias("freq"))


def peel(words: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: the words (word, freq) that had a free range of two or more, and the new parts in order."""
    runs = decompose.free_runs(words, parts).where(F.col("end") - F.col("start") >= SHORTEST)
    runs = words.join(runs, "word").withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("end") - F.col("start")))
    runs = stored(runs.select("word", "freq", "piece", "touches_start", "touches_end"), "runs")
    kept = frequency.pruned(stored(_bins(runs), "bins"), ["kind", "len"])
    new = kept.join(parts.select("kind", "value"), ["kind", "value"], "left_anti")
    turn = F.when(F.col("kind") == START, 0).when(F.col("kind") == MID, 1).otherwise(2)
    return runs.select("word", "freq").distinct(), new.orderBy(F.desc("len"), turn, F.desc("freq"), "value").select("kind", "value")


def _listed(rows: DataFrame, most: int) -> list[Part]:
    """The (kind, value) rows in their order, on the driver; raises if there are more than that, and cuts nothing."""
    got = rows.limit(max(0, most) + 1).collect()
    if len(got) > max(0, most):
        raise ValueError("the dictionary has more parts than most_parts allows")
    return [(r["kind"], r["value"]) for r in got]


def train(word_freq: DataFrame, delimiter_freq: DataFrame, longest_whole: int = 16, letters: bool = True, most_passes: int = 20, most_parts: int = 1_000_000) -> Trained:
    """A dictionary from (value, freq) rows of words and of delimiters.

    Frequent whole words come first, then the atoms, the delimiters by frequency, and the parts each pass adds. The
    dictionary lives on the driver and may hold at most most_parts parts, else ValueError is raised; words stay
    distributed. Empty input gives
    the atoms and connectors alone.
    """
    spark = word_freq.sparkSession
    words = stored(word_freq.where("value <> ''").select(F.col("value").alias("word"), F.col("freq").cast("long")), "words")
    some = words.where(F.length("word").between(2, longest_whole)).select(F.lit(WHOLE).alias("kind"), F.col("word").alias("value"), "freq")
    wholes = frequency.pruned(some, ["kind"]).orderBy(F.desc("freq"), "value")
    wholes = _listed(wholes.select(F.lit(WHOLE).alias("kind"), "value"), most_parts)
    seed: list[Part] = wholes
    by_freq = delimiter_freq.where("value <> ''").orderBy(F.desc("freq"), "value")
    marks = _listed(by_freq.select(F.lit(DELIMITER).alias("kind"), "value"), most_parts - len(seed))
    atoms = [p for p in dictionary.atoms() if p[0] != DELIMITER] if letters else []
    parts = list(dict.fromkeys([*seed, *atoms, *marks, *((DELIMITER, c) for c in CONNECTORS)]))
    passes = 0
    left = words.join(spark.createDataFrame([(v,) for _, v in seed], "word string"), "word", "left_anti")
    while passes < most_passes:
        left, new = peel(left, dictionary.frame(spark, parts))
        if left.isEmpty():
            break
        passes += 1
        added = _listed(new, most_parts - len(parts))
        if not added:
            break
        parts += added
    return Trained(parts, passes)
