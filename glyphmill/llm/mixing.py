"""A mix of sources at target weights.

Sizes are tokens of a public tokenizer.  Every document gets a hash-random key; ranges of keys are sorted within each
source, their sums give the prefix sum of tokens before every document, and each source is cut where its budget is
reached.  A source smaller than its budget is repeated, up to its cap: whole epochs first, then the cut.

No source is gathered in one place: a source's keys fall into ranges of about the same number of documents, only the
sums of the ranges are put in order together, and the running sum inside a range is made in the range's own task.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(ranks: str = RANKS):
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_count(text: Column, ranks: str = RANKS) -> Column:
    """Tokens of a text; null for null."""

    @F.arrow_udf("long")
    def count(a: pa.Array) -> pa.Array:
        enc = encoding(ranks)
        return pa.array([None if t is None else len(enc.encode_ordinary(t)) for t in a.to_pylist()], pa.int64())

    return count(text)


def source_name(source: Column) -> Column:
    """A source's name without case and outer spaces."""
    return F.lower(F.trim(source))


def budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens each source is to give.

    sizes: tokens a source has; targets: its share and the most often a document may appear. Shares count among the
    sources that have tokens. Without a total, the mix is the largest in which every source reaches its share. With
    one, sources that cannot give their share give all they may, and the rest is split among the others by share.
    """
    able = {s: sizes.get(s, 0) * r for s, (w, r) in targets.items() if sizes.get(s, 0) > 0 and w and w > 0 and r and r > 0}
    share = {s: targets[s][0] for s in able}
    if not able:
        return {}
    if total is None:
        scale = sum(share.values())
        total = min(able[s] * scale / share[s] for s in able)
    left, open_, out = float(total), set(able), {}
    while open_:
        scale = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / scale >= able[s]}
        if not full:
            out |= {s: left * share[s] / scale for s in open_}
            break
        for s in full:
            out[s] = float(able[s])
        left -= sum(able[s] for s in full)
        open_ -= full
    return out


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 1, ranks: str = RANKS, per_range: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The mix, and its report.

    The mix has a row (key, source, tokens, repeats) for each document that appears, repeats times. The report has a
    row for each target: source, target_share, max_repeats, documents and tokens at hand, tokens given, share reached.
    Source names are compared without case and outer spaces. Documents with a null text, key or source, an empty text,
    or a source without target are left out; targets without documents reach 0. Of repeated rows with one key each
    counts as a document. targets is a table with one row for each source (a small stated set, read by the driver).
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), source_name(F.col(source)).alias("s"), F.col(text).alias("t"))
    rows = rows.where("s is not null and t is not null and t <> ''").select("k", "s", token_count(F.col("t"), ranks).alias("n"))
    rows = rows.withColumn("h", F.xxhash64("k", F.lit(seed)))
    sized = stored(rows, "sizes")
    have = {r["s"]: (r["d"], r["n"]) for r in sized.groupBy("s").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).join(targets.select(source_name(F.col("source")).alias("s")), "s", "left_semi").collect()}
    want = {r["s"]: (float(r["w"] or 0), int(r["r"] or 0)) for r in targets.where("source is not null").select(source_name(F.col("source")).alias("s"), F.col("target_share").alias("w"), F.col("max_repeats").alias("r")).collect()}
    give = budgets({s: n for s, (_, n) in have.items()}, want, total)
    spark = docs.sparkSession
    plan = [(s, have[s][1], g, max(0, math.ceil(math.log2(max(1, have[s][0] / per_range)))), want[s][1]) for s, g in give.items()]
    table = spark.createDataFrame(plan, "s string, size long, budget double, bits int, cap int")
    # rows of one range of keys; the keys are random, so ranges hold about as many documents each
    ranged = sized.join(F.broadcast(table), "s").withColumn("range", F.expr("shiftright(shiftrightunsigned(h, 1), 63 - bits)"))
    sums = ranged.groupBy("s", "range").agg(F.sum("n").alias("m"))
    before = sums.select("s", "range", (F.sum("m").over(Window.partitionBy("s").orderBy("range")) - F.col("m")).alias("before"))
    inside = Window.partitionBy("s", "range").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(before, ["s", "range"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    epochs = F.floor(F.col("budget") / F.col("size"))
    rest = F.col("budget") - epochs * F.col("size")
    last = (F.col("at") + F.col("n") / 2 <= rest).cast("long")
    out = placed.withColumn("repeats", F.least(epochs + last, F.col("cap").cast("long"))).where("repeats > 0")
    chosen = out.select(F.col("k").alias(key), F.col("s").alias("source"), F.col("n").alias("tokens"), "repeats")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("given"))
    goal = spark.createDataFrame([(s, w, r, *have.get(s, (0, 0))) for s, (w, r) in want.items()], "source string, target_share double, max_repeats int, documents long, tokens long")
    report = goal.join(reached, "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    everything = F.sum("given").over(Window.partitionBy())
    return chosen, report.withColumn("share", F.when(everything > 0, F.col("given") / everything).otherwise(0.0))
