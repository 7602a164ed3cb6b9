"""Items that appear together: exact pair counts by a blocked Gram matrix, and how far they are above chance.

Records are taken in blocks.  A block is two binary sparse matrices, records by left items and records by right items.
The first is transposed (its entries are put in the order of the items), and the product with the second is made for one
block of left items after another, each bounded by its work, and handed on at once; so neither a basket of very many
items nor an item in very many baskets is held expanded.  Spark adds up the blocks of a task before the shuffle, and of
all tasks after it.  Counts of single items come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

TILE = 1 << 21  # products made at a time
HELD = 1 << 20  # distinct pairs a task holds before it hands them on


def _sparse(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, and the distinct item numbers of each row; the items by number."""
    size = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
    value = col.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(col)), size)
    ids = np.asarray(value.indices.fill_null(-1)).astype(np.int64)
    ok = ids >= 0
    width = max(1, len(value.dictionary))
    key = np.unique(row[ok] * width + ids[ok])
    start = np.zeros(len(col) + 1, np.int64)
    np.cumsum(np.bincount(key // width, minlength=len(col)), out=start[1:])
    return start, key % width, value.dictionary


def gram(ls: np.ndarray, li: np.ndarray, rs: np.ndarray, ri: np.ndarray, right: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Non-zero cells of left' x right over the records, in blocks of whole left items: cell numbers (left item * right
    + right item), ascending, and counts."""
    by_item = np.argsort(li, kind="stable")  # left', an item a line
    item, record = li[by_item], np.repeat(np.arange(len(ls) - 1), np.diff(ls))[by_item]
    begin, width = rs[record], np.diff(rs)[record]
    ends = np.cumsum(width)
    lines = np.append(np.flatnonzero(np.diff(item)) + 1, len(item))  # where each item's line ends
    at = 0
    while at < len(item):
        base = ends[at - 1] if at else 0
        fit = int(np.searchsorted(ends, base + TILE, "right"))
        whole = np.searchsorted(lines, fit, "right")
        z = int(lines[whole - 1]) if whole and lines[whole - 1] > at else int(lines[np.searchsorted(lines, at, "right")])
        if ends[z - 1] - base <= TILE:
            cell = np.repeat(item[at:z] * right, width[at:z]) + ri[_ranges(begin[at:z], width[at:z])]
            yield np.unique(cell, return_counts=True)
        else:  # one item, in parts
            total = np.zeros(right, np.int64)
            for a in range(at, z):
                row = ri[begin[a] : begin[a] + width[a]]
                total[row] += 1  # a record has an item once
            some = np.flatnonzero(total)
            yield item[at] * right + some, total[some]
        at = z


def _ranges(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after the other."""
    return np.arange(int(width.sum())) + np.repeat(begin - (np.cumsum(width) - width), width)


def pair_counts(records: DataFrame, key: str, left: Column, right: Column, version: str | None = None, ordered: bool = True) -> tuple[DataFrame, int]:
    """Pair counts (a, b, n, n_a, n_b), and the number of records that have items on both sides.

    left and right: array columns of one type, the items on either side of a record; repeats within one count once.
    With ordered=False the two sides are one basket: give the same column twice, and each pair comes once with a < b.
    Records that share a key count once (the greatest version holds, else the largest); a null key, and a record with
    no item on one side, are left out, so n_a and n_b too are counted over the records that remain. Null items are
    ignored. An empty table gives no pairs and 0.
    """
    v = F.col(version) if version else F.lit(0)
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), v.alias("v"), left.alias("x"), right.alias("y"))
    rows = rows.groupBy("k").agg(F.max(F.struct("v", "x", "y")).alias("m")).select("m.x", "m.y")
    item = rows.schema["x"].dataType.elementType
    schema = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("a", item), T.StructField("b", item), T.StructField("n", T.LongType())])

    def out(kind: int, a: pa.Array, b: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), a, b, pa.array(n.astype(np.int64))], names=["kind", "a", "b", "n"])

    def block(x: pa.Array, y: pa.Array) -> Iterator[pa.RecordBatch]:
        ls, li, left_items = _sparse(x)
        rs, ri, right_items = _sparse(y)
        both = (np.diff(ls) > 0) & (np.diff(rs) > 0)
        if not both.any():
            return
        width = len(right_items)
        for cell, n in gram(ls, li, rs, ri, width):
            yield out(0, left_items.take(pa.array(cell // width)), right_items.take(pa.array(cell % width)), n)
        for kind, starts, ids, items in ((1, ls, li, left_items), (2, rs, ri, right_items)):
            n = np.bincount(ids[np.repeat(both, np.diff(starts))], minlength=len(items))
            yield out(kind, items, pa.nulls(len(items), items.type), n)
        none = pa.nulls(1, left_items.type)
        yield out(3, none, none, np.array([both.sum()]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows + sum(len(c.flatten()) for c in batch.columns)
            if size >= HELD:
                t = pa.Table.from_batches(held).combine_chunks()
                yield from block(t["x"].combine_chunks(), t["y"].combine_chunks())
                held, size = [], 0
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from block(t["x"].combine_chunks(), t["y"].combine_chunks())

    sums = stored(rows.mapInArrow(part, schema).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "gram")
    total = sums.where("kind = 3").select("n").first()
    pairs = sums.where("kind = 0" + ("" if ordered else " and a < b")).select("a", "b", "n")
    pairs = pairs.join(sums.where("kind = 1").select("a", F.col("n").alias("n_a")), "a")
    pairs = pairs.join(sums.where("kind = 2").select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
    return pairs.select("a", "b", "n", "n_a", "n_b"), total[0] if total else 0


def tied_pairs(records: DataFrame, key: str, left: Column, right: Column, version: str | None = None, ordered: bool = True, least: int = 5, share: float = 0.002, lift: float = 5.0) -> DataFrame:
    """Every pair with its counts, ratio to chance, and whether it is strongly tied.

    Tied: at least `least` times, in at least `share` of the records, and at least `lift` times as often as the two
    items' counts would give by chance. See pair_counts().
    """
    pairs, total = pair_counts(records, key, left, right, version, ordered)
    n, a, b = (F.col(c).cast("double") for c in ("n", "n_a", "n_b"))
    tied = (F.col("n") >= least) & (F.col("n") >= share * total) & (n * total >= lift * a * b)
    return pairs.withColumn("lift", n * total / (a * b)).withColumn("tied", tied)
