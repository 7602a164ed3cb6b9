"""How often every distinct value, and every run of values, occurs, and in how many records.

Each task builds a suffix array over the token sequences of its records, by prefix doubling until no two suffixes are
alike, and the common prefix of every two neighbours, of any length, from the ranks of the doublings.  The common
prefixes split the array into intervals: for every n, one for each distinct n-gram, whose length is the number of
occurrences.  Where the suffixes of one record follow one another in its own suffix array with a common prefix of n or
more, they repeat an n-gram within the record; taking those adjacencies off leaves the number of records.  Records lie
whole in one task, so both numbers add up over tasks, and only one row for each n-gram and task is shuffled: a value
that makes up a third of all tokens costs no more than any other.

Records longer than a piece are cut into pieces with an overlap; their n-grams carry the record, so that it is counted
once all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Suffixes:
    """The suffix array of sequences laid end to end.

    ids: the tokens as numbers from 1; record: the number of each token's record, ascending. No suffix goes beyond its
    record. levels[k] ranks the suffixes by their first 2**k tokens.
    """

    def __init__(self, ids: np.ndarray, record: np.ndarray) -> None:
        n = len(ids)
        ends = np.append(np.flatnonzero(record[1:] != record[:-1]) + 1, n)
        self.record, self.left = record, np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # tokens to the end
        rank = ids.astype(np.int64)
        self.levels = [rank]
        h, longest = 1, int(self.left.max(initial=0))
        while h < longest:
            second = np.zeros(n, np.int64)
            second[: n - h] = np.where(self.left[: n - h] > h, rank[h:], 0)
            made, rank = np.unique(rank * (int(rank.max()) + 1) + second, return_inverse=True)
            self.levels.append(rank + 1)
            rank = self.levels[-1]
            h *= 2
            if len(made) == n:
                break
        self.order = np.argsort(rank, kind="stable")  # like suffixes by record
        self.own = np.lexsort((rank, record))  # each record's own suffix array

    def common_prefix(self, order: np.ndarray) -> np.ndarray:
        """Tokens each suffix has in common with the one before it in the order."""
        lcp = np.zeros(len(order), np.int64)
        if len(order) < 2:
            return lcp
        a, b = order[:-1], order[1:]
        most = np.minimum(self.left[a], self.left[b])
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            on = np.flatnonzero(got < most)
            x, y = a[on] + got[on], b[on] + got[on]
            got[on] += np.where(self.levels[k][x] == self.levels[k][y], 1 << k, 0)
        lcp[1:] = np.minimum(got, most)
        return lcp


def gram_counts(ids: np.ndarray, record: np.ndarray, most: int | None = None, counted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to most (to the longest record by default): n, a place where each distinct n-gram occurs, its
    occurrences, its records. counted: only occurrences that begin at these places count, and n-grams that have one."""
    if not len(ids):
        return
    s = Suffixes(ids, record)
    lcp, near = s.common_prefix(s.order), s.common_prefix(s.own)
    near[1:][record[s.own[1:]] != record[s.own[:-1]]] = 0
    longest = int(s.left.max())
    for n in range(1, longest + 1 if most is None else min(most, longest) + 1):
        whole = s.left[s.order] >= n
        new = np.flatnonzero((lcp < n) & whole)  # an interval begins
        group = np.cumsum((lcp < n) & whole) - 1
        at = np.empty(len(ids), np.int64)
        at[s.order] = group  # the interval of each suffix
        if counted is not None:
            whole &= counted[s.order]
        occurs = np.bincount(group[whole], minlength=len(new))
        records = np.bincount(at[s.order[s.left[s.order] >= n]], minlength=len(new)) - np.bincount(at[s.own[near >= n]], minlength=len(new))
        ok = occurs > 0
        yield n, s.order[new][ok], occurs[ok], records[ok]


def value_counts(tokens: DataFrame, key: str, record: str, position: str, columns: list[str], version: str | None = None, most: int = 1, piece: int = 1 << 16) -> DataFrame:
    """Rows (n, gram, occurrences, records): every n-gram of up to most tokens with its counts over the whole table.

    A token is one row; its value is the struct of columns, and gram is an array of such structs. A row in which one
    of them is null is no token, and it parts the tokens before and after it. key: rows that repeat it count once
    (the greatest version holds, else the largest row); rows with a null key are left out. record and position say
    where it stands; a null record counts for occurrences of single values, not for records; tokens in the same place
    stand in the order of their key. An empty table gives no rows; other columns are ignored.
    """
    gone = F.lit(False)
    for c in columns:
        gone |= F.col(c).isNull()
    value = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    v = F.col(version) if version else F.lit(0)
    rows = tokens.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(record).alias("r"), F.coalesce(F.col(position).cast("long"), F.lit(0)).alias("p"), v.alias("v"), F.when(~gone, value).alias("x"))
    rows = rows.groupBy("k").agg(F.max(F.struct("v", "r", "p", "x")).alias("m")).select("k", "m.r", "m.p", "m.x")
    shift = most - 1
    rows = rows.withColumn("c", F.floor(F.col("p") / piece))
    long = rows.where("c > 0").select(F.col("r").alias("r2")).distinct()
    rows = rows.join(long, F.col("r") == F.col("r2"), "left").withColumn("cut", F.col("r2").isNotNull()).drop("r2")
    if shift:  # a piece also reads what its last n-grams need of the next one
        back = F.when(F.col("r").isNotNull() & (F.col("c") > 0) & (F.col("p") % piece < shift), F.array(F.struct(F.col("c").alias("c"), F.lit(True).alias("own")), F.struct((F.col("c") - 1).alias("c"), F.lit(False).alias("own"))))
        rows = rows.withColumn("e", F.explode(F.coalesce(back, F.array(F.struct(F.col("c").alias("c"), F.lit(True).alias("own")))))).select("k", "r", "p", "x", "cut", "e.c", "e.own")
    else:
        rows = rows.withColumn("own", F.lit(True))
    salt = F.when(F.col("r").isNull(), F.pmod(F.xxhash64("k"), F.lit(1 << 20)))  # rows of no record needn't meet
    rows = rows.withColumn("salt", salt)
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("r", "c", "p", "k", F.col("x").isNull().alias("gone"), F.to_json("x", {"ignoreNullFields": "false"}).alias("x"), "cut", "own", "salt")
    rows = rows.repartition(parts, "r", "c", "salt").sortWithinPartitions("r", "c", "p", "k")
    record_type = tokens.schema[record].dataType
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("g", T.ArrayType(T.StringType())), T.StructField("r", record_type), T.StructField("occurs", T.LongType()), T.StructField("records", T.LongType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:
                table = pa.Table.from_batches(held).combine_chunks()
                same = _runs(table)
                cut = int(np.flatnonzero(same != same[-1])[-1]) + 1 if same[0] != same[-1] else 0
                if cut:
                    yield from _count(table.slice(0, cut), most, schema)
                    held = table.slice(cut).to_batches()
                    size = table.num_rows - cut
        if size:
            yield from _count(pa.Table.from_batches(held).combine_chunks(), most, schema)

    got = rows.mapInArrow(part, schema)
    sums = got.groupBy("n", "g", "r").agg(F.sum("occurs").alias("occurs"), F.max("records").alias("one"), F.sum("records").alias("records"))
    sums = sums.groupBy("n", "g").agg(F.sum("occurs").alias("occurrences"), F.sum(F.when(F.col("r").isNull(), F.col("records")).otherwise(F.col("one"))).alias("records"))
    kind = T.StructType([T.StructField(f"v{i}", tokens.schema[c].dataType) for i, c in enumerate(columns)]).simpleString()
    named = T.StructType([T.StructField(c, tokens.schema[c].dataType) for c in columns]).simpleString()
    gram = F.transform("g", lambda x: F.from_json(x, kind).cast(named))
    return sums.select("n", gram.alias("gram"), "occurrences", "records")


def _runs(table: pa.Table) -> np.ndarray:
    """A number for each row's piece of a record, ascending."""
    r, c = table["r"].combine_chunks(), np.asarray(table["c"])
    code = np.asarray(r.dictionary_encode(null_encoding="encode").indices if not isinstance(r, pa.DictionaryArray) else r.indices)
    new = np.concatenate(([False], (code[1:] != code[:-1]) | (c[1:] != c[:-1])))
    return np.cumsum(new)


def _count(table: pa.Table, most: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    run = _runs(table)
    gone = np.asarray(table["gone"])
    cut = np.asarray(table["cut"])
    own = np.asarray(table["own"])
    r = table["r"].combine_chunks()
    homeless = np.asarray(r.is_null())
    part = run * 2  # a record whose tokens a gap parts stays one record
    for whole in (True, False):
        pick = np.flatnonzero((cut != whole) & ~homeless) if whole else np.flatnonzero(cut | homeless)
        if not len(pick):
            continue
        words = table["x"].combine_chunks().take(pa.array(pick)).dictionary_encode()
        ids = np.asarray(words.indices.fill_null(-1)).astype(np.int64) + 1
        ids[gone[pick]] = 0
        seq = part[pick]
        if not whole:  # each piece, and each row of no record, on its own
            yield from _pieces(table, pick, ids, seq, own[pick], homeless[pick], words.dictionary, most)
            continue
        keep = ids > 0
        if most > 1:  # a gap takes a place, so that no n-gram spans it
            for n, at, occurs, records in _gapped(ids, seq, most):
                yield _batch(n, at, occurs, records, ids, words.dictionary, None, table, pick)
        else:
            for n, at, occurs, records in gram_counts(ids[keep], seq[keep], most):
                yield _batch(n, at, occurs, records, ids[keep], words.dictionary, None, table, pick)


def _gapped(ids: np.ndarray, seq: np.ndarray, most: int, counted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    gap = ids == 0
    if not gap.any():
        yield from gram_counts(ids, seq, most, counted)
        return
    for n, at, occurs, records in gram_counts(np.where(gap, ids.max() + 1, ids), seq, most, counted):
        ok = np.ones(len(at), bool)
        for k in range(n):
            ok &= ~gap[at + k]
        if ok.any():
            yield n, at[ok], occurs[ok], records[ok]


def _pieces(table: pa.Table, pick: np.ndarray, ids: np.ndarray, seq: np.ndarray, own: np.ndarray, homeless: np.ndarray, words: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    if homeless.any():
        at = homeless & (ids > 0)
        one = ids[at]
        for n, first, occurs, _ in gram_counts(one, np.arange(len(one)), 1):
            yield _batch(n, first, occurs, np.zeros_like(occurs), one, words, None, table, pick)
    rest = np.flatnonzero(~homeless)
    for here in np.split(rest, np.flatnonzero(np.diff(seq[rest])) + 1) if len(rest) else ():
        # n-grams that begin in the overlap belong to the next piece
        for n, at, occurs, _ in _gapped(ids[here], np.zeros(len(here), np.int64), most, own[here]):
            yield _batch(n, at, occurs, np.ones_like(occurs), ids[here], words, pick[here[0]], table, pick)


def _batch(n: int, at: np.ndarray, occurs: np.ndarray, records: np.ndarray, ids: np.ndarray, words: pa.Array, row: int | None, table: pa.Table, pick: np.ndarray) -> pa.RecordBatch:
    grams = np.stack([ids[at + k] - 1 for k in range(n)], 1).ravel() if len(at) else np.zeros(0, np.int64)
    g = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), words.take(pa.array(grams)))
    r = table["r"].combine_chunks()
    who = pa.nulls(len(at), r.type) if row is None else r.take(pa.array(np.full(len(at), row)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), g, who, pa.array(occurs.astype(np.int64)), pa.array(records.astype(np.int64))], names=["n", "g", "r", "occurs", "records"])


def mark(records: Column, total: Column, rare: int = 3, common: float = 0.5) -> Column:
    """'rare' below so many records, 'common' in more than that share of all, else null."""
    return F.when(records < rare, "rare").when(records > common * total, "common")


def marked_values(tokens: DataFrame, key: str, record: str, position: str, columns: list[str], version: str | None = None, rare: int = 3, common: float = 0.5) -> DataFrame:
    """Every distinct value with its occurrences, records and mark (null: neither rare nor common).

    Shares are of the distinct records of the table, whether or not they hold a value. See value_counts().
    """
    counts = value_counts(tokens, key, record, position, columns, version, 1)
    total = tokens.where(F.col(record).isNotNull()).agg(F.countDistinct(record)).scalar()
    value = [F.col("gram")[0][c].alias(c) for c in columns]
    one = counts.where("n = 1").select(*value, "occurrences", "records")
    return one.withColumn("mark", mark(F.col("records"), total, rare, common))
