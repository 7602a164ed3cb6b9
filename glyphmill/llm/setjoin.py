"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Every record's set is embedded by min-hashing: coordinate i holds the token of the set that comes first in the i-th
random order of all tokens.  A tree sends a record down one path: at each node a coordinate is drawn, the same for all
records in the node, and records go on together when they hold the same token there.  No two trees share coordinates,
so that what one loses another can find.  Two records of similarity s stay
together over d levels with chance s**d.  Small nodes are not split further but compared in full, by bit sketches, and
so are nodes of any size at the last level, for which the trees are planned; several trees reach the wanted recall;
what is left is verified on the exact sets.

The first levels of all trees are taken at once, where the record is read, and only (node, path, sketch, class) of 32
bytes is shuffled, never a set.  The deeper levels happen inside the node's task, on the sorted path.  A node too large
for a task is handed on as it streams by, divided into blocks, and every two blocks are compared in a task of their own.
Records with the same set are one class: they are compared once, however many there are.  Two hashes of 64 bits tell
classes apart; wherever one decides alone, the sets or the other hash are looked at afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

COORDINATES, CHOICES, LEVELS = 64, 2, 2  # of the embedding, at least; per node; levels in a path
HOT = 1 << 16  # classes a task remembers as sent
CHUNK = 1 << 17  # entries of whole nodes that a task compares at a time; larger nodes are divided
TAG = np.uint64(0xFFFFFFFFFFFF)  # the bits of a path that tell the records' group
WIDE, BLOCK = 512, 1024  # entries of a leaf from which it is compared in blocks; entries of a block


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64 bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


def flat_sets(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each row's lists, the lists kept apart: the row and the element, by row and element."""
    n = len(columns[0])
    keys = []
    for band, col in enumerate(columns):
        size = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
        value = col.flatten()
        row = np.repeat(np.arange(n, dtype=np.uint64), size)
        if value.null_count:
            ok = np.asarray(value.is_valid())
            row, value = row[ok], value.drop_null()
        v = np.asarray(value).astype(np.int64)
        keys.append(row << np.uint64(40) | np.uint64(band) << np.uint64(32) | (v & 0xFFFFFFFF).astype(np.uint64))
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> np.uint64(40)).astype(np.int64), (key & np.uint64(0xFFFFFFFFFF)).astype(np.int64)


def class_ids(row: np.ndarray, element: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit id of each row's set; equal sets have equal ids."""
    size = np.bincount(row, minlength=n)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    total = np.zeros(n, np.uint64)
    some = size > 0
    salt = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    if some.any():
        total[some] = np.add.reduceat(mix(element.astype(np.uint64) + salt), start[some])
    return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _prepare(records: DataFrame, key: str, apart: str, sets: list[str], version: str | None, min_size: int) -> DataFrame:
    """Rows (k, a, v, cid, sid, flat) of all records that have a key: the two ids of their sets and the sets, null for
    those with fewer than min_size elements."""
    lists = [F.col(c).alias(f"s{i}") for i, c in enumerate(sets)]
    v = F.col(version) if version else F.lit(0)
    some = sum((F.coalesce(F.size(F.col(c)), F.lit(0)) for c in sets), F.lit(0)) >= min_size
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(apart).alias("a"), v.alias("v"), some.alias("some"), *lists)
    kinds = (("k", rows.schema["k"].dataType), ("a", rows.schema["a"].dataType), ("v", rows.schema["v"].dataType), ("cid", T.LongType()), ("sid", T.LongType()), ("flat", T.ArrayType(T.LongType())))
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, element = flat_sets(batch.columns[3:])
            size = np.bincount(row, minlength=n)
            few = size < min_size
            ids = [pa.array(class_ids(row, element, n, seed), mask=few) for seed in (0, 1)]
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(few, 0, size)))).astype(np.int32), mask=np.append(few, False)), pa.array(element[~few[row]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *ids, flat], names=schema.names)

    small = rows.where(~F.col("some")).select("k", "a", "v", *[F.lit(None).cast(t).alias(n) for n, t in kinds[3:]])
    return rows.where("some").drop("some").mapInArrow(part, schema).union(small)


def coordinates(trees: int, first: int) -> int:
    """Coordinates that the trees and the sketches need."""
    return max(COORDINATES, trees * (first + LEVELS) * CHOICES)


def min_hashes(size: np.ndarray, element: np.ndarray, seed: int, count: int = COORDINATES) -> np.ndarray:
    """The embedding: for each coordinate and row the least hash in the row. No row may be empty."""
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    base = (mix(element.astype(np.uint64) ^ np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    a = (rng.integers(1 << 31, size=count, dtype=np.uint32) << 1) | 1
    b = rng.integers(1 << 32, size=count, dtype=np.uint32)
    out = np.empty((count, len(size)), np.uint32)
    step = np.empty_like(base)
    high = base >> 15
    for i in range(count):
        np.multiply(base, a[i], out=step)
        np.add(step, b[i], out=step)
        np.bitwise_xor(step, high, out=step)
        np.minimum.reduceat(step, start, out=out[i])
    return out


def paths(hashes: np.ndarray, trees: int, first: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each tree the node after the first levels and the path below it, 8 bits a level, in the upper 16 bits."""
    n = hashes.shape[1]
    rows = np.arange(n)
    for tree in range(trees):
        node = mix(np.full(n, seed * 1000 + tree + 1, np.uint64))
        path = np.zeros(n, np.uint64)
        for level in range(first + LEVELS):
            at = (tree * (first + LEVELS) + level) * CHOICES + (node >> np.uint64(33)) % np.uint64(CHOICES)
            node = mix(node ^ (hashes[at.astype(np.int64), rows].astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
            if level == first - 1:
                top = node
            elif level >= first:
                path |= (node & np.uint64(0xFF)) << np.uint64(56 - 8 * (level - first))
        yield top, path


def sketches(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 coordinates."""
    out = np.zeros(hashes.shape[1], np.uint64)
    for i in range(COORDINATES):
        out |= ((hashes[i] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64) << np.uint64(i)
    return out


def _entries(prepared: DataFrame, trees: int, first: int, seed: int) -> DataFrame:
    """Rows (node, path, sketch, cid): one for each class and tree; the low bits of path tell the records' group."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            cid = np.asarray(batch.column(0))
            tag = np.asarray(batch.column(1)).astype(np.uint64) & TAG
            order = np.lexsort((tag, cid))
            c, t = cid[order], tag[order]
            new = np.concatenate(([True], c[1:] != c[:-1]))
            other = np.concatenate(([False], (c[1:] == c[:-1]) & (t[1:] != t[:-1])))
            rank = np.cumsum(other)
            rank -= np.maximum.accumulate(np.where(new, rank, 0))
            take = new | (other & (rank == 1))  # of each class one record, and one of another group
            if sent:
                take &= ~np.isin(c, np.fromiter(sent, np.int64, len(sent)))
            two = c[other & (rank == 1)]
            if len(sent) < HOT:
                sent.update(two.tolist())
            idx = order[take]
            if not len(idx):
                continue
            flat = batch.column(2).take(pa.array(idx))
            size = np.asarray(pc.list_value_length(flat)).astype(np.int64)
            hashes = min_hashes(size, np.asarray(flat.flatten()), seed, coordinates(trees, first))
            sk, cids, tags = sketches(hashes).view(np.int64), cid[idx], tag[idx]
            for node, path in paths(hashes, trees, first, seed):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array((path | tags).view(np.int64)), pa.array(sk), pa.array(cids)], names=["node", "path", "sk", "cid"])

    tagged = prepared.where("cid is not null").select("cid", F.xxhash64("a").alias("a"), "flat")
    return tagged.mapInArrow(part, "node long, path long, sk long, cid long")


def _leaves(node: np.ndarray, path: np.ndarray, limit: int, depth: int) -> np.ndarray:
    """The leaf of each entry, entries in the order of node and path: the shallowest node of at most limit entries, else
    the node at the last level, however many it has."""
    n = len(node)
    leaf = np.full(n, -1)
    base = np.concatenate(([True], node[1:] != node[:-1]))
    made = 0
    for d in range(depth, LEVELS + 1):
        cut = base.copy()
        if d:
            p = path >> np.uint64(64 - 8 * d)
            cut[1:] |= p[1:] != p[:-1]
        group = np.cumsum(cut) - 1
        size = np.bincount(group)
        ok = (leaf < 0) & ((size[group] <= limit) | (d == LEVELS))
        leaf[ok] = made + group[ok]
        made += len(size)
    return leaf


def _once(x: np.ndarray) -> np.ndarray:
    """The entries (node, path, sketch, class) by node and path, of each class in a node one of each of two groups: it
    needs two to meet every other. A class has the same path in all of its entries of a node."""
    path = x[1].view(np.uint64)
    tag = path & TAG
    order = np.lexsort((tag, x[3], path >> np.uint64(48), x[0]))
    x, tag = x[:, order], tag[order]
    for back in (1, 2):
        same = np.zeros(x.shape[1], bool)
        same[back:] = (x[0, back:] == x[0, :-back]) & (x[3, back:] == x[3, :-back])
        if back == 1:
            same[1:] &= tag[1:] == tag[:-1]
        x, tag = x[:, ~same], tag[~same]
    return x


def _near(leaf: np.ndarray, sk: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of one leaf whose sketches agree in enough bits; the entries of a leaf lie together."""
    start = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
    end = np.append(start[1:], len(leaf))
    wide = end - start >= WIDE
    at = np.flatnonzero(np.repeat(~wide, end - start))
    step = 0
    while True:
        step += 1
        at = at[at + step < len(leaf)]
        at = at[leaf[at] == leaf[at + step]]
        if not len(at):
            break
        hit = at[np.bitwise_count(sk[at] ^ sk[at + step]) <= 64 - bits]
        yield hit, hit + step
    for s, e in zip(start[wide].tolist(), end[wide].tolist(), strict=True):
        for a in range(s, e, BLOCK):
            for b in range(a, e, BLOCK):
                i, j = np.nonzero(np.bitwise_count(sk[a : min(a + BLOCK, e), None] ^ sk[None, b : min(b + BLOCK, e)]) <= 64 - bits)
                ok = i + a < j + b
                yield i[ok] + a, j[ok] + b


def _compare(x: np.ndarray, limit: int, bits: int, depth: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share a leaf and whose sketches agree in enough bits, in parts of about the given size."""
    x = _once(x)
    if not x.shape[1]:
        return
    path = x[1].view(np.uint64)
    leaf, tag, sk, cid = _leaves(x[0], path, limit, depth), path & TAG, x[2].view(np.uint64), x[3]
    side = x[4] if len(x) > 4 else None  # of a cell: twice the block, and 1 where the cell has only that one
    held: list[np.ndarray] = []
    size = 0

    def distinct() -> tuple[np.ndarray, np.ndarray]:
        pair = np.concatenate(held, 1)
        a, b = np.minimum(pair[0], pair[1]), np.maximum(pair[0], pair[1])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[new], b[new]

    for i, j in _near(leaf, sk, bits):
        ok = (cid[i] != cid[j]) & (tag[i] != tag[j])
        if side is not None:
            ok &= (side[i] != side[j]) | (side[i] & 1 == 1)
        held.append(np.stack([cid[i[ok]], cid[j[ok]]]))
        size += held[-1].shape[1]
        if size >= most:
            yield distinct()
            held, size = [], 0
    if size:
        yield distinct()


def _stacked(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.stack([np.asarray(c) for c in batch.columns[:columns]])


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in found:
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], names=["ca", "cb", "node", "path"])


def _candidates(entries: DataFrame, limit: int, bits: int, chunk: int = CHUNK) -> DataFrame:
    """Distinct pairs (ca, cb) of classes found in some leaf."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, hot = 0, None

        def hand_on(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[i]) for i in (3, 2, 0, 1)], names=["ca", "cb", "node", "path"])

        for x in _stacked(batches, 4):
            if hot is not None:
                z = int(np.searchsorted(x[0] != hot, True))
                if z:
                    yield hand_on(x[:, :z])
                if z == x.shape[1]:
                    continue
                x, hot = x[:, z:], None
            held.append(x)
            size += x.shape[1]
            if size < chunk:
                continue
            x = np.concatenate(held, 1)
            cut = np.flatnonzero(x[0, 1:] != x[0, :-1])
            z = int(cut[-1]) + 1 if len(cut) else 0
            if z:
                yield from _pairs(_compare(x[:, :z], limit, bits, 0))
            x = x[:, z:]
            if x.shape[1] >= chunk:
                x = _once(x)
                if x.shape[1] >= chunk:
                    hot = x[0, 0]
                    yield hand_on(x)
                    x = x[:, :0]
            held, size = [x], x.shape[1]
        if size:
            yield from _pairs(_compare(np.concatenate(held, 1), limit, bits, 0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares every cell, rows (cell, path, sketch, class, side), as a whole; pairs of one side only where it is
        the cell's only one."""
        held: list[np.ndarray] = []
        size = 0
        for x in _stacked(batches, 5):
            held.append(x)
            size += x.shape[1]
            if size < chunk:
                continue
            x = np.concatenate(held, 1)
            cut = np.flatnonzero(x[0, 1:] != x[0, :-1])
            if len(cut):
                z = int(cut[-1]) + 1
                yield from _pairs(_compare(x[:, :z], limit, bits, 0))
                x = x[:, z:]
            held, size = [x], x.shape[1]
        if size:
            yield from _pairs(_compare(np.concatenate(held, 1), limit, bits, 0))

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = entries.repartition(n, "node").sortWithinPartitions("node", "path")
    got = stored(rows.mapInArrow(part, "ca long, cb long, node long, path long"), "met")
    large = got.where("node is not null").select("node", "path", F.col("cb").alias("sk"), F.col("ca").alias("cid"))
    # a class has all of its entries of a node in one block
    blocks = large.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select("node", F.ceil(F.col("n") / (chunk / 2)).cast("int").alias("blocks"))
    side = large.join(blocks, "node").withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grid = side.withColumn("other", other).withColumn("cell", F.xxhash64("node", F.least("side", "other"), F.greatest("side", "other")))
    grid = grid.select("cell", "path", "sk", "cid", (F.col("side") * 2 + (F.col("side") == F.col("other")).cast("int")).cast("long").alias("side"))
    more = grid.repartition(n, "cell").sortWithinPartitions("cell", "path").mapInArrow(cells, "ca long, cb long, node long, path long")
    return got.where("node is null").select("ca", "cb").union(more.select("ca", "cb")).distinct()


def plan_of(threshold: float, recall: float, first: int = 2) -> tuple[int, int]:
    """Trees and agreeing sketch bits for a similarity and a recall at it; no leaf lies deeper than LEVELS below first."""
    trees = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** (first + LEVELS)))
    mean = 64 * (1 + threshold) / 2
    spread = math.sqrt(64 * (1 + threshold) / 2 * (1 - threshold) / 2)
    return trees, math.floor(mean - 3.2 * spread)


def first_levels(records: int) -> int:
    """Levels taken before the shuffle: two, and one more for each factor of ten above five million records, as a
    level divides unlike records by about ten; the nodes a task gets so keep their size as the table grows."""
    return 2 + max(0, math.ceil(math.log10(max(1, records) / 5e6)))


def similar_classes(records: DataFrame, key: str, apart: str, sets: list[str], version: str | None = None, min_size: int = 1, threshold: float = 0.8, recall: float = 0.985, limit: int = 200, first: int | None = None, seed: int = 1, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and pairs of classes that are similar.

    Returns members (k, a, cid, sid), one row for each record, and links (ca, sa, cb, sb, jaccard) between classes, a
    class being the pair of ids. See similar_pairs() for the rules. Copies are not expanded into pairs, yet no link
    between different sets is lost.
    """
    prepared = stored(_prepare(records, key, apart, sets, version, min_size), "sets")
    members = prepared.groupBy("k").agg(F.max(F.struct("v", "cid", "sid", "a")).alias("m"))
    members = stored(members.where("m.cid is not null").select("k", F.col("m.a").alias("a"), F.col("m.cid").alias("cid"), F.col("m.sid").alias("sid")), "members")
    first = first or first_levels(prepared.where("cid is not null").count())
    trees, bits = plan_of(threshold, recall, first)
    found = stored(_candidates(_entries(prepared, trees, first, seed), limit, bits, chunk), "candidates")
    need = found.select(F.col("ca").alias("cid")).union(found.select("cb")).distinct()
    flat = stored(prepared.select("cid", "sid", "flat").join(need, "cid", "left_semi").groupBy("cid", "sid").agg(F.first("flat").alias("flat")), "flat")
    links = found.join(flat.toDF("ca", "sa", "fa"), "ca").join(flat.toDF("cb", "sb", "fb"), "cb")
    both = F.size(F.array_intersect("fa", "fb"))
    links = links.select("ca", "sa", "cb", "sb", both.alias("i"), (F.size("fa") + F.size("fb")).alias("n"))
    links = links.select("ca", "sa", "cb", "sb", (F.col("i") / (F.col("n") - F.col("i"))).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return members, links


def similar_pairs(records: DataFrame, key: str, apart: str, sets: list[str], **how: object) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of records of different groups whose sets have at least the wanted Jaccard similarity.

    records: key names the record; apart its group, and only records of different groups make a pair (for pairs
    between two tables, union them and let the table be the group); sets: array columns, kept apart from one another,
    in which repeats and order do not matter and null is empty. version: of rows with the same key the greatest
    version holds, else the largest row. min_size: records whose row that holds has fewer elements are left out; so are
    null keys. A null group differs from none and makes no pair. An empty table gives no pairs; other columns are
    ignored.

    recall is the wanted share found of pairs exactly at the threshold; more similar ones are found more often, equal
    sets always. Every pair returned is exact.
    """
    members, links = similar_classes(records, key, apart, sets, **how)
    one = members.toDF("id_a", "ga", "ca", "sa")
    two = members.toDF("id_b", "gb", "cb", "sb")
    across = links.select("ca", "sa", "cb", "sb").join(one, ["ca", "sa"]).join(two, ["cb", "sb"]).where("ga <> gb")
    within = one.join(two, (F.col("ca") == F.col("cb")) & (F.col("sa") == F.col("sb"))).where("id_a < id_b and ga <> gb")
    out = across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return out.union(within.select("id_a", "id_b"))


def linked_records(records: DataFrame, key: str, apart: str, sets: list[str], **how: object) -> DataFrame:
    """Rows (key, class_id, links) of every record: the class of its set, and the number of similar_pairs() it is in.

    Pairs are counted from the sizes of classes and of their groups, so copies are never expanded.
    """
    members, links = similar_classes(records, key, apart, sets, **how)
    of, to = ["cid", "sid"], ["other", "other_s"]
    sizes = stored(members.groupBy(*of, "a").agg(F.count(F.lit(1)).alias("n")), "sizes")
    whole = sizes.groupBy(*of).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("a").isNotNull(), F.col("n"))).alias("known"))
    both = links.select("ca", "sa", "cb", "sb").union(links.select("cb", "sb", "ca", "sa")).toDF(*of, *to)
    near = stored(both.union(whole.select(*of, *of)), "near")  # a class is near itself
    total = near.join(whole.select(*of, "known").toDF(*to, "known"), to).groupBy(*of).agg(F.sum("known").alias("total"))
    own = near.join(sizes.select(*of, "a", "n").toDF(*to, "a", "n"), to).groupBy(*of, "a").agg(F.sum("n").alias("own"))
    got = members.join(total, of).join(own, [*of, "a"], "left")
    count = F.when(F.col("a").isNull(), 0).otherwise(F.coalesce("total", F.lit(0)) - F.coalesce("own", F.lit(0)))
    return got.select(F.col("k").alias(key), F.col("cid").alias("class_id"), count.cast("long").alias("links"))
