from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from glyphmill.llm import cooccur as C


def test_baskets_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, [rng.choice("abcdefg") for _ in range(rng.randint(0, 6))], 0) for k in range(300)]
    rows += [rows[5], (None, ["a", "b"], 0), (400, None, 0), (401, [None, "a", "b"], 0)]
    df = spark.createDataFrame(rows, "k long, items array<string>, n int")
    pairs, total = C.pair_counts(df, "k", F.col("items"), F.col("items"), ordered=False)
    baskets = {k: {x for x in v or () if x} for k, v, _ in rows if k is not None}
    n = Counter((a, b) for s in baskets.values() for a in s for b in s if a < b)
    one = Counter(a for s in baskets.values() for a in s)
    assert {(r["a"], r["b"]): (r["n"], r["n_a"], r["n_b"]) for r in pairs.collect()} == {p: (c, one[p[0]], one[p[1]]) for p, c in n.items()}
    assert total == sum(1 for s in baskets.values() if s)


def test_tiles_add_up():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 5, 200)
    s = np.concatenate(([0], np.cumsum(sizes)))
    i = np.concatenate([rng.choice(9, k, replace=False) for k in sizes])
    dense = np.zeros((200, 9), np.int64)
    dense[np.repeat(np.arange(200), sizes), i] = 1
    want = dense.T @ dense
    tile = C.TILE
    try:
        for C.TILE in (tile, 200, 7):
            parts = list(C.gram(s, i, s, i, 9))
            got = np.zeros(81, np.int64)
            for cell, n in parts:
                got[cell] += n
            assert (got.reshape(9, 9) == want).all() and (C.TILE == tile) == (len(parts) == 1)
            assert len(np.concatenate([c for c, _ in parts])) == (want > 0).sum()  # a cell comes once
    finally:
        C.TILE = tile


def test_one_basket_of_many_items(spark):
    df = spark.createDataFrame([(1, list(range(1500))), (2, [3, 4])], "k long, items array<int>")
    pairs, total = C.pair_counts(df, "k", F.col("items"), F.col("items"), ordered=False)
    assert total == 2 and pairs.count() == 1500 * 1499 // 2 and [r["a"] for r in pairs.where("n = 2").collect()] == [3]


def test_ties(spark):
    rows = [(k, 1, 2) for k in range(10)] + [(100 + k, k % 50, k % 49 + 60) for k in range(2000)] + [(1, 1, 2), (9000, None, 3), (9001, 4, None)]
    df = spark.createDataFrame(rows, "rec_id long, a int, b int")
    some = df.where("a is not null and b is not null")
    got = C.tied_pairs(some, "rec_id", F.array("a"), F.array("b")).where("tied").collect()
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(1, 2, 10)]
    assert C.tied_pairs(some.limit(0), "rec_id", F.array("a"), F.array("b")).count() == 0
