from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import setjoin as J

SCHEMA = "rec_id long, doc_id long, l array<int>, c array<int>, r array<int>, id_a int, loaded int"


def brute(rows, least, threshold):
    sets = {}
    for rec, doc, *bands, _, _ in rows:
        if rec is not None:
            sets[rec] = (doc, {(i, x) for i, b in enumerate(bands) for x in b or () if x is not None})
    some = sorted(k for k, (_, s) in sets.items() if len(s) >= least)
    return {(a, b) for a in some for b in some if a < b and None not in (sets[a][0], sets[b][0]) and sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= threshold}


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        base = [rng.sample(range(300), 14) for _ in range(3)]
        for copy in range(rng.choice((1, 1, 2, 4))):
            bands = [[x if rng.random() > copy * 0.03 else rng.randrange(300) for x in b] for b in base]
            rows.append((len(rows), rng.randrange(40), *[rng.sample(b, len(b)) + b[:2] for b in bands], k, 0))
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in J.similar_pairs(df, "rec_id", "doc_id", ["l", "c", "r"], **({"min_size": 24} | how)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rows = made(1, 300)
    want, got = brute(rows, 24, 0.8), run(spark, rows)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100


def test_small_leaves_find_as_much(spark):
    rows = made(2, 300)
    want, got = brute(rows, 24, 0.8), run(spark, rows, limit=4)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_a_crowd_of_near_equal_sets(spark):
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for _ in range(6):
        n, base = 500, rng.choice(4000, 36, replace=False)
        held = np.zeros((n, 9000), np.float32)
        for k in range(n):
            s = base.copy()
            s[rng.choice(36, 3, replace=False)] = rng.choice(np.arange(4000, 9000), 3, replace=False)
            held[k, s] = 1
            rows.append((len(rows), len(rows), s.tolist(), None, None, 0, 0))
        both = held @ held.T
        want |= {(len(rows) - n + int(a), len(rows) - n + int(b)) for a, b in np.argwhere(np.triu(both / (72 - both) >= 0.8, 1))}
    got = run(spark, rows)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 10_000


def test_leaves_of_any_size_are_compared_in_parts():
    rng = np.random.default_rng(3)
    n = 3 * J.BLOCK + 7
    sk = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    sk[-1] = sk[0]
    x = np.stack([np.zeros(n, np.int64), np.arange(n), sk.view(np.int64), np.arange(n)])
    x = np.concatenate([x, x[:, :9]], 1)  # sent twice
    assert [(a.tolist(), b.tolist()) for a, b in J._compare(x, 200, 62, 0)] == [([0], [n - 1])]
    parts = list(J._compare(x, 200, 0, 0, most=1 << 18))
    assert sum(len(a) for a, _ in parts) == n * (n - 1) // 2 and len(parts) > 1


def test_copies_and_dirt(spark):
    s = list(range(30))
    rows = [(k, k % 3, s[::-1] + [4, 4], None, [], 0, 0) for k in range(12)]
    rows += [rows[0], (20, None, s, None, None, 0, 0), (None, 1, s, None, None, 0, 0), (21, 1, None, s, None, 0, 0), (22, 2, None, None, None, 0, 0), (23, 5, [None, 1], None, None, 0, 0)]
    assert run(spark, rows) == brute(rows, 24, 0.8) and len(brute(rows, 24, 0.8)) == 48
    assert run(spark, []) == set()


def test_links_are_counted_without_pairs(spark):
    rows = made(5, 120) + [(9000 + k, k % 4, list(range(30)), None, None, 0, 0) for k in range(12)] + [(9100, None, list(range(30)), None, None, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r[0]: 0 for r in rows}
    for a, b in J.similar_pairs(df, "rec_id", "doc_id", ["l", "c", "r"], min_size=24).collect():
        want[a] += 1
        want[b] += 1
    got = J.linked_records(df, "rec_id", "doc_id", ["l", "c", "r"], min_size=24).collect()
    assert {r["rec_id"]: r["links"] for r in got} == want and want[9000] >= 9
    classes = {r["rec_id"]: r["class_id"] for r in got}
    assert len({classes[9000 + k] for k in range(12)}) == 1 and J.first_levels(10**6) == 2 and J.first_levels(10**9) == 5


def test_the_latest_version_holds(spark):
    a, b = list(range(30)), list(range(100, 130))
    rows = [(1, 1, a, None, None, 0, 1), (1, 1, b, None, None, 0, 2), (2, 2, a, None, None, 0, 1), (3, 3, b, None, None, 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("loaded", F.timestamp_seconds("loaded"))
    got = J.similar_pairs(df, "rec_id", "doc_id", ["l", "c", "r"], version="loaded", min_size=24)
    assert [tuple(r) for r in got.collect()] == [(1, 3)]


def test_a_hot_class_sends_little(spark):
    s = list(range(30))
    df = spark.createDataFrame([(k, k % 50, s, None, None, 0, 0) for k in range(5000)], SCHEMA)
    prepared = J._prepare(df, "rec_id", "doc_id", ["l", "c", "r"], None, 24)
    trees, _ = J.plan_of(0.8, 0.985)
    assert J._entries(prepared, trees, 2, 1).count() <= 2 * trees * prepared.rdd.getNumPartitions()


def test_one_node_larger_than_a_chunk(spark):
    rng = np.random.default_rng(1)
    sk = rng.integers(-(1 << 62), 1 << 62, 600)
    sk[300:] = sk[:300]
    rows = [(7, int(rng.integers(0, 4)) << 56 | k, int(sk[k]), k) for k in range(600)]
    rows = [(n, (p & ~0xFFFFFFFFFFFF) | c, s, c) for n, p, s, c in rows]
    df = spark.createDataFrame(rows, "node long, path long, sk long, cid long")
    small = {tuple(r) for r in J._candidates(df, 10_000, 60, chunk=64).collect()}  # a node of 600, in blocks of 32
    whole = {tuple(r) for r in J._candidates(df, 10_000, 60).collect()}
    assert whole == {(k, k + 300) for k in range(300)} and small == whole


def test_a_divided_node_loses_no_pair(spark):
    rows = made(7, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    args = (df, "rec_id", "doc_id", ["l", "c", "r"])
    got = [{tuple(r) for r in J.similar_pairs(*args, min_size=24, chunk=c).collect()} for c in (8, 1 << 17)]
    assert got[0] >= got[1] and len(got[1]) > 50 and got[0] <= brute(rows, 24, 0.8)


def test_the_latest_version_is_chosen_before_its_size(spark):
    s = list(range(30))
    rows = [(1, 1, s, None, None, 0, 1), (1, 1, s[:5], None, None, 0, 2), (2, 2, s, None, None, 0, 1), (3, 3, s, None, None, 0, 1), (3, 3, [1] * 40, None, None, 0, 2)]
    df = spark.createDataFrame([*rows, (4, 4, s, None, None, 0, 1)], SCHEMA)
    got = J.similar_pairs(df, "rec_id", "doc_id", ["l", "c", "r"], version="loaded", min_size=24)
    assert [tuple(r) for r in got.collect()] == [(2, 4)]


@pytest.mark.parametrize("first", [2, 3, 5])
def test_recall_at_the_threshold_at_every_depth(spark, first):
    rng = random.Random(first)
    rows = []
    for k in range(700):  # 40 shared of 45 and 45: 40 / 50
        x = rng.sample(range(1 << 20), 50)
        rows += [(2 * k, 2 * k, x[:45], None, None, 0, 0), (2 * k + 1, 2 * k + 1, x[:40] + x[45:], None, None, 0, 0)]
    got = run(spark, rows, first=first)
    assert got <= {(2 * k, 2 * k + 1) for k in range(700)} and len(got) >= 0.95 * 700


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_plan(threshold):
    trees, bits = J.plan_of(threshold, 0.985)
    assert 1 <= trees < 80 and 20 < bits < 64
