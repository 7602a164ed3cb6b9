from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import termfreq as Q

SCHEMA = "tok_id long, doc_id long, tok_pos int, tok_type tinyint, tok_value string, n int, records string"


def brute(rows, most):
    seen, docs = {}, defaultdict(list)
    for k, d, p, t, v, *_ in rows:
        if k is not None:
            seen[k] = (d, p, t, v)
    for k, (d, p, t, v) in sorted(seen.items()):
        docs[d if d is not None else ("none", k)].append((p or 0, k, None if t is None or v is None else (t, v)))
    occurs, records = Counter(), defaultdict(set)
    for d, items in docs.items():
        seq = [x for _, _, x in sorted(items, key=lambda i: i[:2])]
        for n in range(1, (1 if isinstance(d, tuple) else most) + 1):
            for i in range(len(seq) - n + 1):
                g = tuple(seq[i : i + n])
                if None not in g:
                    occurs[g] += 1
                    if not isinstance(d, tuple):
                        records[g].add(d)
    return {g: (c, len(records[g])) for g, c in occurs.items()}


def run(spark, rows, most, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = Q.value_counts(df, "tok_id", "doc_id", "tok_pos", ["tok_type", "tok_value"], most=most, **how).collect()
    out = {tuple(tuple(t) for t in r["gram"]): (r["occurrences"], r["records"]) for r in got}
    assert len(out) == len(got) and all(len(r["gram"]) == r["n"] for r in got)
    return out


def made(seed, n=400, docs=6):
    rng = random.Random(seed)
    place = Counter()
    rows = []
    for k in range(n):
        d = rng.choice([*range(docs), None])
        place[d] += 1
        rows.append((k, d, place[d] - 1, rng.choice((0, 1)), rng.choice(["a", "b", '"x"\\', "", "é", None]), 0, "x"))
    return rows + rng.sample(rows, 20) + [(None, 1, 0, 0, "a", 0, "x"), (n, 1, None, None, "a", 0, "x")]


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_with_common_prefixes_of_any_length(seed):
    rng = np.random.default_rng(seed)
    seqs = [rng.integers(1, 2 + seed, rng.integers(1, 40)).tolist() for _ in range(12)] + [[1] * 70]
    ids, record = np.concatenate(seqs), np.repeat(np.arange(13), [len(x) for x in seqs])
    s = Q.Suffixes(ids, record)
    suffix = [tuple(x[i:]) for x in seqs for i in range(len(x))]
    assert [suffix[k] for k in s.order] == sorted(suffix)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert s.common_prefix(s.order).tolist() == [0] + [common(suffix[a], suffix[b]) for a, b in itertools.pairwise(s.order)]
    occurs, records = Counter(), defaultdict(set)
    for r, x in enumerate(seqs):
        for n in range(1, len(x) + 1):
            for i in range(len(x) - n + 1):
                occurs[tuple(x[i : i + n])] += 1
                records[tuple(x[i : i + n])].add(r)
    got = {tuple(ids[a : a + n].tolist()): (int(o), int(c)) for n, at, os, cs in Q.gram_counts(ids, record) for a, o, c in zip(at, os, cs, strict=True)}
    assert got == {g: (c, len(records[g])) for g, c in occurs.items()}


@pytest.mark.parametrize("most", [1, 3, 9])
def test_against_brute_force(spark, most):
    rows = made(1)
    assert run(spark, rows, most) == brute(rows, most)


@pytest.mark.parametrize(("most", "piece"), [(1, 16), (3, 16), (3, 5)])
def test_long_records_in_pieces(spark, most, piece):
    rows = made(2, 500, 3)
    assert run(spark, rows, most, piece=piece) == brute(rows, most)


def test_nothing(spark):
    assert run(spark, [], 2) == {}
    assert run(spark, [(1, 1, 0, 0, None, 0, "")], 2) == {}


def test_marks(spark):
    rows = [(10 * d + i, d, i, 0, v, 0, "") for d in range(8) for i, v in enumerate(["all", "few" if d < 2 else "x", "half" if d < 4 else "y"])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["tok_value"]: (r["occurrences"], r["records"], r["mark"]) for r in Q.marked_values(df, "tok_id", "doc_id", "tok_pos", ["tok_type", "tok_value"]).collect()}
    assert got == {"all": (8, 8, "common"), "few": (2, 2, "rare"), "half": (4, 4, None), "x": (6, 6, "common"), "y": (4, 4, None)}
    assert Q.marked_values(df.limit(0), "tok_id", "doc_id", "tok_pos", ["tok_type", "tok_value"]).count() == 0


def test_one_value_in_a_third_of_all_tokens(spark):
    df = spark.range(30_000).select(F.col("id").alias("tok_id"), (F.col("id") / 10).cast("long").alias("doc_id"), (F.col("id") % 10).cast("int").alias("tok_pos"), F.lit(0).alias("tok_type"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("tok_value"))
    got = Q.value_counts(df, "tok_id", "doc_id", "tok_pos", ["tok_type", "tok_value"]).where("gram[0].tok_value = 'hot'").first()
    assert (got["occurrences"], got["records"]) == (10_000, 3000)
