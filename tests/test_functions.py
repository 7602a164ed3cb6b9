from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import bytestr as B
from glyphmill.functions import intervals as R
from glyphmill.functions import sparse as P
from glyphmill.functions import threshold as A


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(values, kind="double"):
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def test_byte_strings(spark):
    text = "aé😀z"
    b = B.to_byte_string(F.lit(text))
    row = one(spark, F.length(b), B.from_byte_string(b), B.ascii_lower(F.lit("ÀBc")), B.from_byte_string(F.lit("\xff")))
    assert tuple(row) == (len(text.encode()), text, "Àbc", "�")


@pytest.mark.parametrize(("run", "want"), [("\n\n", "\n\n"), ("\r\n", "\n"), (" ", " "), ("  ", "\t"), ("\r", "\t"), (" \n \n ", "\n\n")])
def test_whitespace(spark, run, want):
    assert one(spark, B.whitespace_class(F.lit(run)))[0] == want


@pytest.mark.parametrize(("run", "want"), [("....", "..."), ("..", ".."), ("---", "--"), ("-", "-"), ("?!", "?!")])
def test_punctuation(spark, run, want):
    assert one(spark, B.punctuation_class(F.lit(run)))[0] == want


def test_kinds(spark):
    row = one(spark, B.kind_name(F.lit(4)), B.kind_name(F.lit(9)), B.kind_number(F.lit("mid")), B.kind_number(F.lit("x")), B.sparse_width(F.lit(65536)), B.sparse_width(F.lit(65537)))
    assert tuple(row) == ("whole", "?", 2, None, 16, 32)


@pytest.mark.parametrize(("text", "n"), [("-$5", 2), ("$5", 1), ("+5", 1), ("-x", 0), ("5", 0), ("$-5", 0)])
def test_number_prefix(spark, text, n):
    assert one(spark, B.number_prefix(F.lit(text)))[0] == n


def test_escape(spark):
    text = "a\n\t\r\\\x01\x7f"
    written = one(spark, B.escape(F.lit(text)))[0]
    assert written == "a\\n\\t\\r\\\\\\x01\\x7F"
    assert B.unescape_text(written) == text
    assert B.unescape_text("\\q\\") == "\\q\\"


def test_sparse(spark):
    a, b = arr([1, 3, 5], "int"), arr([2, 3, 6], "int")
    row = one(spark, P.intersection(a, b), P.union(a, b), P.symmetric_difference(a, b), P.jaccard(a, b), P.union_size(a, b), P.difference_size(a, b))
    assert tuple(row) == ([3], [1, 2, 3, 5, 6], [1, 2, 5, 6], 0.2, 5, 4)
    none = arr([], "int")
    assert math.isnan(one(spark, P.jaccard(none, none))[0])
    assert one(spark, P.union(arr([0, 1], "int"), arr([5], "int")))[0] == [0, 1, 5]
    assert tuple(one(spark, P.gaps(arr([2, 5, 9], "int")), P.from_gaps(arr([2, 3, 4], "int")), P.from_gaps(none))) == ([2, 3, 4], [2, 5, 9], [])
    assert one(spark, P.flatten_bands([arr([0], "int"), arr([1], "int"), arr([7, 9], "int")], 509))[0] == [0, 510, 1025, 1027]
    assert one(spark, P.as_set(F.array(F.lit(3), F.lit(None), F.lit(1), F.lit(3))), P.as_set(F.lit(None).cast("array<int>")))[:] == ([1, 3], [])


def test_cuts(spark):
    v = arr([100, 100] + [1] * 8)
    assert tuple(one(spark, A.elbow_count(v), A.prune_count(v), A.prune_threshold(v))) == (2, 2, 1.0)
    w = arr([1, 1, 1, 1])
    assert tuple(one(spark, A.entropy_count(w), A.median_count(w), A.elbow_count(w), A.prune_count(w), A.prune_threshold(w))) == (4, 4, 4, 4, 0.0)
    assert tuple(one(spark, A.gap_count(arr([100, 100, 1, 1])), A.gap_count(arr([5, 5, 0, 0])), A.gap_count(arr([3])), A.gap_count(arr([])))) == (2, 2, 1, 0)
    none = arr([])
    assert tuple(one(spark, A.entropy_count(none), A.elbow_count(none), A.median_count(none), A.prune_count(none))) == (0, 0, 0, 0)


def cut_spec(v):
    n = len(v)
    if n >= 3 and v[0] - v[-1] > 1e-12:
        med = v[n // 2] if n % 2 else 0.5 * (v[n // 2 - 1] + v[n // 2])
        depth = [v[0] + i / (n - 1) * (v[-1] - v[0]) - v[i] if 0 < i < n - 1 else 0 for i in range(n)]
        if max(depth) > 0 and max(depth) >= 0.01 * med:
            return depth.index(max(depth))
    total = sum(v)
    if total <= 0:
        return n
    cum, mm = 0.0, n
    for i, x in enumerate(v):
        cum += x
        if cum >= total / 2:
            mm = i + 1
            break
    return max(1, min(math.ceil(2.2 * mm), n))


def test_grouped_cuts_agree(spark):
    rng = random.Random(3)
    groups = {g: sorted((rng.choice((1, 1, 2, 3, 5, 50, 99)) for _ in range(rng.randint(1, 12))), reverse=True) for g in range(60)}
    rows = spark.createDataFrame([(g, i + 1, float(x)) for g, v in groups.items() for i, x in enumerate(v)], "g int, r int, v double")
    grouped = {r["g"]: r["k"] for r in A.grouped_cuts(rows, ["g"], "v").collect()}
    arrays = {r["g"]: r["k"] for r in rows.groupBy("g").agg(F.sort_array(F.collect_list("v"), False).alias("a")).select("g", A.prune_count(F.col("a")).alias("k")).collect()}
    assert grouped == arrays == {g: cut_spec(v) for g, v in groups.items()}


def test_ranges(spark):
    span = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"))
    clamp = one(spark, R.clamp(F.lit(-3), F.lit(0)))[0]
    assert (clamp["start"], clamp["end"]) == (0, 0)
    assert one(spark, R.overlap(span(0, 5), span(5, 9)))[0] is None
    assert tuple(one(spark, R.overlap(span(0, 6), span(5, 9)))[0]) == (5, 6)
    row = one(spark, R.overlaps(span(0, 6), span(5, 9)), R.contains(span(0, 9), span(0, 9)), R.extract(F.lit("abcdef"), span(1, 3)), R.to_json(span(1, 3)), R.to_string(span(1, 3)), R.title(F.lit("## 1. A ##"), span(0, 10), F.lit(6)))
    assert tuple(row) == (True, True, "bc", "[1,3]", "Segment [1, 3]", "A")


def test_overlapping_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 2), s, s + rng.randint(-1, 700)) for s in (rng.randint(0, 2000) for _ in range(60))]
    df = spark.createDataFrame(rows, "d int, start int, end int")
    got = sorted(map(tuple, R.overlapping(df, df, "d").collect()))
    ok = [r for r in rows if r[1] < r[2]]
    assert got == sorted((a[0], *a[1:], *b[1:]) for a in ok for b in ok if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2]))
