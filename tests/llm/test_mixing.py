from __future__ import annotations

import os

import pytest

from glyphmill.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.RANKS), reason="no tokenizer file")


def test_budgets():
    got = M.budgets({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "none": (0.2, 3)})
    assert got == {"a": 200, "b": 200}
    got = M.budgets({"a": 100, "b": 1000}, {"a": (0.5, 1), "b": (0.5, 1)}, 600)
    assert got == {"a": 100, "b": 500}
    assert M.budgets({}, {"a": (1, 1)}) == {}


def test_mix(spark):
    docs = [(k, "word " * (k % 7 + 1), [" A", "b", "b", "b", None, "other"][k % 6]) for k in range(3000)] + [(9999, None, "a"), (None, "x", "a"), (9998, "", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 2), ("B", 0.3, 3), ("gone", 0.2, 4)], "source string, target_share double, max_repeats int")
    for per_range in (10, 100_000):
        chosen, report = M.mix(d, t, per_range=per_range)
        r = {x["source"]: x for x in report.collect()}
        assert abs(r["a"]["share"] - 0.625) < 0.01 and abs(r["b"]["share"] - 0.375) < 0.01 and r["gone"]["share"] == 0
        rows = chosen.collect()
        assert max(x["repeats"] for x in rows if x["source"] == "a") <= 2 and len({x["doc_id"] for x in rows}) == len(rows)
        assert sum(x["tokens"] * x["repeats"] for x in rows if x["source"] == "a") == r["a"]["given"] == 2 * r["a"]["tokens"]
    chosen, report = M.mix(d, t, total=2000)
    assert abs(sum(x["given"] for x in report.collect()) - 2000) < 20
    assert M.mix(d.limit(0), t)[0].count() == 0
    assert M.mix(d, t.limit(0))[1].count() == 0
