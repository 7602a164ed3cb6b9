from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphmill.plans import golden_queries, registry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
QUICK = ("kind_names", "part_counts", "part_lookup", "cuts", "entropy_and_gap", "value_ranks", "pruned_values", "sparse_sets", "sparse_counts", "flat_signatures", "id_gaps", "next_words", "word_signatures", "near_signatures", "segment_headers", "segment_owners", "overlapping_segments", "p4_words", "signature_files", "sql_strings", "sql_functions", *golden_queries.queries())


def same(spark, name, folder=SMALL):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    got = registry.queries()[name](spark, folder).toArrow()
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.column_names)
    assert columns == sorted(want.columns)
    rows = sorted(zip(*[map(str, got[c].to_pylist()) for c in columns], strict=True))
    table = want.to_arrow_table()
    assert rows == sorted(zip(*[map(str, table[c].to_pylist()) for c in columns], strict=True))


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    same(spark, name)


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_stream(spark):
    same(spark, "streamed_words")


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"p4_found", "top_words"} <= set(registry.queries())
