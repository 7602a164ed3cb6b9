"""Queries on heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import skew

FIELDS = {"cur_word": "next_word", "next_word": "cur_word"}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(spark.read.parquet(f"{d}/signatures.parquet"), "rec_id", list(FIELDS), "loaded_at", 0.02)


def p4_words(spark: SparkSession, d: str) -> DataFrame:
    got = skew.per_key(spark.read.parquet(f"{d}/signatures.parquet"), "rec_id", "doc_id", FIELDS, "loaded_at", 0.02)
    return got.select("field", "word_id", "records", "documents", "neighbours", "heavy")


def queries() -> dict:
    return {"p4_found": p4_found, "p4_words": p4_words}


ONE = "(select rec_id, arg_max(struct_pack(d := doc_id, a := cur_word, b := next_word), loaded_at) as m from signatures where rec_id is not null group by rec_id)"
FLAT = f"(select 'cur_word' as field, m.a as word_id, m.b as near, m.d as d from {ONE} where m.a is not null union all select 'next_word', m.b, m.a, m.d from {ONE} where m.b is not null)"
WORDS = f"""
select field, word_id, count(*) as records, count(distinct d) as documents, count(distinct near) as neighbours,
  count(*) >= 0.02 * any_value(total) as heavy
from {FLAT} join (select field, count(*) as total from {FLAT} group by 1) using (field) group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": f"select field, word_id from ({WORDS}) where heavy", "p4_words": WORDS}
