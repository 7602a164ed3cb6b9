"""The llm operators on the project's tables, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import cooccur, leaks, mixing, sentences, setjoin, termfreq, textform, truncation

Query = Callable[[SparkSession, str], DataFrame]
SETS = {"key": "rec_id", "apart": "doc_id", "sets": ["l", "c", "r"], "version": "loaded_at", "min_size": 24, "threshold": 0.8}
TOKENS = {"key": "tok_id", "record": "doc_id", "position": "tok_pos", "columns": ["tok_type", "tok_value"], "version": "loaded_at"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "seg_start", "seg_end")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(table(spark, d, "signatures"), **SETS).toDF("rec_id_a", "rec_id_b")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Each record's class of equal sets, and its number of pairs."""
    return setjoin.linked_records(table(spark, d, "signatures"), **SETS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.marked_values(table(spark, d, "tokens"), **TOKENS).where("mark is not null").select("tok_type", "tok_value", "mark")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.marked_values(table(spark, d, "tokens"), **TOKENS).select("tok_type", "tok_value", "occurrences", "records", "mark")


def p3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every run of up to three tokens, as text with its type in front of each token."""
    got = termfreq.value_counts(table(spark, d, "tokens"), most=3, **TOKENS)
    text = F.array_join(F.transform("gram", lambda x: F.concat(x["tok_type"].cast("string"), F.lit(":"), x["tok_value"])), "|")
    return got.select("n", text.alias("gram"), "occurrences", "records")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.tied_pairs(table(spark, d, "signatures").where("cur_word is not null and next_word is not null"), "rec_id", F.array("cur_word"), F.array("next_word"), "loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("tied").select(F.col("a").alias("cur_word"), F.col("b").alias("next_word"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("a").alias("cur_word"), F.col("b").alias("next_word"), "n", "n_a", "n_b", "tied")


def p5_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Parts that stand together in the own set of a record: unordered pairs of a basket."""
    t = table(spark, d, "signatures").where("c is not null")
    pairs, _ = cooccur.pair_counts(t, "rec_id", F.col("c"), F.col("c"), "loaded_at", ordered=False)
    return pairs.toDF("part_a", "part_b", "n", "n_a", "n_b")


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Each Word token once."""
    t = table(spark, d, "tokens").where(F.col("tok_id").isNotNull())
    return t.groupBy("tok_id").agg(F.max(F.struct("loaded_at", "doc_id", "tok_type", "tok_value")).alias("m")).select("tok_id", "m.*").where("tok_type = 0")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """The rows that look like a row with another string, by class."""
    lines = textform.look_alike_classes(table(spark, d, "small_corpus"), "line_id", "text")
    words = textform.look_alike_classes(_words(spark, d), "tok_id", "tok_value", "doc_id")
    return lines.toDF("id", *lines.columns[1:]).select(F.lit("small_corpus").alias("tab"), "*").union(words.select(F.lit("tokens").alias("tab"), "*"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines = textform.look_alikes(table(spark, d, "small_corpus"), "line_id", "text")
    words = textform.look_alikes(_words(spark, d), "tok_id", "tok_value", "doc_id")
    return lines.select(F.lit("small_corpus").alias("tab"), "*").union(words.select(F.lit("tokens").alias("tab"), "*"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", textform.consistent_form(F.col("text")).alias("form"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    got = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), words=12, errors=1)
    return got.where("distance = 0 and exact_words >= 12").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), words=12, errors=2)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_off(table(spark, d, "documents"))[0].where("cut").select(F.col("k").alias("doc_id"))


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_off(table(spark, d, "documents"))[1]


def queries() -> dict[str, Query]:
    found = (p1_found, p2_found, p2_links, p3_found, p3_values, p3_ngrams, p5_found, p5_pairs, p5_baskets, p6_found, p6_classes, p6_forms, p7_found, p7_near, p8_mix, p8_shares, p9_found, p9_sources)
    return {f.__name__: f for f in found}


ONE_TOKEN = "(select tok_id, arg_max(struct_pack(doc_id := doc_id, tok_type := tok_type, tok_value := tok_value), loaded_at) as m from tokens where tok_id is not null group by tok_id)"
VALUES = f"""
select m.tok_type as tok_type, m.tok_value as tok_value, count(*) as occurrences, count(distinct m.doc_id) as records,
  case when count(distinct m.doc_id) < 3 then 'rare'
       when count(distinct m.doc_id) > 0.5 * (select count(distinct doc_id) from tokens) then 'common' end as mark
from {ONE_TOKEN} where m.tok_value is not null and m.tok_type is not null group by 1, 2"""
ONE_RECORD = "(select rec_id, arg_max(struct_pack(a := cur_word, b := next_word), loaded_at) as m from signatures where rec_id is not null and cur_word is not null and next_word is not null group by rec_id)"
PAIRS = f"""
with r as (select m.a as a, m.b as b from {ONE_RECORD}), total as (select count(*) as total from r),
  p as (select a, b, count(*) as n from r group by 1, 2), x as (select a, count(*) as n_a from r group by 1), y as (select b, count(*) as n_b from r group by 1)
select a as cur_word, b as next_word, n, n_a, n_b, n >= 5 and n >= 0.002 * total and n * total >= 5 * n_a * n_b as tied
from p join x using (a) join y using (b), total"""


BASKETS = """
with r as (select list_distinct(arg_max(c, loaded_at)) as c from signatures where rec_id is not null and c is not null group by rec_id),
  e as (select row_number() over () as k, c from r where len(c) > 0), x as (select k, unnest(c) as i from e), one as (select i, count(*) as n from x group by 1)
select a.i as part_a, b.i as part_b, count(*) as n, any_value(u.n) as n_a, any_value(v.n) as n_b
from x a join x b on a.k = b.k and a.i < b.i join one u on u.i = a.i join one v on v.i = b.i group by 1, 2"""
GRAMS = f"""
with t as (select tok_id, m.doc_id as d, m.tok_pos as p, m.tok_type as ty, m.tok_value as v from {ONE_TOKEN.replace("struct_pack(", "struct_pack(tok_pos := tok_pos, ")}),
  w as (select d, case when ty is not null and v is not null then ty::varchar || ':' || v end as g,
    row_number() over (partition by d order by coalesce(p, 0), tok_id) as k from t),
  n as (select d, 1 as n, g as gram from w where g is not null
    union all select a.d, 2, a.g || '|' || b.g from w a join w b on a.d = b.d and b.k = a.k + 1 where a.g is not null and b.g is not null
    union all select a.d, 3, a.g || '|' || b.g || '|' || c.g from w a join w b on a.d = b.d and b.k = a.k + 1 join w c on c.d = a.d and c.k = a.k + 2 where a.g is not null and b.g is not null and c.g is not null)
select n::int as n, gram, count(*) as occurrences, count(distinct d) as records from n group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"select tok_type, tok_value, mark from ({VALUES}) where mark is not null",
        "p3_values": VALUES,
        "p3_ngrams": GRAMS,
        "p5_baskets": BASKETS,
        "p5_found": f"select cur_word, next_word from ({PAIRS}) where tied",
        "p5_pairs": PAIRS,
    }
