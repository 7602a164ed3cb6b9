"""Results per key when a few keys hold most rows.

Every task first folds its own rows into one mergeable state for each key (Spark's partial hash aggregation, which
spills when its table is full), so a key that holds a third of all rows sends one small row from each task.  Distinct
counts are made in two steps on a finer key, (key, value) and then key, which spreads a heavy key over all tasks; no
step gathers a key's rows in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, key: str, columns: list[str], version: str | None = None) -> DataFrame:
    """One row for each key, of the key and the columns: that of the greatest version, else the largest. Null keys are left out."""
    v = F.col(version) if version else F.lit(0)
    picked = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.struct(v.alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("__r"))
    got = picked.groupBy("__k").agg(F.max("__r").alias("__r"))
    return got.select(F.col("__k").alias(key), *[F.col(f"__r.c{i}").alias(c) for i, c in enumerate(columns)])


def per_key(rows: DataFrame, key: str, document: str, fields: dict[str, str], version: str | None = None, heavy: float = 0.02) -> DataFrame:
    """Rows (field, word_id, records, documents, neighbours, share, heavy) for every value of every field.

    fields: each field's column and the column of its neighbour. records are rows with that value, each key once;
    documents and neighbours are numbers of distinct non-null values. share is of the rows whose field is not null,
    and heavy tells that it reaches the given share. Rows with a null key or a null field are left out of that field.
    An empty table gives no rows. Other columns are ignored.
    """
    names = list(dict.fromkeys([*fields, *fields.values()]))
    one = once(rows, key, [document, *names], version).toDF("k", "d", *[f"f{i}" for i in range(len(names))])
    at = {c: f"f{i}" for i, c in enumerate(names)}
    # stack() needs one type; fields of a call share it
    parts = ", ".join(f"'{f}', {at[f]}, {at[n]}" for f, n in fields.items())
    flat = one.selectExpr("d", f"stack({len(fields)}, {parts}) as (field, word_id, near)").where("word_id is not null")
    by_doc = flat.groupBy("field", "word_id", "d").agg(F.count(F.lit(1)).alias("n"))
    by_doc = by_doc.groupBy("field", "word_id").agg(F.sum("n").alias("records"), F.count("d").alias("documents"))
    by_near = flat.where("near is not null").select("field", "word_id", "near").distinct().groupBy("field", "word_id").agg(F.count(F.lit(1)).alias("neighbours"))
    total = by_doc.groupBy("field").agg(F.sum("records").alias("total"))
    out = by_doc.join(by_near, ["field", "word_id"], "left").join(total, "field")
    share = F.col("records") / F.col("total")
    return out.select("field", "word_id", "records", "documents", F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"), share.alias("share"), (F.col("records") >= heavy * F.col("total")).alias("heavy"))


def heavy_keys(rows: DataFrame, key: str, fields: list[str], version: str | None = None, heavy: float = 0.02) -> DataFrame:
    """Rows (field, word_id) of the values that hold at least the given share of the rows whose field is not null."""
    one = once(rows, key, fields, version).toDF("k", *[f"f{i}" for i in range(len(fields))])
    parts = ", ".join(f"'{f}', f{i}" for i, f in enumerate(fields))
    flat = one.selectExpr(f"stack({len(fields)}, {parts}) as (field, word_id)").where("word_id is not null")
    counts = flat.groupBy("field", "word_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("field").agg(F.sum("n").alias("total"))
    return counts.join(total, "field").where(F.col("n") >= heavy * F.col("total")).select("field", "word_id")
