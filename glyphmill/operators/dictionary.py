"""The dictionary of word parts: rows (part_id int, kind int, value string), ids dense from 0 in the order of adding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestr import DELIMITER, END, LETTER, MID, START, WHOLE, kind_name
from .ordering import placed

SCHEMA = "part_id int, kind int, value string"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
CONNECTORS = "-'&,.$"  # fixed values: marks that may stand inside a word
SHORTEST, LONGEST = 2, 7  # fixed values: lengths of the parts of a word

Part = tuple[int, str]


def atoms() -> list[Part]:
    """Single characters as whole words, as letters by position, and the connectors as delimiters."""
    marks = LETTERS + CONNECTORS
    return [*((WHOLE, c) for c in marks), *((LETTER, form) for c in marks for form in (f"{c}##", f"##{c}##", f"##{c}")), *((DELIMITER, c) for c in CONNECTORS)]


def is_atom(kind: int, value: str) -> bool:
    return kind == LETTER or (len(value) == 1 and ((kind == WHOLE and value in LETTERS + CONNECTORS) or (kind == DELIMITER and value in CONNECTORS)))


def numbered(parts: list[Part]) -> list[tuple[int, int, str]]:
    """Parts in order, each once, with ids."""
    return [(i, k, v) for i, (k, v) in enumerate(dict.fromkeys(parts))]


def frame(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """A dictionary of the parts in order; repeats keep their first id."""
    return spark.createDataFrame(numbered(parts), SCHEMA)


def parts_of(dictionary: DataFrame, most: int = 1_000_000) -> list[Part]:
    """The parts in order of their ids, on the driver; a dictionary of more than `most` parts is refused."""
    rows = dictionary.orderBy("part_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dictionary has more than {most} parts")
    return [(r["kind"], r["value"]) for r in rows]


def add(dictionary: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The dictionary with the new (kind, value) rows it lacks; they get the next ids in the given order."""
    fresh = new.join(dictionary.select("kind", "value"), ["kind", "value"], "left_anti")
    first = fresh.groupBy("kind", "value").agg(F.min(F.struct(*order)).alias("__o"))
    size = dictionary.agg(F.coalesce(F.max("part_id") + 1, F.lit(0))).scalar()
    ids = placed(first, [], [F.asc("__o"), F.asc("kind"), F.asc("value")])
    return dictionary.select("part_id", "kind", "value").unionByName(ids.select((size + F.col("place")).cast("int").alias("part_id"), "kind", "value"))


def lookup(rows: DataFrame, dictionary: DataFrame, out: str = "part_id") -> DataFrame:
    """The rows (with kind and value) and the id of each, null where there is none."""
    return rows.join(dictionary.select("kind", "value", F.col("part_id").alias(out)), ["kind", "value"], "left")


def at(rows: DataFrame, dictionary: DataFrame, id_: str = "part_id") -> DataFrame:
    """The rows and the kind and value of each id, null where there is none."""
    return rows.join(dictionary.select(F.col("part_id").alias(id_), "kind", "value"), id_, "left")


def has(rows: DataFrame, dictionary: DataFrame, kind: int, value: str = "value") -> DataFrame:
    """Those rows whose value is a part of that kind."""
    return rows.join(dictionary.where(F.col("kind") == kind).select(F.col("value").alias(value)), value, "left_semi")


def counts(dictionary: DataFrame) -> DataFrame:
    """Rows (kind, name, n)."""
    return dictionary.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", kind_name(F.col("kind")).alias("name"), "n")


def with_atoms(parts: list[Part]) -> list[Part]:
    return list(dict.fromkeys([*parts, *atoms()]))


def atom_column(kind: Column, value: Column) -> Column:
    """is_atom() as a column."""
    one = F.length(value) == 1
    mark = value.isin(*CONNECTORS)
    return (kind == LETTER) | (one & (((kind == WHOLE) & (value.isin(*LETTERS) | mark)) | ((kind == DELIMITER) & mark)))


def listed_column(kind: Column, value: Column) -> Column:
    """listed_value() as a column."""
    before = F.when(kind.isin(END, MID), "##").otherwise("")
    after = F.when(kind.isin(START, MID), "##").otherwise("")
    return F.concat(before, value, after)


def listed_value(kind: int, value: str) -> str:
    """How a part of a word is written, ## where the word goes on."""
    return {START: f"{value}##", MID: f"##{value}##", END: f"##{value}"}.get(kind, value)
