"""Words into parts.

Every distinct word is enumerated once: its prefixes, suffixes and inner windows are joined with the dictionary, the
hits are put in the order of their ids, and a fold over them claims ranges of the word greedily.  What stays free is
filled with letters.  All of it is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytestr import DELIMITER, END, LETTER, MID, START, WHOLE, kind_name
from .dictionary import LONGEST, SHORTEST

STATE = "struct<taken:array<struct<pos:int,len:int,id:int>>,start:boolean,end:boolean>"


def candidates(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (word, id, pos, len, kind): every part of the dictionary that stands somewhere in the word."""
    n = F.length("word")
    lengths = F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda size: size <= n)

    def windows(size: Column) -> Column:
        piece = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), size.alias("len"), F.substring(F.col("word"), pos + 1, size).alias("value"))
        inner = F.transform(F.sequence(F.lit(0), n - size), lambda pos: piece(MID, pos))
        return F.concat(F.array(piece(START, F.lit(0)), piece(END, n - size)), inner)

    each = words.where(n >= SHORTEST).select("word", F.explode(F.flatten(F.transform(lengths, windows))).alias("c")).select("word", "c.*")
    return each.join(dictionary.select("kind", "value", F.col("part_id").alias("id")), ["kind", "value"]).select("word", "id", "pos", "len", "kind")


def _claim(found: Column) -> Column:
    """Folds candidates, in order, into the ranges they claim."""
    zero = F.struct(F.array().cast("array<struct<pos:int,len:int,id:int>>").alias("taken"), F.lit(False).alias("start"), F.lit(False).alias("end"))

    def step(s: Column, c: Column) -> Column:
        clash = F.exists(s["taken"], lambda t: (t["pos"] < c["pos"] + c["len"]) & (c["pos"] < t["pos"] + t["len"]))
        skip = clash | ((c["kind"] == START) & s["start"]) | ((c["kind"] == END) & s["end"])
        new = F.struct(F.array_append(s["taken"], F.struct(c["pos"].alias("pos"), c["len"].alias("len"), c["id"].alias("id"))).alias("taken"), (s["start"] | (c["kind"] == START)).alias("start"), (s["end"] | (c["kind"] == END)).alias("end"))
        return F.when(skip, s).otherwise(new)

    return F.aggregate(found, zero.cast(STATE), step)


def claims(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (word, whole, taken, start, end) of distinct words: the id if the word is a part itself, else its claims."""
    words = words.select("word").where("word <> ''").distinct()
    wholes = dictionary.where(F.col("kind") == WHOLE).select(F.col("value").alias("word"), F.col("part_id").alias("whole"))
    known = words.join(wholes, "word", "left")
    found = candidates(known.where("whole is null").select("word"), dictionary)
    ordered = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("id", "pos", "len", "kind"))).alias("c"))
    out = known.join(ordered, "word", "left")
    none = F.array().cast("array<struct<id:int,pos:int,len:int,kind:int>>")
    return out.withColumn("s", _claim(F.coalesce("c", none))).select("word", "whole", F.col("s.taken").alias("taken"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def _free(pos: Column) -> Column:
    return ~F.exists("taken", lambda t: (t["pos"] <= pos) & (pos < t["pos"] + t["len"]))


def decompose(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (word, part_ids, bag): the parts of each distinct word in their order, and the sorted set of them.

    A letter that the dictionary has no part for is left out. Null and empty words give no row.
    """
    got = claims(words, dictionary)
    n = F.length("word")

    def letter(pos: Column) -> Column:
        c = F.substring(F.col("word"), pos + 1, F.lit(1))
        first, last = (pos == 0) & ~F.col("start"), (pos == n - 1) & ~F.col("end")
        form = F.when(last & ~first, F.concat(F.lit("##"), c)).when(~first & ~last, F.concat(F.lit("##"), c, F.lit("##"))).otherwise(F.concat(c, F.lit("##")))
        return F.struct(pos.cast("int").alias("pos"), form.alias("form"))

    open_ = F.filter(F.sequence(F.lit(0), n - 1), _free)
    letters = got.where("whole is null").select("word", F.explode(F.transform(open_, letter)).alias("l")).select("word", "l.pos", F.col("l.form").alias("value"))
    letters = letters.join(dictionary.where(F.col("kind") == LETTER).select("value", F.col("part_id").alias("id")), "value").select("word", F.struct("pos", "id").alias("p"))
    taken = got.where("whole is null").select("word", F.explode("taken").alias("t")).select("word", F.struct("t.pos", "t.id").alias("p"))
    parts = letters.union(taken).groupBy("word").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["id"]).alias("ids"))
    empty = F.array().cast("array<int>")
    ids = F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.coalesce("ids", empty))
    return got.select("word", "whole").join(parts, "word", "left").select("word", ids.alias("part_ids")).withColumn("bag", F.array_sort(F.array_distinct("part_ids")))


def free_runs(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (word, start, end, touches_start, touches_end): the maximal ranges of a word that no part claims."""
    got = claims(words, dictionary).where("whole is null")
    n = F.length("word")
    edges = F.array_sort(F.transform("taken", lambda t: F.struct(t["pos"].alias("s"), (t["pos"] + t["len"]).alias("e"))))
    ends = F.concat(F.array(F.lit(0)), F.transform(edges, lambda t: t["e"]))
    starts = F.concat(F.transform(edges, lambda t: t["s"]), F.array(n))
    gaps = F.filter(F.arrays_zip(ends.alias("s"), starts.alias("e")), lambda g: g["s"] < g["e"])
    runs = got.select("word", F.explode(gaps).alias("g"))
    return runs.select("word", F.col("g.s").alias("start"), F.col("g.e").alias("end"), (F.col("g.s") == 0).alias("touches_start"), (F.col("g.e") == n).alias("touches_end"))


def decompose_delimiters(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (value, part_ids) of distinct delimiters: one part, or one for each character that has one."""
    values = values.select("value").where("value <> ''").distinct()
    known = dictionary.where(F.col("kind") == DELIMITER).select("value", F.col("part_id").alias("id"))
    whole = values.join(known, "value", "left")
    chars = whole.where("id is null").select(F.col("value").alias("v"), F.posexplode(F.split("value", "")).alias("pos", "value"))
    single = chars.join(known, "value").groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda p: p["id"]).alias("ids"))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(F.coalesce("ids", F.array().cast("array<int>")))
    return whole.join(single, F.col("value") == F.col("v"), "left").select("value", ids.alias("part_ids"))


def token_parts(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The tokens (key, pos, type, value) with their part_ids; each distinct value is decomposed once."""
    word = tokens.where("type = 0")
    words = decompose(word.select(F.col("value").alias("word")), dictionary).select(F.lit(0).cast("tinyint").alias("type"), F.col("word").alias("value"), "part_ids")
    marks = decompose_delimiters(tokens.where("type = 1"), dictionary).select(F.lit(1).cast("tinyint").alias("type"), "value", "part_ids")
    return tokens.join(words.union(marks), ["type", "value"], "left")


def listing(rows: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, line): a token as 'label "value" -> [ids] kind:value ...', in the way a person reads it."""
    each = rows.select(key, "pos", "type", "value", "part_ids", F.posexplode_outer("part_ids").alias("i", "part_id"))
    named = each.join(dictionary.select("part_id", F.concat_ws(":", kind_name(F.col("kind")), "value").alias("name")), "part_id", "left")
    got = named.groupBy(key, "pos", "type", "value", "part_ids").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("n"))
    label = F.when(F.col("type") == 0, "word").otherwise("delim")
    names = F.array_join(F.transform("n", lambda x: x["name"]), " ")
    return got.select(key, "pos", F.concat(label, F.lit(' "'), "value", F.lit('" -> ['), F.array_join(F.col("part_ids").cast("array<string>"), ","), F.lit("] "), names).alias("line"))
