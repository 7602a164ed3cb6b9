"""Operators that SQL cannot say, run on small inputs whose results are known; the SQL lists those results.

What goes in and what must come out is stated here as text.  The operators are those of the other queries, so a row that
differs tells of the operator and not of a copy of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import threshold as A
from ..functions.bytestr import END, START, WHOLE
from ..operators import decompose, dictionary, sections, segment, tokenize

GAP = "¦"  # between the values of a list

# Texts and their tokens.
TOKENS = {
    "2,4-d": "2,4-d", "5+5": "5¦+¦5", "U.S.A": "u.s.a", "-$5": "-$5", "a--b": "a¦--¦b", "mothers' day": "mothers'¦ ¦day",
    "a\n\nb": "a¦\n\n¦b", "a\nb": "a¦\n¦b", "a  b": "a¦\t¦b",
}
# Texts and their segments.
SEGMENTS = {
    "Hello. World": "Hello¦World", "Stop! Go": "Stop¦Go", "Yes? No": "Yes¦No", "First; Second": "First¦Second", "aa. B! C? d; e": "aa¦B¦C¦d¦e",
    ",Hello": "Hello", "Hello,": "Hello", ":Hello": "Hello", "Hello:": "Hello", "Hello, world": "Hello, world", "Key: value": "Key: value",
    "One sentence only": "One sentence only", "   hello": "hello", "hello   ": "hello", "  \n  \t  ": "", ".,;!?": "", "Hello  .  World": "Hello¦World",
    "Hello\nWorld": "Hello\nWorld", "Hello.\nWorld": "Hello¦World", "The value is 3.14 in this case": "The value is 3.14 in this case",
    "Pi equals 3.14. The next sentence follows": "Pi equals 3.14¦The next sentence follows", "Total was 1,234.56 dollars": "Total was 1,234.56 dollars",
    "Confidence is .95 in this trial": "Confidence is .95 in this trial", "She moved to the U.S.A. last year": "She moved to the U.S.A. last year", "Before\n---\nAfter": "Before¦After",
}
# A text and the nodes of its tree: type, depth, level, text.
TREE = "# Top\n\nIntro.\n\n## Sub\n\nBody."
NODES = (
    "section 0 1 # Top\n\nIntro.\n\n## Sub\n\nBody", "header 1 1 # Top", "section 1 - Intro", "segment 2 - Intro", "section 1 2 ## Sub\n\nBody", "header 2 2 ## Sub", "section 2 - Body", "segment 3 - Body",
)
OUTLINE = "Section [0, 27]\n  Header [0, 5]\n  Section [7, 12]\n    Segment [7, 12]\n  Section [15, 27]\n    Header [15, 21]\n    Section [23, 27]\n      Segment [23, 27]"
# A range and the ranges inside it.
INNER = {
    "alpha beta gamma delta epsilon": "alpha¦alpha beta gamma¦beta gamma delta¦gamma¦gamma delta¦gamma delta epsilon¦delta¦delta epsilon¦epsilon",
    "the and of": "",
}
# Lines and their ordered prefixes: levels, prefix, where the title begins.
NUMBERED = {"1.2 Title": "2 1.2 4", "(a) x": "1 (a) 4", "IV. Results": "1 IV. 4", "3) y": "1 3) 3", "2024 was": "", "A-1: z": "2 A-1: 5", "1 one": ""}
# Sequences and how many of their values the cuts keep: entropy, gap, elbow, median, prune, threshold.
CUTS = {
    (100.0, 100.0, *[1.0] * 8): (3, 2, 2, 5, 2, 1.0), (1.0, 1.0, 1.0, 1.0): (4, 4, 4, 4, 4, 0.0), (100.0, 100.0, 1.0, 1.0): (3, 2, 2, 4, 2, 1.0), (5.0, 5.0, 0.0, 0.0): (2, 2, 2, 3, 2, 0.0),
}
# Words, their parts by the dictionary of the, pep##, ##ers and the atoms, and the ranges left free.
PARTS = ((WHOLE, "the"), (START, "pep"), (END, "ers"))
WORDS = {"the": ("whole:the", ""), "peppers": ("start:pep letter:##p## end:ers", "3-4"), "pep": ("start:pep", ""), "ox": ("letter:o## letter:##x", "0-2"), "9": ("whole:9", "")}
STOPS = {"the": True, "of": True, "using": True, "Theirs": True, "word": False, "": False}
ATOMS = {"whole:a": True, "whole:ab": False, "delim:-": True, "delim:--": False, "letter:a##": True, "start:a": False, "whole:$": True, "delim:a": False}


def _texts(s: SparkSession, texts: object) -> DataFrame:
    return s.createDataFrame([(t,) for t in texts], "text string")


def _joined(found: Column) -> Column:
    return F.array_join(found, GAP)


def golden_tokens(s: SparkSession, d: str) -> DataFrame:
    one = tokenize.byte_tokens(F.col("text"))
    return _texts(s, TOKENS).select("text", _joined(F.transform(one, lambda t: t["value"])).alias("found"))


def golden_segments(s: SparkSession, d: str) -> DataFrame:
    parts = F.transform(segment.segment_column(F.col("text")), lambda p: F.substring(F.col("text"), p["start"] + 1, p["end"] - p["start"]))
    return _texts(s, SEGMENTS).select("text", _joined(parts).alias("found"))


def _nodes(s: SparkSession) -> DataFrame:
    return sections.section_nodes(s.createDataFrame([(1, TREE)], "doc_id long, text string"))


def golden_tree(s: SparkSession, d: str) -> DataFrame:
    part = F.substring(F.lit(TREE), F.col("start") + 1, F.col("end") - F.col("start"))
    return _nodes(s).select("node_id", F.concat_ws(" ", "node_type", F.col("depth").cast("string"), F.coalesce(F.col("level").cast("string"), F.lit("-")), part).alias("node"))


def golden_outline(s: SparkSession, d: str) -> DataFrame:
    return sections.outlines(_nodes(s))


def golden_inner(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, INNER).select("text", F.lit(0).alias("start"), F.length("text").alias("end"))
    got = segment.subsegments_of(t, ["text"]).select("text", F.struct("sub_idx", F.expr("substring(text, start + 1, `end` - start)").alias("part")).alias("p"))
    got = got.groupBy("text").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return t.select("text").join(got, "text", "left").select("text", F.coalesce(_joined(F.transform("p", lambda p: p["part"])), F.lit("")).alias("found"))


def golden_numberings(s: SparkSession, d: str) -> DataFrame:
    n = segment.numbering_column(F.col("text"))
    return _texts(s, NUMBERED).select("text", F.concat_ws(" ", n["level"].cast("string"), n["prefix"], n["title_offset"].cast("string")).alias("found"))


def golden_cuts(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([(k, list(v)) for k, v in enumerate(CUTS)], "row int, v array<double>")
    v = F.col("v")
    return t.select("row", A.entropy_count(v).alias("entropy"), A.gap_count(v).alias("gap"), A.elbow_count(v).alias("elbow"), A.median_count(v).alias("median"), A.prune_count(v).alias("prune"), A.prune_threshold(v).alias("threshold"))


def golden_words(s: SparkSession, d: str) -> DataFrame:
    """Words taken apart, and their free ranges."""
    parts = dictionary.frame(s, dictionary.with_atoms(list(PARTS)))
    words = s.createDataFrame([(w,) for w in WORDS], "word string")
    name = F.concat_ws(":", "name", "value")
    named = parts.select("part_id", F.element_at(F.array(*map(F.lit, ("start", "end", "mid", "letter", "whole", "delim"))), F.col("kind") + 1).alias("name"), "value").select("part_id", name.alias("name"))
    each = decompose.decompose(words, parts).select("word", F.posexplode("part_ids").alias("i", "part_id")).join(named, "part_id")
    found = each.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("n")).select("word", F.array_join(F.transform("n", lambda x: x["name"]), " ").alias("parts"))
    free = decompose.free_runs(words, parts).groupBy("word").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))), " ").alias("free"))
    return found.join(free, "word", "left").select("word", "parts", F.coalesce("free", F.lit("")).alias("free"))


def golden_stops(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, STOPS).select("text", F.lower("text").isin(*sorted(segment.STOP_WORDS)).alias("stop"))


def golden_atoms(s: SparkSession, d: str) -> DataFrame:
    kinds = {"start": 0, "end": 1, "mid": 2, "letter": 3, "whole": 4, "delim": 5}
    rows = [(t, kinds[t.split(":", 1)[0]], t.split(":", 1)[1]) for t in ATOMS]
    t = s.createDataFrame(rows, "part string, kind int, value string")
    return t.select("part", dictionary.atom_column(F.col("kind"), F.col("value")).alias("atom"))


def _sql(columns: str, rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x).lower() if isinstance(x, bool) else f"{x}::{'double' if isinstance(x, float) else 'int'}"

    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({columns})"


def queries() -> dict:
    found = (golden_tokens, golden_segments, golden_tree, golden_outline, golden_inner, golden_numberings, golden_cuts, golden_words, golden_stops, golden_atoms)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "golden_tokens": _sql("text, found", list(TOKENS.items())), "golden_segments": _sql("text, found", list(SEGMENTS.items())), "golden_tree": _sql("node_id, node", list(enumerate(NODES))),
        "golden_outline": "select 1::bigint as doc_id, '" + OUTLINE + "' as outline", "golden_inner": _sql("text, found", list(INNER.items())), "golden_numberings": _sql("text, found", list(NUMBERED.items())),
        "golden_cuts": _sql('"row", entropy, gap, elbow, median, prune, threshold', [(k, *v) for k, v in enumerate(CUTS.values())]),
        "golden_words": _sql("word, parts, free", [(w, *v) for w, v in WORDS.items()]), "golden_stops": _sql("text, stop", list(STOPS.items())), "golden_atoms": _sql("part, atom", list(ATOMS.items())),
    }
