"""Structural segments of a text, its headers, and the ranges inside a segment.

Dots that do not end a sentence are masked in place, so the masked text has the same offsets as the text itself.  One
Arrow call handles a batch of whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space and word characters as the patterns mean them, whatever the engine.
WS = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_W = "A-Za-z0-9_"
_B = f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
# What keeps its dots, tried in this order.
PROTECTED = tuple(
    re.compile(p, f)
    for p, f in (
        (rf"{_B}(?:https?|ftp)://[^{WS}]+|{_B}www\.[^{WS}]+", re.I),  # addresses on the web
        (rf"{_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_B}", 0),  # mail
        (rf"{_B}(?:[A-Za-z]\.){{2,}}", 0),  # initials
        (rf"{_B}(?:[A-Za-z]+|[0-9]+)(?:\.(?:[A-Za-z]+|[0-9]+)){{2,}}{_B}", 0),  # numbering of several levels
        (rf"{_B}[0-9]{{1,3}}(?:,[0-9]{{3}})+\.[0-9]+{_B}|{_B}[0-9]+\.[0-9]+{_B}|(?<![{_W}])\.[0-9]+{_B}", 0),  # decimals
        (rf"{_B}[{_W}-]+(?:\.[A-Za-z0-9]{{1,8}}){{1,2}}{_B}", 0),  # file names
        (rf"(?:^|\n)[{WS}]*(?:[0-9]+|[A-Za-z]|[ivxlcdmIVXLCDM]+)\.(?=[{WS}])", 0),  # numbering at a line's start
        (rf"{_B}(?:Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|Mt|Fig|Eq|Ref|Vol|No|pp|p|vs|etc|cf|al|approx|Inc|Ltd|Co|Corp)\.|{_B}(?:e\.g|i\.e|et[{WS}]al)\.", 0),  # abbreviations
    )
)
# One token of a numbering, what parts two of them, what comes before and after.
_TOKEN = r"(?:[0-9]+|[IVXLCDM]{2,7}|[ivxlcdm]{2,7}|[A-Za-z])"
_PART = rf"[.)\-/:](?![{WS}]*[.)\-/:])[{WS}]*"
NUMBERING = re.compile(rf"(?P<prefix>[{WS}]*[(§]?[{WS}]*(?P<body>(?:{_TOKEN}{_PART})+(?:{_TOKEN})?)[{WS}]*[.):]?)[{WS}]+")
_COUNTED = re.compile(rf"{_TOKEN}(?=[.)\-/:{WS}]|$)")
# Words too common to stand for a range.
STOP_WORDS = frozenset(
    "and or but nor yet so although if then else which that because however therefore thus this these those they them their "
    "theirs it its itself when where while after before some such more most many other another of in on to for by as at is are "
    "was were be been being a an the between among across through within against during despite under over into onto upon "
    "from with without use uses used using have has had having make makes made making take takes took taking give gives gave "
    "giving".split()
)
BLANK = "\t\n\x0b\x0c\r "
BLANKS = re.compile(f"[{BLANK}]*")
STOPS = re.compile(r"[\n\x0b\x0c\r!.;?]")
TRIM = BLANK + "!,.:;?"
RULE = re.compile(r"([*+\-=_~])\1{2,}")


@dataclass
class Piece:
    """A range of a text and how it came about; a header has a level."""

    start: int
    end: int
    blank_before: bool = False
    stop_before: bool = False
    rule_before: bool = False
    newline: bool = False
    level: int | None = None
    title_offset: int | None = None


def masked(text: str) -> str:
    """The text with what must not be split written over by zeros; the same length."""
    for pattern in PROTECTED:
        text = pattern.sub(lambda m: (lead := re.match(rf"[{WS}]*", m.group()).group()) + "\x00" * (len(m.group()) - len(lead)), text)
    return text


def numbering(text: str) -> tuple[int, str, int] | None:
    """Levels, prefix and length of an ordered prefix such as '1.2 ' or '(a) ', if the text has one."""
    m = NUMBERING.match(text)
    levels = len(_COUNTED.findall(m["body"].rstrip(".):"))) if m else 0
    return (levels, re.sub(rf"[{WS}]+$", "", m["prefix"]), m.end()) if levels else None


def pieces(text: str, headers: bool = False) -> list[Piece]:
    """The segments of a text."""
    hidden = masked(text)
    left = len(hidden) - len(hidden.lstrip(TRIM))
    right = len(hidden.rstrip(TRIM))
    if left >= right:
        return []
    out: list[Piece] = []
    rule = False  # the piece before is a rule line
    last = 0  # where the piece before ends
    at = left
    for stop in [*(m.start() for m in STOPS.finditer(hidden, left, right)), right]:
        body = hidden[at:stop] if stop == right else hidden[at:stop].rstrip(BLANK)
        s, e = at, at + len(body)
        at = BLANKS.match(hidden, min(stop + 1, right), right).end()
        if not body:
            continue
        if RULE.fullmatch(body):
            rule, last = True, e
            continue
        gap = hidden[min(last, s) : s]
        if rule:
            out.append(Piece(s, e, rule_before=True))
        elif not out:
            out.append(Piece(s, e))
        else:
            blank, stopped = gap.count("\n") > 1, any(c > " " for c in gap)
            if blank or stopped:
                out.append(Piece(s, e, blank_before=blank, stop_before=stopped))
            else:
                out[-1].end, out[-1].newline = e, True
        rule, last = False, e
    if headers:
        mark_headers(out, text)
    return out


def mark_headers(parts: list[Piece], text: str) -> None:
    """Sets the level of pieces that stand alone between breaks and begin with # or an ordered prefix."""
    for i, p in enumerate(parts):
        after = i + 1 == len(parts) or parts[i + 1].blank_before or parts[i + 1].rule_before
        if p.newline or not after or not (i == 0 or p.blank_before or p.rule_before):
            continue
        line = text[p.start : p.end]
        marks = len(line) - len(line.lstrip("#"))
        skip = marks
        while marks and skip < len(line) and line[skip] <= " ":
            skip += 1
        order = numbering(line[skip:])
        if marks:
            p.level, p.title_offset = marks, skip + (order[2] if order else 0)
        elif order:
            p.level, p.title_offset = order[0], order[2]
        if p.title_offset is not None:
            p.title_offset = min(p.title_offset, p.end - p.start)


@dataclass
class Inner:
    """A range inside a segment; tier 0 and 1 are clauses, 2 is words."""

    start: int
    end: int
    tier: int
    stop_word: bool = True
    comma_before: bool = False


def _split(text: str, s: int, e: int, marks: str, below: int, tier: int) -> list[Inner]:
    """Ranges between the marks; what is below the code point counts as blank beside one. Nothing if there is no mark."""
    eats = lambda c: c in marks or ord(c) < below
    out, at, i = [], s, s
    while i < e:
        if text[i] not in marks:
            i += 1
            continue
        z = i
        while z > 0 and eats(text[z - 1]):
            z -= 1
        if z > at:
            out.append(Inner(at, z, tier))
        while i < e and eats(text[i]):
            i += 1
        at = i
    if out and at < e:
        out.append(Inner(at, e, tier))
    return out


def _words(text: str, s: int, e: int) -> list[Inner]:
    out, comma = [], False
    for m in re.finditer("[^\x00- ,—]+|[\x00- ,—]+", text[s:e]):
        run = m.group()
        if run[0] > " " and run[0] not in ",—":
            out.append(Inner(s + m.start(), s + m.end(), 2, run.lower() in STOP_WORDS, comma))
            comma = False
        else:
            comma = "," in run or "—" in run
    return out


def inner_ranges(text: str, s: int, e: int) -> list[Inner]:
    """Clauses, parts of clauses, and notable words, pairs and triplets of a segment."""
    hard = _split(text, s, e, ":;", 34, 0)
    soft = [x for c in (hard or [Inner(s, e, 0)]) for x in _split(text, c.start, c.end, '"(),:;[]', 35, 1)]
    out = hard + soft
    for source in soft or hard or [Inner(s, e, 0)]:
        ws = _words(text, source.start, source.end)
        long = lambda w: w.end - w.start > 4
        for i, w in enumerate(ws):
            if w.stop_word:
                continue
            two = ws[i + 1] if i + 1 < len(ws) else None
            three = ws[i + 2] if i + 2 < len(ws) else None
            if long(w):
                out.append(Inner(w.start, w.end, 2))
                if two and long(two) and not two.stop_word and not two.comma_before:
                    out.append(Inner(w.start, two.end, 2))
            if three and not three.stop_word and not two.comma_before and not three.comma_before:
                out.append(Inner(w.start, three.end, 2))
    return out


SEGMENT = "struct<start:int,end:int,has_blank_line_before:boolean,has_delim_before:boolean,has_delim_line_before:boolean,has_newline:boolean,level:int,title_offset:int>"
_NAMES = ("start", "end", "has_blank_line_before", "has_delim_before", "has_delim_line_before", "has_newline", "level", "title_offset")


def _arrow(rows: list, names: tuple[str, ...], kinds: list[pa.DataType]) -> pa.Array:
    """Lists of tuples, or nulls, as a list array of structs."""
    flat = [t for r in rows if r for t in r]
    cols = list(zip(*flat, strict=True)) if flat else [()] * len(names)
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
    offsets, at = [], 0
    for r in rows:
        offsets.append(None if r is None else at)
        at += len(r or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def segment_column(text: Column, headers: bool = False) -> Column:
    """Array of the segments of a text; null for null, empty for a text of blanks and stops."""

    @F.arrow_udf(f"array<{SEGMENT}>")
    def run(a: pa.Array) -> pa.Array:
        rows = [None if t is None else [(p.start, p.end, p.blank_before, p.stop_before, p.rule_before, p.newline, p.level, p.title_offset) for p in pieces(t, headers)] for t in a.to_pylist()]
        i, b = pa.int32(), pa.bool_()
        return _arrow(rows, _NAMES, [i, i, b, b, b, b, i, i])

    return run(text)


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", headers: bool = False) -> DataFrame:
    """Rows (key, seg_idx, start, end, four flags, level, title_offset), a row for each segment of each text."""
    found = docs.select(key, F.posexplode(segment_column(F.col(text), headers)).alias("seg_idx", "s"))
    return found.select(key, "seg_idx", "s.*")


def with_headers(rows: DataFrame, levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments without levels, and (key, seg_idx, level, title_offset) of those whose text could be a header: a segment
    is one if it stands alone between breaks. The neighbours are found by a window over each document."""
    w = Window.partitionBy(key).orderBy("seg_idx")
    first = F.lag("seg_idx").over(w).isNull()
    last = F.lead("seg_idx").over(w).isNull()
    after = last | F.lead("has_blank_line_before").over(w) | F.lead("has_delim_line_before").over(w)
    alone = (first | F.col("has_blank_line_before") | F.col("has_delim_line_before")) & ~F.col("has_newline") & after
    got = rows.drop("level", "title_offset").withColumn("__alone", alone).join(levels, [key, "seg_idx"], "left")
    return got.withColumn("level", F.when(F.col("__alone"), F.col("level"))).withColumn("title_offset", F.when(F.col("__alone"), F.col("title_offset"))).drop("__alone")


INNER = "struct<start:int,end:int,tier:int>"


def subsegments(docs: DataFrame, key: str = "doc_id", text: str = "text", headers: bool = False, original: bool = False) -> DataFrame:
    """Rows (key, seg_idx, sub_idx, start, end, tier) of the ranges inside each segment.

    original also gives each segment itself, with tier -1 and first in its order. A segment that cannot be divided
    has only that row.
    """

    @F.arrow_udf(f"array<struct<seg_idx:int,sub_idx:int,{INNER[7:]}>")
    def run(a: pa.Array) -> pa.Array:
        rows = []
        for t in a.to_pylist():
            row = None if t is None else []
            for i, p in enumerate(pieces(t, headers) if t else ()):
                found = [(x.start, x.end, x.tier) for x in inner_ranges(t, p.start, p.end)]
                row += [(i, j, *x) for j, x in enumerate(([(p.start, p.end, -1)] if original else []) + found)]
            rows.append(row)
        return _arrow(rows, ("seg_idx", "sub_idx", "start", "end", "tier"), [pa.int32()] * 5)

    return docs.select(key, F.explode(run(F.col(text))).alias("s")).select(key, "s.*")


def subsegments_of(ranges: DataFrame, by: list[str], text: str = "text", start: str = "start", end: str = "end", original: bool = False) -> DataFrame:
    """Rows (by..., sub_idx, start, end, tier) of the ranges inside any ranges of texts: segments, sections, or others.

    ranges has the text itself and its range in columns; by names the columns that tell the rows apart. A null text or
    range, an empty or reversed one, gives nothing, and a range is cut at the text's ends. original also gives each
    range itself, with tier -1 and first.
    """

    @F.arrow_udf(f"array<struct<sub_idx:int,{INNER[7:]}>")
    def run(a: pa.Array, s: pa.Array, e: pa.Array) -> pa.Array:
        rows = []
        for t, x, z in zip(a.to_pylist(), s.to_pylist(), e.to_pylist(), strict=True):
            if t is None or x is None or z is None or (x := max(x, 0)) >= (z := min(z, len(t))):
                rows.append(None)
                continue
            found = [(i.start, i.end, i.tier) for i in inner_ranges(t, x, z)]
            rows.append([(j, *r) for j, r in enumerate(([(x, z, -1)] if original else []) + found)])
        return _arrow(rows, ("sub_idx", "start", "end", "tier"), [pa.int32()] * 4)

    found = run(F.col(text), F.col(start).cast("int"), F.col(end).cast("int"))
    return ranges.select(*by, F.explode(found).alias("__s")).select(*by, "__s.*")


def protected_spans(text: Column) -> Column:
    """Array of the ranges in which no dot splits."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(a: pa.Array) -> pa.Array:
        rows = [None if t is None else [m.span() for m in re.finditer("\x00+", masked(t.replace("\x00", " ")))] for t in a.to_pylist()]
        return _arrow(rows, ("start", "end"), [pa.int32()] * 2)

    return run(text)


def protect(text: str) -> tuple[str, dict[str, str]]:
    """The text with each protected part replaced by a name, and the names' texts; restore() is the inverse."""
    names: dict[str, str] = {}

    def name(m: re.Match) -> str:
        lead = re.match(rf"[{WS}]*", m.group()).group()
        key = f"\x00TOK_{len(names)}\x00"
        names[key] = m.group()[len(lead) :]
        return lead + key

    for pattern in PROTECTED:
        text = pattern.sub(name, text)
    return text, names


def restore(text: str, names: dict[str, str]) -> str:
    """The protected parts put back, later names first, as they may hold earlier ones."""
    for key in reversed(names):
        text = text.replace(key, names[key])
    return text


def numbering_column(text: Column) -> Column:
    """struct(level, prefix, title_offset) of a text's ordered prefix, null if it has none."""

    @F.arrow_udf("struct<level:int,prefix:string,title_offset:int>")
    def run(a: pa.Array) -> pa.Array:
        rows = [numbering(t) if t else None for t in a.to_pylist()]
        kind = pa.struct([("level", pa.int32()), ("prefix", pa.string()), ("title_offset", pa.int32())])
        return pa.array([r and dict(zip(("level", "prefix", "title_offset"), r, strict=True)) for r in rows], kind)

    return run(text)
