"""The tree of sections of a document, as rows.

A tree is a table of nodes: node_id counts in pre-order, parent_id names the node above, ordinal the place among its
children.  A section's first child is its header, if it has one; a paragraph is a section without header.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segment import Piece, _arrow, pieces

NAMES = ("node_id", "parent_id", "ordinal", "depth", "node_type", "level", "start", "end", "title_offset")
NODE = "struct<node_id:int,parent_id:int,ordinal:int,depth:int,node_type:string,level:int,start:int,end:int,title_offset:int>"


def tree(parts: list[Piece]) -> list[tuple]:
    """Nodes of the segments, with their headers marked. The root is left out where it has a single section."""
    if not parts:
        return []
    # each entry: [type, piece, parent, children]; entry 0 is the root
    made: list[list] = [["section", None, -1, []]]

    def put(kind: str, piece: Piece | None, parent: int) -> int:
        made.append([kind, piece, parent, []])
        made[parent][3].append(len(made) - 1)
        return len(made) - 1

    above: list[tuple[int, int]] = []  # level and section of the headers still open
    paragraph = None
    for p in parts:
        if p.level is not None:
            above = [x for x in above if x[0] < p.level] if above and above[-1][0] >= p.level else above
            section = put("section", None, above[-1][1] if above else 0)
            put("header", p, section)
            above = [*above, (p.level, section)]
            paragraph = None
            continue
        if paragraph is None or p.blank_before:
            paragraph = put("section", None, above[-1][1] if above else 0)
        put("segment", p, paragraph)
    root = made[0][3][0] if len(made[0][3]) == 1 else 0
    out: list[tuple] = []
    numbers: dict[int, int] = {}
    todo = [(root, None, 0, 0)]
    while todo:
        n, parent, ordinal, depth = todo.pop()
        kind, p, _, children = made[n]
        numbers[n] = len(out)
        a, z = n, n
        while made[a][3]:
            a = made[a][3][0]
        while made[z][3]:
            z = made[z][3][-1]
        level = p.level if p else made[a][1].level if children and made[children[0]][0] == "header" else None
        out.append((numbers[n], parent, ordinal, depth, kind, level, made[a][1].start, made[z][1].end, p.title_offset if p else None))
        todo += [(c, numbers[n], i, depth + 1) for i, c in reversed(list(enumerate(children)))]
    return out


def section_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, node_id, parent_id, ordinal, depth, node_type, level, start, end, title_offset) of every text's tree.

    node_type is section, header or segment. A text without segments has no nodes.
    """

    @F.arrow_udf(f"array<{NODE}>")
    def run(a: pa.Array) -> pa.Array:
        i, s = pa.int32(), pa.string()
        return _arrow([None if t is None else tree(pieces(t, True)) for t in a.to_pylist()], NAMES, [i, i, i, i, s, i, i, i, i])

    return docs.select(key, F.explode(run(F.col(text))).alias("n")).select(key, "n.*")


def section_nodes_of(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """For segments with levels: each one's owner, without a tree in memory: (key, seg_idx, owner, paragraph).

    owner is the seg_idx of the header it stands under: for a header the nearest earlier one of a lesser level, for
    any other segment the last one before it. paragraph numbers the paragraphs of a document, null for headers.
    """
    header = F.col("level").isNotNull()
    w = Window.partitionBy(key).orderBy("seg_idx")
    rows = segments.select(key, "seg_idx", "level", "has_blank_line_before")
    rows = rows.withColumn("last", F.last(F.when(header, F.col("seg_idx")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = ~header & (F.col("has_blank_line_before") | F.lag(header).over(w) | F.lag("seg_idx").over(w).isNull())
    rows = rows.withColumn("paragraph", F.when(~header, F.sum(opens.cast("int")).over(w)))

    @F.arrow_udf("array<struct<seg_idx:int,up:int>>")
    def above(a: pa.Array) -> pa.Array:
        rows = []
        for listed in a.to_pylist():
            open_: list[tuple[int, int]] = []  # level and place of the headers still open
            found = []
            for h in listed:
                while open_ and open_[-1][0] >= h["level"]:
                    open_.pop()
                found.append((h["seg_idx"], open_[-1][1] if open_ else None))
                open_.append((h["level"], h["seg_idx"]))
            rows.append(found)
        return _arrow(rows, ("seg_idx", "up"), [pa.int32()] * 2)

    heads = rows.where(header).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_idx", "level"))).alias("h"))
    near = heads.select(key, F.explode(above(F.col("h"))).alias("x")).select(key, "x.*")
    return rows.join(near, [key, "seg_idx"], "left").select(key, "seg_idx", F.when(header, F.col("up")).otherwise(F.col("last")).alias("owner"), "paragraph")


def children(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of each section: (key, node_id, first, last, size, span, header_id, direct): its ends, its number of
    children, its length, the node of its header, and how many segments and headers it holds directly."""
    kids = nodes.where("parent_id is not null").groupBy(key, F.col("parent_id").alias("node_id")).agg(
        F.min_by("node_id", "ordinal").alias("first"), F.max_by("node_id", "ordinal").alias("last"), F.count(F.lit(1)).alias("size"),
        F.max(F.when((F.col("ordinal") == 0) & (F.col("node_type") == "header"), F.col("node_id"))).alias("header_id"),
        F.count(F.when(F.col("node_type") != "section", 1)).alias("direct"),
    )
    own = nodes.where("node_type = 'section'").select(key, "node_id", (F.col("end") - F.col("start")).alias("span"))
    return own.join(kids, [key, "node_id"])


def content_sections(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, node_id, start, end, header_id, ancestors, paragraph) of every section with body segments.

    header_id is the own header or, for a paragraph, the one it stands under; ancestors is the chain of headers above,
    outermost first, which for a paragraph leaves out the header that owns it; paragraph counts from 0 among its
    parent's paragraphs where there are several.
    """

    @F.arrow_udf("array<struct<node_id:int,start:int,end:int,header_id:int,ancestors:array<int>,paragraph:int>>")
    def run(a: pa.Array) -> pa.Array:
        rows = []
        for listed in a.to_pylist():
            nodes_ = {n["node_id"]: n for n in listed}
            kids: dict[int | None, list] = {}
            for n in sorted(listed, key=lambda x: x["node_id"]):
                kids.setdefault(n["parent_id"], []).append(n)
            found = []
            head = lambda i: next((k["node_id"] for k in kids.get(i, [])[:1] if k["node_type"] == "header"), None)
            todo = [(n["node_id"], [], None, None) for n in kids.get(None, [])[::-1]]
            while todo:
                i, chain, under, para = todo.pop()
                mine = head(i)
                direct = [k for k in kids.get(i, []) if k["node_type"] != "section"]
                if len(direct) > (mine is not None):
                    owned = mine is None and under is not None
                    found.append((i, direct[0]["start"], direct[-1]["end"], under if mine is None else mine, chain, para if owned else None))
                down = [*chain, mine] if mine is not None else chain
                sections = [k["node_id"] for k in kids.get(i, []) if k["node_type"] == "section"]
                plain = [s for s in sections if head(s) is None]
                place = {s: i for i, s in enumerate(plain)} if len(plain) > 1 else {}
                steps = []
                for s in sections:
                    if head(s) is not None:
                        steps.append((s, down, under, None))
                    else:
                        steps.append((s, chain, mine if mine is not None else under, place.get(s)))
                todo += steps[::-1]
            rows.append(found)
            del nodes_
        i = pa.int32()
        return _arrow(rows, ("node_id", "start", "end", "header_id", "ancestors", "paragraph"), [i, i, i, i, pa.list_(i), i])

    packed = nodes.groupBy(key).agg(F.collect_list(F.struct("node_id", "parent_id", "node_type", "start", "end")).alias("n"))
    return packed.select(key, F.explode(run(F.col("n"))).alias("c")).select(key, "c.*")


def direct_content(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, node_id, child_id, ordinal, node_type, start, end): what each section holds itself, sections aside."""
    own = nodes.where("node_type <> 'section' and parent_id is not null")
    return own.select(key, F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), "ordinal", "node_type", "start", "end")


def contents(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, node_id, header_id, level, start, end): each section's header and level, those of the section around
    it where it has none, and the range of its content past its own header (null if it is only a header)."""
    inner = nodes.where("parent_id is not null").groupBy(key, F.col("parent_id").alias("node_id"))
    first = (F.col("ordinal") == 0) & (F.col("node_type") == "header")
    own = inner.agg(F.max(F.when(first, F.struct(F.col("node_id").alias("h"), "level"))).alias("own"), F.min(F.when(~first, F.col("start"))).alias("start"), F.max(F.when(~first, F.col("end"))).alias("end"))
    sections_ = nodes.where("node_type = 'section'").select(key, "node_id", "parent_id").join(own, [key, "node_id"])

    @F.arrow_udf("array<struct<node_id:int,header_id:int,level:int,start:int,end:int>>")
    def inherit(a: pa.Array) -> pa.Array:
        rows = []
        for listed in a.to_pylist():
            known: dict[int | None, tuple] = {None: (None, None)}
            found = []
            for n in listed:  # in pre-order, so a section's parent comes first
                known[n["node_id"]] = (n["own"]["h"], n["own"]["level"]) if n["own"] else known.get(n["parent_id"], (None, None))
                found.append((n["node_id"], *known[n["node_id"]], n["start"], n["end"]))
            rows.append(found)
        return _arrow(rows, ("node_id", "header_id", "level", "start", "end"), [pa.int32()] * 5)

    packed = sections_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_id", "parent_id", "own", "start", "end"))).alias("n"))
    return packed.select(key, F.explode(inherit(F.col("n"))).alias("c")).select(key, "c.*")


def paragraphs(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, node_id, start, end) of sections that hold segments or a header but no section."""
    parents = nodes.where("node_type = 'section' and parent_id is not null").select(key, F.col("parent_id").alias("node_id")).distinct()
    return nodes.where("node_type = 'section'").join(parents, [key, "node_id"], "left_anti").select(key, "node_id", "start", "end")


def outline(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, node_id, line): each node in order, indented by its depth."""
    name = F.when(F.col("node_type") == "section", F.format_string("Section [%d, %d]", "start", "end")).when(F.col("node_type") == "header", F.format_string("Header [%d, %d]", "start", "end")).otherwise(F.format_string("Segment [%d, %d]", "start", "end"))
    return nodes.select(key, "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), name).alias("line"))


def outlines(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, outline): the lines of outline() as one text for each document."""
    lines = outline(nodes, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_id", "line"))).alias("n"))
    return lines.select(key, F.array_join(F.transform("n", lambda x: x["line"]), "\n").alias("outline"))
