from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import sections, segment, signature, skew
from glyphmill.plans import pipelines
from glyphmill.operators import dictionary
from glyphmill.sources import corpus, sig2


def texts(text, **how):
    return [text[p.start : p.end] for p in segment.pieces(text, **how)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello world. How are you?!", ["Hello world", "How are you"]), ("...Hello world. How are you?!", ["Hello world", "How are you"]), ("Before\n---\nAfter", ["Before", "After"]), ("---", []), ("", []), (" .,;", []),
        ("the U.S.A. The year", ["the U.S.A. The year"]), ("Dr. Ed ran. He hid", ["Dr. Ed ran", "He hid"]), ("a line\nwrapped", ["a line\nwrapped"]), ("one\n\ntwo", ["one", "two"]), ("pay 3.50 at a.b/c.txt; go", ["pay 3.50 at a.b/c.txt", "go"]),
        ("see https://x.example/a.b?c=d now. ok", ["see https://x.example/a.b?c=d now", "ok"]), ("1. One\n2. Two", ["1. One\n2. Two"]),
    ],
)
def test_segments(text, want):
    assert texts(text) == want


def test_flags_and_headers():
    text = "# Top\n\nIntro.\n\n1.2 Sub\n\nBody one. Body two\n***\nTail"
    got = segment.pieces(text, True)
    assert [(text[p.start : p.end], p.level) for p in got] == [("# Top", 1), ("Intro", None), ("1.2 Sub", 2), ("Body one", None), ("Body two", None), ("Tail", None)]
    assert [(p.blank_before, p.stop_before, p.rule_before) for p in got] == [(False,) * 3, (True, False, False), (True, True, False), (True, False, False), (False, True, False), (False, False, True)]
    assert segment.numbering("(a) x") == (1, "(a)", 4) and segment.numbering("plain") is None
    assert segment.pieces("####### Deep", True)[0].level == 7


@pytest.mark.parametrize("text", ["Dr. A. at 3.5, e.g. https://a.b/c?d=$&.", "no dots", "1. x\n2. y.z", ""])
def test_protection_is_undone(text):
    hidden, names = segment.protect(text)
    assert segment.restore(hidden, names) == text and len(segment.masked(text)) == len(text)


def test_inner_ranges():
    text = "alpha beta gamma delta epsilon"
    got = [text[x.start : x.end] for x in segment.inner_ranges(text, 0, len(text))]
    assert got == ["alpha", "alpha beta gamma", "beta gamma delta", "gamma", "gamma delta", "gamma delta epsilon", "delta", "delta epsilon", "epsilon"]
    text = 'first clause: second (inner) part, and others'
    got = [(text[x.start : x.end], x.tier) for x in segment.inner_ranges(text, 0, len(text)) if x.tier < 2]
    assert got == [("first clause", 0), ("second (inner) part, and others", 0), ("second", 1), ("inner", 1), ("part", 1), ("and others", 1)]


DOCS = [(1, "# Top\n\nIntro. More.\n\nNext para.\n\n## Sub\n\nBody."), (2, "Only one."), (3, None), (4, "---"), (5, "Ab.\n\nCd.")]


def test_tables(spark):
    df = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id int, text string, start string")
    seg = segment.segments(df, headers=True)
    assert seg.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 6), (2, 1), (5, 2)]
    assert segment.segments(df.limit(0)).count() == 0
    sub = segment.subsegments(df, original=True)
    assert sub.where("tier = -1").count() == 9
    nodes = sections.section_nodes(df).persist()
    one = [(r["node_id"], r["parent_id"], r["node_type"], r["level"]) for r in nodes.where("doc_id = 1").orderBy("node_id").collect()]
    assert one == [(0, None, "section", 1), (1, 0, "header", 1), (2, 0, "section", None), (3, 2, "segment", None), (4, 2, "segment", None), (5, 0, "section", None), (6, 5, "segment", None), (7, 0, "section", 2), (8, 7, "header", 2), (9, 7, "section", None), (10, 9, "segment", None)]
    cs = [tuple(r) for r in sections.content_sections(nodes).where("doc_id = 1").orderBy("start").select("node_id", "header_id", "ancestors", "paragraph").collect()]
    assert cs == [(2, 1, [], 0), (5, 1, [], 1), (9, 8, [1], None)]
    assert sections.paragraphs(nodes).where("doc_id = 1").count() == 3
    kids = sections.children(nodes).where("doc_id = 1 and node_id = 0").first()
    assert (kids["first"], kids["last"], kids["size"], kids["header_id"], kids["direct"]) == (1, 7, 4, 1, 1)
    lines = [r["line"] for r in sections.outline(nodes).where("doc_id = 5").orderBy("node_id").collect()]
    assert lines == ["Section [0, 7]", "  Section [0, 2]", "    Segment [0, 2]", "  Section [5, 7]", "    Segment [5, 7]"]
    owners = {(r["doc_id"], r["seg_idx"]): (r["owner"], r["paragraph"]) for r in sections.section_nodes_of(seg).collect()}
    assert [owners[1, k] for k in range(6)] == [(None, None), (0, 1), (0, 1), (0, 2), (0, None), (4, 3)]


def test_signatures(spark):
    rng = random.Random(2)
    rows = [(s, p, sorted(rng.sample(range(12), rng.randint(0, 3)))) for s in range(5) for p in range(rng.randint(1, 8))] + [(9, 0, None)]
    df = spark.createDataFrame(rows, "s int, pos int, bag array<int>")
    for radius in (None, 0, 2, 50):
        got = {(r["s"], r["pos"]): (r["L"], r["C"], r["R"]) for r in signature.encode(df, ["s"], radius=radius).collect()}
        reach = 10**6 if radius is None else radius
        near = lambda s, p, ok: sorted({x for t, q, b in rows if t == s and 0 < abs(q - p) <= reach and ok(q, p) for x in b or ()})
        assert got == {(s, p): (near(s, p, lambda q, p: q < p), sorted(set(b or ())), near(s, p, lambda q, p: q > p)) for s, p, b in rows}


def test_golden_signature(spark):
    docs = spark.createDataFrame([(1, "the peppers were pickled")], "doc_id int, text string")
    d = dictionary.frame(spark, dictionary.with_atoms([(4, "the"), (4, "peppers"), (4, "were"), (4, "pickled")]))
    got, words = pipelines.signatures(docs, d, scale="sentence")
    row = got.where("word_pos = 1").first()
    assert (row["L"], row["C"], row["R"], row["cur_word"], row["next_word"]) == ([0], [1], [2, 3], 1, 2)
    assert [r["word"] for r in words.orderBy("word_id").collect()] == ["the", "peppers", "were", "pickled"]
    both, _ = pipelines.signatures(docs, d)
    assert both.groupBy("scale").count().orderBy("scale").collect() == [(0, 4), (1, 4)]


def test_dataset_files(spark, tmp_path):
    rng = random.Random(4)
    label = lambda: rng.choice([None, 0, 5, 127, 128, 70_000])
    some = lambda: sorted(rng.sample(range(100_000), rng.randint(0, 5)))
    records = [(rng.randint(0, 1), label(), label(), some(), some(), some()) for _ in range(300)]
    data = sig2.Dataset(100_000, ["a", "é"], records)
    assert sig2.decode(sig2.encode(data)) == data
    empty = sig2.Dataset(1, [], [])
    assert sig2.decode(sig2.encode(empty)) == empty
    rows = [(i, *r) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "idx int, scale int, cur_word int, next_word int, L array<int>, C array<int>, R array<int>")
    n = sig2.write(df.repartition(3), ["a"], 100_000, str(tmp_path), per_file=7)
    back = sig2.read(spark, str(tmp_path))
    key = lambda r: repr(tuple(r))
    assert n >= 43 and sorted(map(key, back.select("scale", "cur_word", "next_word", "L", "C", "R").collect())) == sorted(map(key, records))
    for bad in (b"XXXX", b"SIG2\x09" + b"\0" * 20):
        with pytest.raises(ValueError):
            sig2.decode(bad)
    with pytest.raises(ValueError):
        sig2.encode(sig2.Dataset(1, ["x" * 70_000], []))


def test_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\n".encode() + b"\xff")
    assert corpus.read_bytes(spark, str(tmp_path)).first()["bytes"] == "Ã©\n\xff"
    assert corpus.read_text(spark, str(tmp_path)).first()["text"] == "é\n�"


def test_heavy_keys(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 1, 2]), rng.choice([None, 7, 7, 7, 8]), rng.choice([None, 7, 9]), 0) for k in range(200)]
    rows += rows[:30] + [(None, 1, 7, 7, 0)]
    df = spark.createDataFrame(rows, "k long, doc int, a int, b int, heavy int")
    once = {r[0]: r for r in rows if r[0] is not None}.values()
    want = {}
    for f, i, j in (("a", 2, 3), ("b", 3, 2)):
        mine = [r for r in once if r[i] is not None]
        for v in {r[i] for r in mine}:
            hit = [r for r in mine if r[i] == v]
            want[f, v] = (len(hit), len({r[1] for r in hit} - {None}), len({r[j] for r in hit} - {None}), len(hit) >= 0.5 * len(mine))
    got = skew.per_key(df, "k", "doc", {"a": "b", "b": "a"}, heavy=0.5).collect()
    assert {(r["field"], r["word_id"]): (r["records"], r["documents"], r["neighbours"], r["heavy"]) for r in got} == want
    heavy = {tuple(r) for r in skew.heavy_keys(df, "k", ["a", "b"], heavy=0.5).collect()}
    assert heavy == {k for k, v in want.items() if v[3]}
    assert skew.heavy_keys(df.limit(0), "k", ["a", "b"]).count() == 0 and skew.per_key(df.limit(0), "k", "doc", {"a": "b"}).count() == 0


def test_the_latest_row_holds(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 9, None), (2, None, 1)], "k int, a int, v int")
    assert sorted(map(tuple, skew.once(df, "k", ["a"], "v").collect()), key=repr) == [(1, 6), (2, None)]


def test_one_key_in_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(F.col("id").alias("k"), (F.col("id") % 100).alias("doc"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    got = skew.per_key(df, "k", "doc", {"a": "b"}).where("heavy").collect()
    assert [(r["word_id"], r["records"], r["documents"], r["neighbours"]) for r in got] == [(7, 10_001, 100, 10_001)]
