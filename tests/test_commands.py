from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmill import commands, session
from glyphmill.operators import dictionary, frequency, sections, segment, train
from glyphmill.sources import dictionaries, sig2
from glyphmill.streaming import frequency as streaming

TEXT = "The cats saw the cat. The cats sat on mats.\n\nCats and mats; the end of it.\n"


@pytest.mark.parametrize(("name", "path"), [("a.txt", "home/a.txt"), ("-", "-"), ("x/a.bin", "x/a.bin"), ("/a.bin", "/a.bin"), ("file:///a", "file:///a")])
def test_paths(name, path):
    assert commands.placed_at(name, "home") == path
    assert commands.form_of(path) == ("binary" if path.endswith(".bin") else "text")


def test_train_infer_dataset(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.txt").write_text(TEXT)
    home = ["--home", str(tmp_path)]
    text = str(tmp_path / "a.txt")
    report = commands.main(["train", "d.txt", text, *home])
    assert report["inputs"] == 1 and report["tokens"] == report["words"] + report["delimiters"] and report["size"] == sum(report[k] for k in ("start", "end", "mid", "letter", "whole", "delim"))
    assert commands.main(["train", "d.bin", text, *home]) == report
    assert sorted(dictionaries.load(str(tmp_path / "d.bin"), "binary")) == sorted(dictionaries.load(str(tmp_path / "d.txt")))
    capsys.readouterr()
    commands.main(["infer", "d.txt", text, *home])
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) >= 30 and lines[0].startswith('word "the" -> [')
    report = commands.main(["dataset", "d.txt", "out", text, *home, "--scale", "sentence"])
    back = sig2.read(spark, str(tmp_path / "out"))
    assert report["paragraphs"] == 0 and report["sentences"] == 4 and back.count() == report["records"] == 17
    assert {r["word"] for r in sig2.read_words(spark, str(tmp_path / "out")).collect()} >= {"cats", "end"} and report["words"] == 11
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO(TEXT))
    assert [r["text"] for r in commands.inputs(spark, ["-"]).collect()] == [TEXT]
    with pytest.raises(SystemExit):
        commands.main(["dataset", "a", "b"])


def test_training_raises_before_it_cuts(spark):
    words = spark.createDataFrame([("ab", 2), ("cd", 1)], "value string, freq long")
    marks = spark.createDataFrame([(chr(200 + k), 1) for k in range(12)], "value string, freq long")
    with pytest.raises(ValueError, match="most_parts"):
        train.train(words, marks, most_parts=4)
    assert train.train(words, marks).parts


def test_a_run_that_the_cut_divides(spark):
    rows = [("a", f"v{k:03d}", 1) for k in range(500)] + [("a", f"w{k}", 9) for k in range(3)] + [("b", "x", 1)]
    df = spark.createDataFrame(rows, "g string, value string, freq long")
    got = {tuple(r) for r in frequency.pruned(df, ["g"]).collect()}
    head = {tuple(r)[:3] for r in frequency.ranked_head(df, ["g"]).select("g", "value", "freq", "rank").collect()}
    assert got == head and len(got) < len(rows)


def test_tables_are_released(spark):
    with session.releasing(spark):
        kept = session.stored(spark.range(5), "x")
        path = kept.inputFiles()[0]
        assert kept.count() == 5
    fs, at = session.file_system(path)
    assert fs.get_file_info(at).type.name == "NotFound"


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_sections_as_rows(spark):
    text = "# Top\n\nIntro. More.\n\n## Sub\n\nBody."
    nodes = sections.section_nodes(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    got = {r["node_id"]: (r["header_id"], r["level"], text[r["start"] : r["end"]]) for r in sections.contents(nodes).collect()}
    assert got[0] == (1, 1, "Intro. More.\n\n## Sub\n\nBody") and got[2] == (1, 1, "Intro. More")
    assert {(r["node_id"], r["node_type"], text[r["start"] : r["end"]]) for r in sections.direct_content(nodes).collect()} >= {(0, "header", "# Top"), (2, "segment", "Intro"), (2, "segment", "More")}
    assert [r["outline"].count("\n") + 1 for r in sections.outlines(nodes).collect()] == [nodes.count()]


def test_ranges_of_any_origin(spark):
    text = "alpha beta gamma: delta epsilon zeta"
    rows = [(1, text, 0, 16), (2, text, 18, 99), (3, text, 5, 5), (4, None, 0, 3), (5, text, None, 3), (6, text, -4, 5)]
    df = spark.createDataFrame(rows, "k int, text string, start int, end int")
    got = segment.subsegments_of(df, ["k"], original=True).collect()
    whole = {r["k"]: text[r["start"] : r["end"]] for r in got if r["tier"] == -1}
    assert whole == {1: "alpha beta gamma", 2: "delta epsilon zeta", 6: "alpha"}
    assert {text[r["start"] : r["end"]] for r in got if r["k"] == 1 and r["tier"] == 2} == {"alpha", "gamma", "alpha beta gamma"}


def test_long_texts_are_cut_in_linear_time():
    import time

    def took(n):
        began = time.process_time()
        segment.pieces("Ab cd. " * n)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 40 * took(4000) + 0.5


def test_owners_of_headers(spark):
    levels = [1, None, 3, 2, None, 2, 1, 4]
    df = spark.createDataFrame([(1, k, x, False) for k, x in enumerate(levels)], "doc_id long, seg_idx int, level int, has_blank_line_before boolean")
    got = {r["seg_idx"]: r["owner"] for r in sections.section_nodes_of(df).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: 3, 5: 0, 6: None, 7: 6}


def test_new_parts_get_the_next_ids(spark):
    parts = dictionary.frame(spark, [(0, "a"), (4, "b")])
    new = spark.createDataFrame([(4, "z", 1), (4, "b", 2), (0, "q", 3), (4, "z", 4)], "kind int, value string, n int")
    got = [tuple(r) for r in dictionary.add(parts, new, ["n"]).orderBy("part_id").collect()]
    assert got == [(0, 0, "a"), (1, 4, "b"), (2, 4, "z"), (3, 0, "q")]


def test_the_latest_counts_of_a_stream(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, "a b a")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    streaming.start(stream, folder).awaitTermination()
    got = {(r["type"], r["value"]): r["freq"] for r in streaming.latest(spark, folder).where(F.col("type") == 0).collect()}
    assert got == {(0, "a"): 4, (0, "b"): 2}
