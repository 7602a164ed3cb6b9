from __future__ import annotations

import random
import unicodedata as ud

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import textform as X


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｗｏｒｄ！", "word!"), ("é", "é"), ("ﾊﾟ", "パ"), ("Wеlсh", "Welch"), ("Жбуня", "Жбуня"), ("λόγιζω", "λόγιζω"), ("a­b​c﻿", "abc"),
        ("m² m2", "m² m2"), ("a b c", "a b c"), ("a  b", "a  b"), ("a‐b‑c", "a-b-c"), ("a–b—c", "a–b—c"), ("", ""), ("Ab", "Ab"), ("한", "한"),
        ("q̣̇", "q̣̇"), ("q̣̇", "q̣̇"), ("а́x", "áx"),
    ],
)
def test_form(text, want):
    assert X.form_text(text) == want
    assert X.form_text(want) == want


def test_composition_agrees_with_unicode():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab eọ̧́̈éñçạ한ㅏ한漢") for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    assert X.form_array(pa.array(texts)).to_pylist() == [ud.normalize("NFC", t) for t in texts]


def test_batches_do_not_mix_rows():
    texts = ["e", "́a", None, "", "Р", "a", "x" * 100_000 + "е"]
    got = X.form_array(pa.array(texts)).to_pylist()
    assert got == [t if t is None else X.form_text(t) for t in texts]
    assert got[1] == "́a" and got[4] == "Р" and got[6].endswith("xe")
    assert X.form_array(pa.array(texts).slice(1, 3)).to_pylist() == got[1:4]


def test_places_lead_back():
    cps, starts = X.code_points(pa.array(["aé­ｘ"]))
    form, at, src = X.form_points(cps, starts)
    assert "".join(map(chr, form)) == "aéx" and src.tolist() == [0, 1, 4] and at.tolist() == [0, 3]


def test_pairs(spark):
    rows = [(1, "a b", 1), (2, "a b", 1), (3, "a b", 1), (4, None, 1), (5, "A b", 1), (6, "ab", 2), (7, "аb", 2), (8, "аb", 1), (9, "", 1), (10, "​", 1), (None, "a b", 1), (11, "x", None), (12, "ｘ", None)]
    df = spark.createDataFrame(rows, "id_a int, v string, id_b int")
    got = {tuple(r) for r in X.look_alikes(df, "id_a", "v").collect()}
    assert got == {(1, 2), (2, 3), (6, 7), (6, 8), (9, 10), (11, 12)}
    assert {tuple(r) for r in X.look_alikes(df, "id_a", "v", "id_b").collect()} == {(1, 2), (2, 3), (6, 7), (9, 10)}
    assert X.look_alikes(df.limit(0), "id_a", "v").count() == 0
    classes = {r["id_a"]: (r["class_id"], r["links"]) for r in X.look_alike_classes(df, "id_a", "v").collect()}
    links = {k: sum(k in p for p in got) for k in {x for p in got for x in p}}
    assert {k: n for k, (_, n) in classes.items()} == links and len({c for c, _ in classes.values()}) == 4
    assert X.look_alike_classes(df.limit(0), "id_a", "v").count() == 0


def test_look_alikes_of_several_scripts():
    assert [X.form_text(t) for t in ("ТОР", "TОР", "aԁd", "Ꮯat", "ᏣᎳᎩ", "З1a")] == ["ТОР", "TOP", "add", "Cat", "ᏣᎳᎩ", "З1a"]


def test_a_heavy_form_makes_no_cross_product(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2999, "the").otherwise("thе").alias("v"))
    assert X.look_alikes(df, "id", "v").count() == 2999
