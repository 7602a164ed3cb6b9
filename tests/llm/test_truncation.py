from __future__ import annotations

import html
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import truncation as T
from glyphmill.llm.textform import code_points, form_text


def test_lengths():
    texts = ["a&b <\"'>\r\n\n\\é😀\t\x01 漢 ", "", "x"]
    got = dict(zip(T.MEASURES, T.lengths(*code_points(pa.array(texts))), strict=True))
    for k, t in enumerate(texts):
        crlf = t.replace("\r\n", "\n").replace("\n", "\r\n")
        want = {
            "chars": len(t), "utf8": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2, "html": len(html.escape(t)), "html_ascii": len(html.escape(t).encode("ascii", "xmlcharrefreplace")),
            "chars_lf": len(t.replace("\r\n", "\n")), "utf8_lf": len(t.replace("\r\n", "\n").encode()), "html_lf": len(html.escape(t.replace("\r\n", "\n"))),
            "json": len(json.dumps(t, ensure_ascii=False)) - 2, "json_ascii": len(json.dumps(t)) - 2, "chars_crlf": len(crlf), "utf8_crlf": len(crlf.encode()), "html_crlf": len(html.escape(crlf)), "words": len(t.split()),
        }
        assert {m: int(v[k]) for m, v in got.items()} == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("He ran. She hi", T.OPEN), ("He ran. She hid in it.", T.CLOSED), ("He ran. Dr.", T.OPEN), ('He ran. She said: "It is.', T.OPEN), ("He ran. She hi…", T.LEFT), ("He ran. And so on...", T.LEFT), ("He ran. …", T.LEFT),
        ("He ran.\n\nYours, Al Bo", T.CLOSED), ("He ran.\n\n-- Al Bo", T.CLOSED), ("He ran.\n\nAl Bo", T.SOFT), ("He ran.\n\n(fin)", T.CLOSED), ("He ran.\n\nThe End", T.CLOSED), ("He ran.\n\n# Next", T.CLOSED), ("He ran.\n\n- one\n- tw", T.CLOSED),
        ("He ran.\n\nhttps://a.example/b", T.CLOSED), ("He &am", T.OPEN), ("He ran. �", T.OPEN), ("กาขา คาง", T.SOFT), ("他走了。他", T.OPEN), ("他说：“好。”", T.CLOSED), ("", T.CLOSED), (" \n", T.CLOSED), ("Pots, pans, jars, etc.", T.CLOSED), ("—Ven —dijo. Véase https://a.e", T.OPEN),
        ("He ran. Am 93.", T.OPEN), ("He ran and hid..", T.OPEN), ("He ran. By 4 p.m.", T.SOFT), ("He ran. It is kept at https://a.", T.SOFT), ("He ran. “Why run?”", T.SOFT), ("He ran. He said: “It is.”…", T.CLOSED), ("He ran. See ab.…", T.LEFT),
    ],
)
def test_endings(text, want):
    assert T.ending(form_text(text)) == want


def test_limits_are_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("qwxzé") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(600):
        text = "".join(f"{word().title()} {word()} {word()} {word()}. " for _ in range(rng.randint(3, 30))).strip()
        src = ("Short ", "bytes", "free")[k % 3]
        if src == "Short " and len(text) > 200:
            text = text[:197] + "..."
        if src == "bytes" and len(text.encode()) > 300:
            text = text.encode()[:300].decode("utf-8", "replace")
        rows.append((k, text, src, "x"))
    rows += [(1000, None, "free", "x"), (None, "Cut of", None, "x"), (1001, "", "free", "x"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut string")
    docs, report = T.cut_off(df)
    got = {r["source"]: [(x["measure"], x["at"]) for x in r["limits"]] for r in report.collect()}
    assert got == {"short": [("chars", 200)], "bytes": [("utf8", 300)], "free": [], None: []}
    cut = {r["k"] for r in docs.where("cut").collect()}
    full = {k for k, t, s, _ in rows if t and ((s == "Short " and len(t) == 200) or (s == "bytes" and len(t.encode()) >= 300))}
    ends = {k for k, t, _, _ in rows if t and t.removesuffix("...").rstrip().endswith(".") and not t.endswith("....")}
    assert cut - {None} <= full and full - cut <= ends and None in cut
    empty, none = T.cut_off(df.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_every_limit_of_a_source_counts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("qwxz") for _ in range(rng.randint(2, 7)))
    rows, cut = [], set()
    for k in range(1500):
        text = "".join(f"{word().title()} {word()} {word()} {word()}. " for _ in range(rng.randint(3, 60))).strip()
        limit = (200, 500, 10_000)[k % 3]
        if len(text) > limit:
            text = text[: limit - 3] + "..."
            cut.add(k)
        rows.append((k, text, "one"))
    docs, report = T.cut_off(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    (one,) = report.collect()
    assert [(x["measure"], x["at"]) for x in one["limits"]] == [("chars", 200), ("chars", 500)]
    found = {r["k"] for r in docs.where("cut").collect()}
    assert len(found & cut) >= 0.95 * len(cut) and not found - cut


def test_weights_cover_all_code_points():
    assert T.weights().shape == (7, 0x110000) and np.all(T.weights() >= 1)
