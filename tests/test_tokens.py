from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import decompose, dictionary, frequency, train
from glyphmill.operators.tokenize import byte_tokens, tokenize, walk
from glyphmill.plans import registry
from glyphmill.sources import dictionaries

# A small corpus with known counts of trained parts.
CORPUS = (
    "Peter Piper picked a peck of pickled peppers. The peppers Peter picked were pickled peppers.\n"
    "Running, jumping, and playing, the players were playing games. Playing games is running fun.\n"
    "She said, \"don't stop\" -- the U.S.A. team scored 3.14 points for $5 each... really!\n"
    "Unhappy, unkind, and unable: the unfriendly unicorn was undone by the underground unrest."
)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2,4-d", ["2,4-d"]), ("5+5", ["5", "+", "5"]), ("U.S.A", ["u.s.a"]), ("-$5", ["-$5"]), ("a--b", ["a", "--", "b"]), ("mothers' day", ["mothers'", " ", "day"]),
        ("a\n\nb", ["a", "\n\n", "b"]), ("a  b", ["a", "\t", "b"]), ("don't", ["don't"]), ("say 'yes'!", ["say", " ", "'", "yes", "'!"]), ("", []), ("1,234.56", ["1,234.56"]),
    ],
)
def test_walk(text, want):
    assert [v for _, v in walk(text)] == want


def test_native_tokens_agree(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB1.,-'&$+ \n\r\té!") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts = [t.encode().decode("latin-1") for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(t["type"], t["value"]) for t in r["x"]] for r in df.select("i", byte_tokens(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [walk(t) for t in texts]


def test_tokens_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z")], "doc_id int, text string, pos string")
    assert tokenize(df).select("doc_id", "pos", "value").collect() == [(3, 0, "a"), (3, 1, " "), (3, 2, "b")]
    assert tokenize(df.limit(0)).count() == 0


def test_totals_and_stream_of_whole_texts(spark, tmp_path):
    texts = ["Don't pay $5 or 1,234.56 -- it's 2,4-d!", "Élan a-b\r\n\r\nU.S.A. 'so'  don't", "x... 日本 7", "Plain words only", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(t for x in texts if x for t in walk(x.encode().decode("latin-1")))
    words, rest = (sum(n for (k, _), n in want.items() if k == kind) for kind in (0, 1))
    queries = registry.queries()
    assert [tuple(r) for r in queries["text_totals"](spark, str(tmp_path)).collect()] == [(words, sum(k == 0 for k, _ in want), rest, words + rest)]
    got = {(r["type"], r["value"]): r["freq"] for r in queries["streamed_tokens"](spark, str(tmp_path)).collect()}
    assert got == want and got[0, "don't"] == 2 and got[0, "1,234.56"] == 1


def test_ranks(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", 1)], "value string, freq long").withColumn("g", F.lit(0))
    assert [r["value"] for r in frequency.ranked(df, ["g"]).orderBy("rank").collect()] == ["c", "a", "b", "d"]
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), f"v{k}", rng.randint(1, 5)) for k in range(400)]
    got = {(r["g"], r["value"]): r["rank"] for r in frequency.ranked(spark.createDataFrame(rows, "g string, value string, freq int"), ["g"]).collect()}
    want = {}
    for g in "xyz":
        want |= {(g, v): i + 1 for i, (_, v) in enumerate(sorted((-f, v) for h, v, f in rows if h == g))}
    assert got == want


def test_the_cut_divides_a_run(spark):
    df = spark.createDataFrame([(0, v, 1) for v in "cabd"] + [(1, v, f) for v, f in zip("abcdefgh", (9, 9, 1, 1, 1, 1, 1, 1), strict=True)], "g int, value string, freq int")
    got = sorted((r["g"], r["value"]) for r in frequency.pruned(df, ["g"]).collect())
    assert got == [(0, "a"), (0, "b"), (0, "c"), (0, "d"), (1, "a"), (1, "b")]
    even = spark.createDataFrame([(0, v, 1) for v in "hgfedcba"], "g int, value string, freq int").withColumn("freq", F.when(F.col("value") < "c", 2).otherwise(1))
    assert frequency.pruned(even, ["g"]).count() == 2


def test_dictionary(spark):
    assert len(dictionary.atoms()) == 42 + 126 + 6
    d = dictionary.frame(spark, [(4, "a"), (0, "un"), (4, "a")])
    assert sorted(map(tuple, d.collect())) == [(0, 4, "a"), (1, 0, "un")]
    new = spark.createDataFrame([(4, "z", 2), (4, "a", 0), (1, "ing", 1)], "kind int, value string, o int")
    assert sorted(map(tuple, dictionary.add(d, new, ["o"]).collect())) == [(0, 4, "a"), (1, 0, "un"), (2, 1, "ing"), (3, 4, "z")]
    with pytest.raises(ValueError):
        dictionary.parts_of(d, 1)


def test_dictionary_files(tmp_path):
    parts = dictionary.with_atoms([(4, "the"), (0, "un"), (2, "ppe"), (1, "ing"), (5, "\n"), (5, "\\")])
    again = dictionaries.from_text(dictionaries.to_text(parts))
    assert set(again) == set(parts) and dictionaries.to_text(again) == dictionaries.to_text(parts)
    assert dictionaries.from_bytes(dictionaries.to_bytes(parts)) == parts
    for form in ("text", "binary"):
        dictionaries.save(parts, str(tmp_path / form), form)
        assert set(dictionaries.load(str(tmp_path / form), form)) == set(parts)
    assert dictionaries.from_text("##\n####x\r\n\n[delim]\n\\x41")[:2] == [(1, "##x"), (5, "A")]
    for bad in (b"XXXX", b"BDI2", b"BDI2\x09\0\0\0", b"BDI2\x01\0\0\0\x04", b"BDI2\x01\0\0\0\x09\x01\x00a", b"BDI2\x01\0\0\0\x04\x09\x00a"):
        with pytest.raises(ValueError):
            dictionaries.from_bytes(bad)


def decomposed(parts, word):
    """Plain form of the greedy decomposition."""
    ids = {p: i for i, p in enumerate(parts)}
    if (4, word) in ids:
        return [ids[4, word]]
    found = []
    n = len(word)
    for size in range(2, min(7, n) + 1):
        for kind, spots in ((0, [0]), (1, [n - size]), (2, range(n - size + 1))):
            found += [(ids[kind, word[p : p + size]], p, size, kind) for p in spots if (kind, word[p : p + size]) in ids]
    taken, used, out = set(), set(), []
    for i, p, size, kind in sorted(found):
        if (kind in (0, 1) and kind in used) or taken & set(range(p, p + size)):
            continue
        taken |= set(range(p, p + size))
        used.add(kind)
        out.append((p, i))
    for p, c in enumerate(word):
        if p not in taken:
            first, last = p == 0 and 0 not in used, p == n - 1 and 1 not in used
            form = f"##{c}" if last and not first else f"##{c}##" if not first and not last else f"{c}##"
            if (3, form) in ids:
                out.append((p, ids[3, form]))
    return [i for _, i in sorted(out)]


def test_decompose(spark):
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    parts = dictionary.with_atoms([(rng.choice((0, 1, 2, 2, 4)), word(2, 4)) for _ in range(60)])
    words = sorted({word(1, 12) for _ in range(200)} | {"+a", "é"})
    df = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "word string")
    got = {r["word"]: r for r in decompose.decompose(df, dictionary.frame(spark, parts)).collect()}
    assert set(got) == set(words)
    assert {w: r["part_ids"] for w, r in got.items()} == {w: decomposed(parts, w) for w in words}
    assert all(r["bag"] == sorted(set(r["part_ids"])) for r in got.values())


def test_delimiters(spark):
    d = dictionary.frame(spark, [(5, "--"), (5, "."), (5, "?")])
    df = spark.createDataFrame([("--",), ("?.x",), ("",), (None,), ("y",)], "value string")
    assert {r["value"]: r["part_ids"] for r in decompose.decompose_delimiters(df, d).collect()} == {"--": [0], "?.x": [2, 1], "y": []}


def test_training(spark):
    tokens = tokenize(spark.createDataFrame([(1, CORPUS)], "doc_id int, text string"))
    got = train.train(frequency.frequencies(tokens, 0), frequency.frequencies(tokens, 1))
    counts = {k: sum(1 for x, _ in got.parts if x == k) for k in range(6)}
    assert counts == {0: 63, 1: 89, 2: 166, 3: 126, 4: 52, 5: 13}
    assert len(got.parts) == 509


def test_training_on_nothing(spark):
    none = spark.createDataFrame([], "value string, freq long")
    assert set(train.train(none, none).parts) == set(dictionary.atoms())
